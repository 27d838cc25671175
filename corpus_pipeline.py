"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.

Defined results, in every stage: null and empty texts are documents like others (one of all those without words stays in
the second stage); other columns of docs, whatever their names, are left out; an empty table gives an empty table; very
long texts are worked on as a whole. Of rows without an id the second stage keeps all, the other stages judge each by
its text. Rows that share an id are judged each by its own text, but by the second stage together: they stay or go with
the class of all their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, near_dedup, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the stages are a trained model, minimum hashing, ranked retrieval and a tokenizer.
ORACLE_SQL = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled rows that are not held out.

    Without labels every document has the same score, 0.5, and stays.
    """
    forest = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), forest).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class. Ties do not occur: equal ids are one document."""
    gone = near_dedup.near_duplicates(docs).filter("not keep").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, each judged where it lies, so nothing is shuffled."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced (a null text stays null); n_chars is counted anew."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their token ids and the number of these."""
    return bpe.encode(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is cut off from its lineage, as Parquet between stages would."""
    from tessera.llm._arrow import checkpointed

    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
