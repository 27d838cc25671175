"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fingerprints, licenses, near_dedup, pii, quality, substring_dedup, token_counts, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every document that holds a test item."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return bpe.round_trip(_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    return pii.digest(pii.find(_table(spark, folder, "documents").select("doc_id", "text")))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, copy_of, class_id, keep of every document: its near-duplicate class, of which the least id stays."""
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: every document without the 13-word windows that a smaller doc_id has."""
    return substring_dedup.digest(substring_dedup.deduplicate(_table(spark, folder, "documents")))


def op6_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata and the conversion record of every page's response; the blocks of both are UTF-8."""
    return warc.derive(warc.responses(_table(spark, folder, "pages"))).withColumn("block", F.col("block").cast("string"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are to each other and to the next document's."""
    return fingerprints.compare_with_next(_table(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, license, containment, first_word, last_word, places: every licence notice of every document."""
    return licenses.scan(_table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by trees that never saw the held-out fifth's labels."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    forest = quality.train(docs, _table(spark, folder, "labels"))
    return quality.score(docs, forest).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The exact length histogram of all documents with its prefix and suffix sums, a row for each length that occurs."""
    return token_counts.limits(token_counts.histogram(_table(spark, folder, "documents")))


def queries() -> dict:
    own = (op1_decontamination, op2_byte_bpe, op3_pii, op4_near_dedup, op5_substring_dedup, op6_warc_derivatives, op7_fingerprints, op8_license_scan, op9_quality, op10_token_counts)
    return {f.__name__: f for f in own}


#: DuckDB SQL over the same table: all windows as strings, the least document of each, and what no earlier document has.
SUBSTRING_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; tokenizers, trained models and sketches it cannot."""
    return {"op5_substring_dedup": SUBSTRING_SQL}
