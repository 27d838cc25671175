"""Exact length histogram: documents by encoded length, and totals for every context limit from its suffix sums.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count each; an empty table
has an empty histogram; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import append_columns, checkpointed, slices, text_buffers
from tessera.llm.bpe import shared_codec

#: Lengths of one block of the histogram; sums over blocks come first, so that no window spans all lengths.
BLOCK = 1024


def lengths(df: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of ids of each text."""
    own_codec = shared_codec(df.sparkSession, path)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own = own_codec()
        found = [own.count(data, offsets) for _, _, data, offsets in slices(*text_buffers(batch.column(0)))]
        return [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())]

    return append_columns(df, T.StructType([T.StructField(out, T.LongType())]), compute, [text])


def histogram(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens, docs: how many documents have each length. Counts are summed before the shuffle."""
    return lengths(df.select(F.col(text).alias("text")), path).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: what lies up to it and beyond it.

    n_tokens, docs, tokens; docs_within, tokens_within (of length <= limit); docs_over, tokens_over (longer);
    truncated_total: tokens left if every document is cut to the limit; rank_from, rank_to: the ranks (from 1) that the
    documents of this length take in ascending order, from which any quantile follows. Between two lengths that occur,
    docs_within and tokens_within keep the lower one's values and truncated_total grows by docs_over for each token.
    """
    counts = checkpointed(counts)  # read several times; a row for each length
    rows = counts.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # One row for 1024 lengths: as many as the longest document has thousands of tokens, whatever the corpus.
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(f"block_{x}").over(w), F.lit(0)).alias(f"{x}_{side}") for side, w in (("after", after), ("before", before)) for x in ("docs", "tokens")),
    )
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.join(blocks, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        *((F.col(f"{x}_before") + F.sum(x).over(up)).alias(f"{x}_within") for x in ("docs", "tokens")),
        *((F.col(f"{x}_after") + F.coalesce(F.sum(x).over(down), F.lit(0))).alias(f"{x}_over") for x in ("docs", "tokens")),
    )
    return sums.select(
        "*",
        (F.col("tokens_within") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        (F.col("docs_within") - F.col("docs") + 1).alias("rank_from"),
        F.col("docs_within").alias("rank_to"),
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the documents does not exceed (nearest rank)."""
    asked = report.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    total = report.agg(F.sum("docs").alias("total"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    return asked.crossJoin(F.broadcast(total)).withColumn("rank", rank).join(report, F.col("rank").between(F.col("rank_from"), F.col("rank_to"))).select("share", "n_tokens")


def at_limits(report: DataFrame, asked: list[int]) -> DataFrame:
    """limit, docs_within, tokens_within, docs_over, truncated_total for any context limits, also of lengths that do not occur."""
    within = F.col("n_tokens") <= F.col("limit")
    table = report.sparkSession.createDataFrame([(int(x),) for x in asked], "limit long")
    sums = report.select("n_tokens", "docs", "tokens").join(F.broadcast(table))
    return (
        sums.groupBy("limit")
        .agg(
            F.sum(F.when(within, F.col("docs")).otherwise(0)).alias("docs_within"),
            F.sum(F.when(within, F.col("tokens")).otherwise(0)).alias("tokens_within"),
            F.sum(F.when(within, 0).otherwise(F.col("docs"))).alias("docs_over"),
        )
        .withColumn("truncated_total", F.col("tokens_within") + F.col("limit") * F.col("docs_over"))
    )
