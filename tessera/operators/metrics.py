"""Retrieval quality and its comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How far a metric may fall (shares) and how many times a latency may grow.
TOLERANCE = {"precision": 0.10, "recall": 0.10, "mrr": 0.05}
LATENCY_FACTOR = 2.0


def per_query(returned: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hits, relevant, precision (of k), recall (null without relevant rows), reciprocal_rank (0 without a hit).

    ``returned``: query_id, id, rank from 0; ``relevant``: query_id, id. Every query of either side has a row.
    """
    goal = relevant.distinct().withColumn("__rel", F.lit(1))
    every = returned.join(goal, ["query_id", "id"], "full_outer").groupBy("query_id").agg(
        F.count_if(F.col("__rel").isNotNull() & (F.col("rank") < k)).alias("hits"),
        F.count("__rel").alias("relevant"),
        F.min(F.when(F.col("__rel").isNotNull(), F.col("rank"))).alias("__first"),
    )
    return every.select("query_id", "hits", "relevant", (F.col("hits") / k).alias("precision"), F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1 / (F.col("__first") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def summary(queries: DataFrame) -> DataFrame:
    """Means: precision and reciprocal rank over all queries, recall over those with relevant rows."""
    return queries.agg(F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"))


def ndcg(returned: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: gains rel / log2(rank + 2), against the best order of the query's grades."""
    gain = lambda rank: F.col("rel") / F.log2(rank + 2.0)
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")) - 1).filter(F.col("r") < k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("r"))).alias("ideal"))
    got = returned.filter(F.col("rank") < k).join(grades, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"))
    return ideal.join(got, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Nearest-rank percentiles."""
    return df.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in shares.items()))


def path_hit(returned: str, relevant: str):
    """Whether a returned path is the relevant one or ends with it after a slash, whatever the case."""
    a, b = F.lower(returned), F.lower(relevant)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b))


def per_query_paths(returned: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """The same as ``per_query`` for paths: returned (query_id, path, rank from 0), relevant (query_id, path); queries without relevant paths count as 0.

    A returned path is relevant if it is one of these or ends with one after a slash or a backslash, whatever the case:
    all its endings are looked up, so paths meet in an equi-join. Two returned paths may hit the same relevant one.
    """
    goal = relevant.select("query_id", F.lower("path").alias("end")).distinct()
    low = F.lower("path")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: (i == 1) | F.substr(low, i - 1, F.lit(1)).isin("/", "\\"))
    ends = returned.select("query_id", "rank", F.explode(F.transform(starts, lambda i: F.substr(low, i))).alias("end"))
    hits = ends.join(goal, ["query_id", "end"], "left_semi").select("query_id", "rank").distinct()
    found = hits.groupBy("query_id").agg(F.count_if(F.col("rank") < k).alias("hits"), F.min("rank").alias("__first"))
    every = returned.select("query_id").union(relevant.select("query_id")).distinct()
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = every.join(wanted, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["hits", "relevant"])
    return rows.select("query_id", "hits", "relevant", (F.col("hits") / k).alias("precision"), F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1 / (F.col("__first") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def regressions(baseline: dict[str, float], new: dict[str, float]) -> dict[str, str]:
    """metric: why it fails. Exactly at a threshold passes."""
    failed = {}
    for name, most in TOLERANCE.items():
        if name in baseline and name in new and new[name] < baseline[name] - most - 1e-12:
            failed[name] = f"{baseline[name]:.3f} -> {new[name]:.3f}"
    if "p95_ms" in baseline and new.get("p95_ms", 0) > LATENCY_FACTOR * baseline["p95_ms"]:
        failed["p95_ms"] = f"{baseline['p95_ms']:.1f} -> {new['p95_ms']:.1f}"
    return failed


def retrieval_set(docs: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """query, relevant_doc_ids, relevant_source_paths: ``size`` titled documents in an order that the seed fixes; a title asks for its documents."""
    titled = docs.filter("trim(title) <> ''").groupBy(F.trim("title").alias("query")).agg(F.sort_array(F.collect_set("id")).alias("relevant_doc_ids"), F.sort_array(F.collect_set("source_path")).alias("relevant_source_paths"))
    return titled.orderBy(F.xxhash64("query", F.lit(seed)), "query").limit(size)
