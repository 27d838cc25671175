"""Retrieval and ranking: lexical and vector legs, fusion, duplicates, boosts, snippets.

A ranked list is a DataFrame with id and score; its order is score descending, id ascending, and rank (from 0) is a
column where an operator needs it. Clocks are parameters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import settled
from tessera.functions.queries import TextQuery, keywords, query_entities
from tessera.operators.graph import components
from tessera.operators.merging import page

WORD = r"[\p{L}\p{N}_]+"
# Extensions of code and of documentation files.
CODE_EXTENSIONS = (".go", ".js", ".ts", ".py", ".jsx", ".tsx", ".rb", ".rs", ".java")
DOC_EXTENSIONS = (".md", ".txt", ".rst")
#: Queries that one pass over the vectors answers; their vectors are broadcast.
QUERY_BLOCK = 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenised(df: DataFrame, words: Column, *more: str | Column) -> DataFrame:
    """``df`` as id, __w and further columns. Tokens are made once for each row: a generator keeps filters on them above it."""
    return df.select("id", *more, F.explode(F.array(words)).alias("__w"))


def _holds(words: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    # Tokens have no blanks, so a phrase is a part of the joined tokens.
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def matches(words: Column, query: TextQuery) -> Column:
    """Whether a token array satisfies a web-style query."""
    hit = F.lit(bool(query.groups))
    for group in query.groups:
        any_of = F.lit(False)
        for phrase in group:
            any_of = any_of | _holds(words, phrase)
        hit = hit & any_of
    for phrase in query.excluded:
        hit = hit & ~_holds(words, phrase)
    return hit


def term_counts(words: Column, terms: list[str]) -> list[Column]:
    def count(term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == term))

    return [count(t) for t in terms]


def keyword_search(df: DataFrame, query: TextQuery, text: str = "content", limit: int | None = None) -> DataFrame:
    """id, score (how often the query's terms occur) of the rows that match."""
    rows = tokenised(df, tokens(F.col(text))).filter(matches(F.col("__w"), query))
    total = sum(term_counts(F.col("__w"), query.terms), F.lit(0))
    return page(rows.select("id", total.cast("double").alias("score")), [F.desc("score"), "id"], limit)


def bm25_search(df: DataFrame, terms: list[str], text: str = "content", limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score by BM25 over rows with any of the terms. Texts are read and cut once: what is kept of each is its length and a count for each term."""
    rows = settled(tokenised(df, tokens(F.col(text))).select("id", F.size("__w").alias("__n"), *(c.alias(f"__t{i}") for i, c in enumerate(term_counts(F.col("__w"), terms)))))
    seen = [F.count_if(F.col(f"__t{i}") > 0).alias(f"__d{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("__rows"), F.avg("__n").alias("__mean"), *seen)  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"__t{i}"), F.col(f"__d{i}")
        idf = F.log(1 + (F.col("__rows") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))
    hit = rows.filter(sum((F.col(f"__t{i}") for i in range(len(terms))), F.lit(0)) > 0)
    return page(hit.crossJoin(F.broadcast(stats)).select("id", score.alias("score")), [F.desc("score"), "id"], limit)


def _covers(places: list[tuple[int, int, float]], n_terms: int) -> float:
    """Cover density: shortest spans that hold all terms, each worth its weights over its length."""
    total, last = 0.0, [-1] * n_terms
    held: dict[int, tuple[int, float]] = {}
    begin_before = -1
    for pos, term, weight in places:
        held[term] = (pos, weight)
        last[term] = pos
        if len(held) < n_terms:
            continue
        begin = min(p for p, _ in held.values())
        if begin <= begin_before:
            continue
        begin_before = begin
        inverse = sum(1.0 / w for _, w in held.values())
        noise = (pos - begin) - (n_terms - 1)
        total += (n_terms / inverse) / (1 + max(noise, 0))
    return total


def cover_density(df: DataFrame, terms: list[str], title: str = "title", text: str = "content", weights: tuple[float, float] = (1.0, 0.4), limit: int | None = None) -> DataFrame:
    """id, score of rows that have all terms, ranked by cover density; title words weigh more and come first in order.

    Rows are matched in the JVM; only the matching rows' token places go to Python, in Arrow batches.
    """
    n_title = F.size(tokens(F.col(title)))
    rows = tokenised(df, F.concat(tokens(F.col(title)), tokens(F.col(text))), n_title.alias("__n"))
    for t in terms:
        rows = rows.filter(F.array_contains("__w", t))
    own = F.array(*map(F.lit, terms))
    places = F.filter(F.transform("__w", lambda w, i: F.struct(i.alias("pos"), F.array_position(own, w).cast("int").alias("term"))), lambda p: p["term"] > 0)
    rows = rows.select("id", places.getField("pos").alias("pos"), places.getField("term").alias("term"), "__n")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, term, n = (batch.column(k).to_pylist() for k in range(4))
            scores = [_covers([(a, b - 1, weights[0] if a < m else weights[1]) for a, b in zip(p, t, strict=True)], len(terms)) for p, t, m in zip(pos, term, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["id", "score"])

    return page(rows.mapInArrow(step, "id long, score double"), [F.desc("score"), "id"], limit)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def vector_search(df: DataFrame, vector: list[float], limit: int | None, id_column: str = "id", column: str = "embedding", threshold: float | None = None) -> DataFrame:
    """id, score: the exact nearest rows by cosine similarity. Rows without a direction have no row.

    Equal vectors have equal scores wherever they lie, so ids decide between them: sums run over the numbers in their
    order, as SQL's do. A product of a matrix does not give that, as the last rows of a batch are summed in another order.
    """
    goal = np.asarray(vector, np.float64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = _cosines(batch.column(0), batch.column(1), goal)
            keep = np.ones(len(ids), bool) if threshold is None else scores >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(scores[keep], pa.float64())], names=["id", "score"])

    rows = df.filter(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), column)
    kind = rows.schema["id"].dataType.simpleString()
    return page(rows.mapInArrow(step, f"id {kind}, score double"), [F.desc("score"), "id"], limit)


def unit_vectors(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors of those rows that have one of ``width`` numbers that are not all 0."""
    ids, x = _of_width(ids, vectors, width)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return ids[good], x[good] / norm[good, None]


def _of_width(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of those rows that have one of ``width`` numbers; a null among them is NaN."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1)
    fits = pc.equal(lengths, width)
    x = vectors.filter(fits).flatten()
    x = pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, width))
    return ids.filter(fits).to_numpy(zero_copy_only=False), x


def _cosines(ids: pa.Array, vectors: pa.Array, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and cosine similarities to ``goal`` of those rows that have a direction; each row's sums run from its first number to its last."""
    ids, x = _of_width(ids, vectors, len(goal))
    dot, own, other = np.zeros(len(ids)), np.zeros(len(ids)), 0.0
    for column, g in zip(np.ascontiguousarray(x.T), goal, strict=False):
        dot += column * g
        own += column * column
        other += g * g
    good = np.isfinite(own) & (own > 0)
    dot, own, other = dot[good], own[good], other or 1.0
    with np.errstate(over="ignore"):
        both = np.sqrt(own * other)
    both = np.where((both > 0) & np.isfinite(both), both, np.sqrt(own) * np.sqrt(other))  # very small and very large numbers
    return ids[good], np.clip(dot / both, -1.0, 1.0)


def vector_search_many(df: DataFrame, queries: DataFrame, k: int, id_column: str = "id", column: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the exact k nearest rows of each query, other rows than itself.

    Vectors that are null, zero, or of another length than the first query's have no direction to compare and no row.

    Queries are taken in blocks of QUERY_BLOCK, which bounds what is broadcast; each partition multiplies its vectors
    with the block's and passes on k rows for each query, so the shuffle holds k rows a query and partition.
    """
    named = queries.select(F.col(id_column).alias("query_id"), F.col(column).alias("v"))
    total = named.count()
    out = None
    blocks = max(1, -(-total // QUERY_BLOCK))
    for block in range(blocks):
        own = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = own.orderBy("query_id").collect()
        width = next((len(r[1]) for r in rows if r[1]), 0)
        ids, unit = unit_vectors(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), width)

        def step(batches: Iterator[pa.RecordBatch], ids=ids, unit=unit) -> Iterator[pa.RecordBatch]:
            q = ids
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                if not len(q):
                    continue
                own, x = unit_vectors(batch.column(0), batch.column(1), unit.shape[1])
                if not len(own):
                    continue
                scores = unit @ x.T
                scores[q[:, None] == own[None, :]] = -np.inf
                for i in range(len(q)):
                    top = np.lexsort((own, -scores[i]))[:k]
                    merged = best.get(i, []) + [(float(scores[i, j]), int(own[j])) for j in top if np.isfinite(scores[i, j])]
                    best[i] = sorted(merged, key=lambda p: (-p[0], p[1]))[:k]
            found = [(int(q[i]), d, s) for i, pairs in best.items() for s, d in pairs]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "score"])

        hits = df.select(F.col(id_column).cast("long").alias("id"), column).mapInArrow(step, "query_id long, id long, score double")
        out = hits if out is None else out.union(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order).cast("long") - 1).filter(F.col("rank") < k)


# --- fusion ---


def ranked(df: DataFrame, leg: str, limit: int) -> DataFrame:
    """leg, id, score, rank of the first ``limit`` rows; only these are ranked, so the one partition is bounded."""
    top = page(df, [F.desc("score"), "id"], limit)
    return top.withColumn("leg", F.lit(leg)).withColumn("rank", F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("score"), "id")).cast("long") - 1)


def dynamic_k(a: DataFrame, b: DataFrame, base: float = 60.0) -> DataFrame:
    """One row, k: smaller the more the two lists share; ``base`` where a list has less than three rows."""
    both = a.select("id", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    sums = both.agg(F.sum("nx").alias("na"), F.sum("ny").alias("nb"), F.sum(F.when(F.col("x") == 1, F.col("ny")).otherwise(0)).alias("shared"))
    least = F.least("na", "nb")
    k = F.greatest(F.lit(base * 0.5), F.least(F.lit(base * 2), base * (1.5 - F.col("shared") / least)))
    return sums.select(F.when(F.coalesce(least, F.lit(0)) < 3, F.lit(base)).otherwise(k).alias("k"))


def rrf(legs: list[DataFrame], k: DataFrame | float = 60.0) -> DataFrame:
    """id, score: the sum over lists of 1 / (k + rank + 1)."""
    every = legs[0].select("id", "rank")
    for leg in legs[1:]:
        every = every.union(leg.select("id", "rank"))
    every = every.crossJoin(F.broadcast(k)) if isinstance(k, DataFrame) else every.withColumn("k", F.lit(float(k)))  # k is one row
    return every.groupBy("id").agg(F.sum(1 / (F.col("k") + F.col("rank") + 1)).alias("score"))


def fold(legs: list[DataFrame], base: float = 60.0, limit: int = 200) -> DataFrame:
    """id, score, leg, rank of many ranked lists fused pair by pair from the left; leg is the first list that has the row."""
    first = legs[0].select("id", F.lit(0).alias("leg"))
    for n, leg in enumerate(legs[1:], 1):
        first = first.union(leg.select("id", F.lit(n)))
    total = legs[0]
    for leg in legs[1:]:
        total = ranked(rrf([total, leg], dynamic_k(total, leg, base)), "fused", limit)
    return total.drop("leg").join(first.groupBy("id").agg(F.min("leg").alias("leg")), "id")


def vector_clusters(df: DataFrame, threshold: float = 0.85, id_column: str = "id", column: str = "embedding", tables: int = 24, bits: int = 12, seed: int = 5, exact: bool = False) -> DataFrame:
    """id, root: vectors joined by cosine similarity from ``threshold`` on.

    Random hyperplanes give each vector a bucket in each of ``tables`` tables; a bucket's members are held against its
    leader (another one in each table) exactly, and links are closed transitively. So buckets make no pairs of all their
    members; a chain of pairs that share no leader can be missed. With ``exact`` all vectors meet all in blocks, which
    costs the square of their number and misses nothing. Vectors on their own, and those that are null, zero or of an
    unusual length, have no row.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            own, x = unit_vectors(batch.column(0), batch.column(1), width)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            signs = ((x @ planes) > 0).reshape(len(own), tables, bits)
            keys = (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
            ids = np.repeat(own, tables)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel(), pa.int64())], names=["id", "key"])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    width = rows.agg(F.mode(F.size("v"))).first()[0] or 1
    if exact:
        return components(_all_pairs(rows.filter(F.size("v") == width), width, threshold))
    buckets = rows.mapInArrow(step, "id long, key long")
    flip = F.xxhash64("key")
    lead = buckets.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(flip)).alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("least").bitwiseXOR(flip).alias("leader"))
    pairs = buckets.join(lead, "key").filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    side = lambda c: rows.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(cosine(F.col("va"), F.col("vb")) >= threshold).select("a", "b")
    return components(near)


def _all_pairs(rows: DataFrame, width: int, threshold: float, block: int = 2048) -> DataFrame:
    """a, b: links that join all classes of vectors with a similar pair; block meets block, each pair of blocks in one group."""
    parts = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(parts - 1))
    sides = dealt.select("id", "v", "part", F.explode(other).alias("with")).select("id", "v", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))

    def step(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, x = unit_vectors(group.column("id").combine_chunks(), group.column("v").combine_chunks(), width)
        out: list[tuple[int, int]] = []
        root = np.arange(len(ids))
        near = x @ x.T >= threshold
        for a in range(len(ids)):
            for b in np.flatnonzero(near[a, a + 1 :]) + a + 1:
                if root[a] != root[b]:
                    out.append((int(ids[a]), int(ids[b])))
                    root[root == root[b]] = root[a]
        one, two = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return sides.groupBy("i", "j").applyInArrow(step, "a long, b long").distinct()


def greedy_clusters(df: DataFrame, order: str, neighbours: int = 10, threshold: float = 0.85, id_column: str = "id", column: str = "embedding") -> DataFrame:
    """id, lead: each row in its turn (by ``order``, then id) leads those of its nearest ``neighbours`` that are similar and not taken yet.

    The neighbours are found in the cluster; the turns themselves follow one another and run over links only, in one
    task (a workspace's memories). Rows that lead nobody and are led by nobody have no row.
    """
    near = vector_search_many(df, df, neighbours, id_column, column).filter(F.col("score") >= threshold)
    place = df.select(F.col(id_column).cast("long").alias("query_id"), F.col(order).cast("string").alias("turn"))
    links = near.join(place, "query_id").select("turn", F.col("query_id").alias("a"), F.col("id").alias("b"), "rank").repartition(1).sortWithinPartitions("turn", "a", "rank")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if taken.get(a, a) == a and b not in taken:
                    taken[a] = taken[b] = a
        yield pa.RecordBatch.from_arrays([pa.array(list(taken), pa.int64()), pa.array(list(taken.values()), pa.int64())], names=["id", "lead"])

    return links.mapInArrow(step, "id long, lead long")


def clean_path(path: Column) -> Column:
    """Lower case, without doubled and trailing slashes and '.' steps; .agents/ counts as .agent/."""
    low = F.regexp_replace(F.regexp_replace(F.lower(path), r"/(\./)+", "/"), r"/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(low, r"(?<=.)/+$", ""), r"\.agents/", ".agent/")


def dedup(df: DataFrame) -> DataFrame:
    """First the best row of each document, then of equal contents the one with the shortest path; ties by score, then id."""
    first = Window.partitionBy("document_id").orderBy(F.desc("score"), "id")
    rows = df.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    short = Window.partitionBy(F.sha2("content", 256)).orderBy(F.length(clean_path(F.col("source_path"))), F.desc("score"), "id")
    return rows.withColumn("__r", F.row_number().over(short)).filter("__r = 1").drop("__r")


def code_boost(df: DataFrame, query: str, path_factor: float = 1.2, title_factor: float = 1.3) -> DataFrame:
    words = keywords(query)

    def any_in(column: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(column), F.lit(w))
        return hit

    factor = F.when(any_in("source_path"), path_factor).otherwise(1.0) * F.when(any_in("title"), title_factor).otherwise(1.0)
    return df.withColumn("score", F.col("score") * factor)


def extension_boost(df: DataFrame, code: float = 1.1, docs: float = 0.9) -> DataFrame:
    ext = F.lower(F.regexp_extract("source_path", r"(\.[^./]*)$", 1))
    return df.withColumn("score", F.col("score") * F.when(ext.isin(*CODE_EXTENSIONS), code).when(ext.isin(*DOC_EXTENSIONS), docs).otherwise(1.0))


def recency_boost(df: DataFrame, now: str, weight: float = 0.3, half_life_days: float = 180.0, few: bool = False) -> DataFrame:
    """(1 - weight) of the score over its maximum, and weight of a decay by age. Without weight or half-life nothing changes.

    The maximum is an aggregate of its own; of ``few`` rows it is a window over all of them, which reads them once.
    """
    if weight <= 0 or half_life_days <= 0:
        return df
    if few:
        with_most = df.withColumn("__most", F.max("score").over(Window.partitionBy(F.lit(0))))
    else:
        with_most = df.crossJoin(F.broadcast(df.select("score").agg(F.max("score").alias("__most"))))  # one row
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) / 86400.0)
    scaled = F.when(F.col("__most") > 0, F.col("score") / F.col("__most")).otherwise(F.col("score"))
    return with_most.withColumn("score", (1 - weight) * scaled + weight * F.exp(-math.log(2) * age / half_life_days)).drop("__most")


def entity_boost(df: DataFrame, entities: DataFrame, names: list[str], factor: float = 0.3) -> DataFrame:
    """Adds ``factor`` to rows that have any of the named entities."""
    hit = entities.filter(F.col("entity_name").isin(*names)).select(F.col("chunk_id").alias("id")).distinct().withColumn("__hit", F.lit(factor))
    return df.join(hit, "id", "left").withColumn("score", F.col("score") + F.coalesce("__hit", F.lit(0.0))).drop("__hit")


def importance_boost(df: DataFrame, scores: DataFrame, weight: float = 0.2) -> DataFrame:
    """score * (1 + importance * weight): by path::symbol, else by symbol, else 0.5; the symbol is in the path's query."""
    symbol = F.regexp_extract("source_path", r"[?&]symbol=([^&]*)", 1)
    path = F.regexp_extract("source_path", r"^([^?]*)", 1)
    one, two = (scores.select(F.col("node").alias(f"__n{i}"), F.col("score").alias(f"__s{i}")) for i in (1, 2))
    rows = df.withColumns({"__sym": symbol, "__full": F.concat(path, F.lit("::"), symbol)})
    rows = rows.join(one, (F.col("__full") == F.col("__n1")) & (F.col("__sym") != ""), "left").join(two, (F.col("__sym") == F.col("__n2")) & (F.col("__sym") != ""), "left")
    factor = 1 + F.coalesce("__s1", "__s2", F.lit(0.5)) * weight
    return rows.withColumn("score", F.col("score") * factor).select(*df.columns)


def snippet(content: Column, query: str, size: int) -> Column:
    """About ``size`` characters around the earliest word of the query, with … where text is cut; positions are characters."""
    low = F.lower(content)
    places = [F.instr(low, w) for w in query.lower().split()]
    hits = [F.when(p > 0, p) for p in places]
    at = F.least(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(None)
    start = F.greatest(at - 1 - size // 2, F.lit(0))
    cut_start, cut_end = start > 0, start + size < F.length(content)
    length = size - cut_start.cast("int") - cut_end.cast("int")
    window = F.concat(F.when(cut_start, "…").otherwise(""), F.substring(content, start + 1, length), F.when(cut_end, "…").otherwise(""))
    return F.when(F.length(content) <= size, content).when(at.isNull(), F.left(content, F.lit(size))).otherwise(window)


def best_of_documents(df: DataFrame, limit: int | None = None) -> DataFrame:
    first = Window.partitionBy("document_id").orderBy(F.desc("score"), "id")
    return page(df.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r"), [F.desc("score"), "id"], limit)


@dataclass(frozen=True)
class Boosts:
    """Settings of the chain after fusion; the fixed values are the ones that a search without settings has."""

    base_k: float = 60.0
    path: float = 1.2
    title: float = 1.3
    code: float = 1.1
    prose: float = 0.9
    recency: float = 0.3
    half_life_days: float = 180.0
    entity: float = 0.0
    importance: float = 0.0


def settled_legs(legs: dict[str, DataFrame], depth: int, base_k: float = 60.0) -> tuple[DataFrame, dict[str, list], float]:
    """(id, score, first leg and rank of the fused rows, the rows of each leg, k): each leg is run once, for its first ``depth`` rows.

    These few rows come to the driver, where ranks, k and fused scores are sums over two short lists.
    """
    spark = next(iter(legs.values())).sparkSession
    rows = {name: page(leg.select("id", "score"), [F.desc("score"), "id"], depth).collect() for name, leg in legs.items()}
    a, b = (*({r.id for r in own} for own in rows.values()), set())[:2]
    least = min(len(a), len(b))
    k = base_k if least < 3 else max(0.5 * base_k, min(2 * base_k, base_k * (1.5 - len(a & b) / least)))
    score: dict = {}
    first: dict = {}
    for name, own in rows.items():
        for rank, r in enumerate(own):
            score[r.id] = score.get(r.id, 0.0) + 1 / (k + rank + 1)
            first.setdefault(r.id, (name, rank))
    kind = next(iter(legs.values())).schema["id"].dataType.simpleString()
    fused = [(i, s, *first[i]) for i, s in score.items()]
    return spark.createDataFrame(fused, f"id {kind}, score double, leg string, leg_rank int").coalesce(1), rows, k


def hybrid(legs: dict[str, DataFrame], rows: DataFrame, query: str, now: str, k: int = 10, boosts: Boosts = Boosts(), entities: DataFrame | None = None, importance: DataFrame | None = None,
           rerank: Callable[[DataFrame], DataFrame] | None = None, size: int = 700, depth: int | None = None) -> DataFrame:
    """The whole chain over two legs (id, score) and the rows they name: fusion, duplicates, boosts, recency, rerank, cut, snippet.

    Each leg is cut to max(3k, 30) first and run once, so all that follows is small whatever the corpus: ``rows`` are
    looked up by the ids found, which reaches their scan. ``rows``: id, document_id, content, title, source_path,
    updated_at. ``rerank`` maps these rows with their scores to rows with new ones, as a model does.
    """
    fused, _, _ = settled_legs(legs, depth or max(3 * k, 30), boosts.base_k)
    return ranked_results(fused, rows, query, now, k, boosts, entities, importance, rerank, size)


def ranked_results(fused: DataFrame, rows: DataFrame, query: str, now: str, k: int, boosts: Boosts, entities: DataFrame | None, importance: DataFrame | None, rerank, size: int) -> DataFrame:
    ids = [r.id for r in fused.select("id").collect()]
    named = rows.select("id", "document_id", "content", "title", "source_path", "updated_at")
    found = named.filter(F.col("id").isin(ids) if ids else F.lit(False)).join(F.broadcast(fused), "id")  # the legs' rows
    found = extension_boost(code_boost(dedup(found), query, boosts.path, boosts.title), boosts.code, boosts.prose)
    found = recency_boost(found, now, boosts.recency, boosts.half_life_days, few=True)
    if entities is not None and boosts.entity > 0:
        found = entity_boost(found, entities, query_entities(query), boosts.entity)
    if importance is not None and boosts.importance > 0:
        found = importance_boost(found, importance, boosts.importance)
    if rerank is not None:
        found = rerank(page(found, [F.desc("score"), "id"], max(3 * k, 30)))
    return page(found, [F.desc("score"), "id"], k).withColumn("snippet", snippet(F.col("content"), query, size))


def explained(legs: dict[str, DataFrame], rows: DataFrame, query: str, now: str, k: int = 10, boosts: Boosts = Boosts()) -> dict[str, DataFrame | float]:
    """What a search is made of: the rows of each leg, k, the fused list and the final one."""
    fused, own, used = settled_legs(legs, max(3 * k, 30), boosts.base_k)
    spark, kind = rows.sparkSession, fused.schema["id"].dataType.simpleString()
    shown = {name: spark.createDataFrame([(r.id, r.score, n) for n, r in enumerate(part)], f"id {kind}, score double, rank int") for name, part in own.items()}
    return shown | {"k": used, "fused": fused, "results": ranked_results(fused, rows, query, now, k, boosts, None, None, None, 700)}
