"""Operators against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import merging, metrics, search, store, text
from tessera.sources import feeds as sources
from tessera.streaming import feeds


def leg(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, rank long")


def test_rank_fusion(spark):
    rows = search.rrf([leg(spark, "ab"), leg(spark, "cd")]).orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in rows] == ["a", "c", "b", "d"] and rows[0].score == pytest.approx(1 / 61)
    both = search.rrf([leg(spark, "a"), leg(spark, "a")]).collect()
    assert len(both) == 1 and both[0].score == pytest.approx(2 / 61)


@pytest.mark.parametrize("a, b, want", [("abcde", "abcfg", 54.0), ("abcde", "fghij", 90.0), ("ab", "abcde", 60.0), ("abc", "abc", 30.0)])
def test_dynamic_k(spark, a, b, want):
    assert search.dynamic_k(leg(spark, a), leg(spark, b)).first().k == pytest.approx(want)


def test_recency(spark):
    df = spark.sql("SELECT * FROM VALUES ('old', 1.0D, timestamp_ntz'2023-06-01'), ('new', 1.0D, timestamp_ntz'2024-01-01'), ('now', 1.0D, timestamp_ntz'2024-02-01') AS t(id, score, updated_at)")
    got = {r.id: r.score for r in search.recency_boost(df, "2024-02-01 00:00:00", 0.5).collect()}
    assert got["now"] == pytest.approx(1.0) and got["old"] < got["new"] < got["now"]
    assert got["new"] == pytest.approx(0.5 + 0.5 * math.exp(-math.log(2) * 31 / 180))
    assert search.recency_boost(df, "2024-02-01 00:00:00", 0) is df


def test_boosts_and_dedup(spark):
    df = spark.createDataFrame([("1", "d1", "same", "/src/auth.go", "Auth guide", 1.0), ("2", "d1", "other", "/src/auth.go", "x", 0.5), ("3", "d2", "same", "/a.md", "y", 2.0)], "id string, document_id string, content string, source_path string, title string, score double")
    got = {r.id: r.score for r in search.code_boost(df, "where is auth").collect()}
    assert got == pytest.approx({"1": 1.56, "2": 0.6, "3": 2.0})
    assert {r.id: r.score for r in search.extension_boost(df).collect()} == pytest.approx({"1": 1.1, "2": 0.55, "3": 1.8})
    assert [r.id for r in search.dedup(df).collect()] == ["3"]
    assert [r.id for r in search.best_of_documents(df).collect()] == ["3", "1"]
    scores = spark.createDataFrame([("/p.go::f", 0.9), ("g", 0.1)], "node string, score double")
    rows = spark.createDataFrame([("a", "/p.go?symbol=f&kind=x", 1.0), ("b", "/q.go?symbol=g", 1.0), ("c", "/q.go", 1.0)], "id string, source_path string, score double")
    assert {r.id: r.score for r in search.importance_boost(rows, scores, 0.2).collect()} == pytest.approx({"a": 1.18, "b": 1.02, "c": 1.1})


@pytest.mark.parametrize("n", [2, 3, 6, 7, 63])
def test_equal_vectors_have_equal_scores_wherever_they_lie(spark, n):
    rng = np.random.default_rng(5)
    goal, kinds = rng.normal(size=64).tolist(), rng.normal(size=(20, 64)).tolist()
    rows = spark.createDataFrame([(k * 100 + i, kinds[k]) for i in range(n) for k in range(20)] + [(-1, kinds[0])], "id long, embedding array<double>").coalesce(1)
    got = search.vector_search(rows, goal, None).collect()
    found = {}
    for r in got:
        found.setdefault(max(r.id, 0) // 100, []).append(r)
    for k, own in found.items():
        assert len({r.score for r in own}) == 1 and [r.id for r in own] == sorted(r.id for r in own)
        dot, a, b = 0.0, 0.0, 0.0
        for x, y in zip(kinds[k], goal, strict=True):
            dot, a, b = dot + x * y, a + x * x, b + y * y
        assert own[0].score == dot / math.sqrt(a * b)
    assert len(got) == 20 * n + 1


def test_vectors_of_very_small_and_large_numbers(spark):
    rows = spark.createDataFrame([(1, [3e-120, 4e-120]), (2, [4e120, 3e120]), (3, [0.0, 0.0]), (4, [1.0, float("nan")])], "id long, embedding array<double>")
    for goal in ([1e-120, 0.0], [1e120, 0.0]):
        assert [(r.id, round(r.score, 9)) for r in search.vector_search(rows, goal, None).collect()] == [(2, 0.8), (1, 0.6)]


def test_snippet(spark):
    df = spark.createDataFrame([("short",), ("x" * 50 + " needle " + "y" * 50,), ("z" * 100,)], "c string")
    a, b, c = (r.s for r in df.select(search.snippet(F.col("c"), "needle none", 20).alias("s")).collect())
    assert a == "short" and "needle"[:5] in b and b[0] == b[-1] == "…" and len(b) == 20 and c == "z" * 20


def test_cover_density(spark):
    df = spark.createDataFrame([(1, "a b", ""), (2, "", "a b"), (3, "", "a x x x b"), (4, "a", "c")], "id long, title string, content string")
    got = {r.id: r.score for r in search.cover_density(df, ["a", "b"]).collect()}
    assert set(got) == {1, 2, 3} and got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.4) and got[3] == pytest.approx(0.1)


def test_metrics(spark):
    returned = spark.createDataFrame([("q", f"r{k}", k) for k in range(5)], "query_id string, id string, rank long")
    relevant = spark.createDataFrame([("q", x) for x in ("r0", "r2", "r4", "zz")] + [("none", "a")], "query_id string, id string")
    got = {r.query_id: r for r in metrics.per_query(returned, relevant, 5).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].reciprocal_rank) == (0.6, 0.75, 1.0) and got["none"].reciprocal_rank == 0
    nums = spark.range(1, 21)
    assert metrics.percentiles(nums, "id", {"p": 0.95}).first().p == 19
    assert not metrics.regressions({"precision": 0.5, "p95_ms": 10}, {"precision": 0.4, "p95_ms": 20})
    assert set(metrics.regressions({"precision": 0.5, "p95_ms": 10}, {"precision": 0.39, "p95_ms": 20.1})) == {"precision", "p95_ms"}
    paths = spark.createDataFrame([("/a/B.go", "b.go"), ("/a/xb.go", "b.go")], "x string, y string")
    assert [r.h for r in paths.select(metrics.path_hit("x", "y").alias("h")).collect()] == [True, False]


def edges(spark, rows):
    return spark.createDataFrame([("w", *r) for r in rows], "workspace_hash string, source_node string, target_node string, edge_type string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_walks(spark):
    e = edges(spark, [("f::a", "f::b", "calls"), ("f::b", "f::c", "calls"), ("f::c", "f::a", "calls"), ("f::a", "f::d", "imports"), ("g::x", "b", "calls"), ("f::a", "f::c", "imports")])
    got = {r.node: (r.depth, r.via) for r in G.trace(e, nodes(spark, "f::a")).collect()}
    assert got == {"f::a": (0, None), "f::b": (1, "f::a"), "f::c": (2, "f::b")}
    assert {r.node for r in G.impact(e, nodes(spark, "f::b"), 1).collect()} == {"f::b", "f::a", "g::x"}
    near, between = G.neighbourhood(e, nodes(spark, "f::a"), 1, "out")
    assert {r.node for r in near.collect()} == {"f::a", "f::b", "f::c", "f::d"} and between.count() == 5
    with pytest.raises(ValueError):
        G.neighbourhood(e, nodes(spark, "f::a"), 6)
    assert G.trace(e.limit(0), nodes(spark, "f::a")).count() == 1


def test_pagerank(spark):
    e = edges(spark, [("a", "c", "calls"), ("b", "c", "calls"), ("b", "c", "calls"), ("c", "a", "calls")])
    got = {r.node: r.score for r in G.pagerank(e).collect()}
    assert got["c"] == 1.0 and got["b"] < got["a"] < 1.0
    assert G.pagerank(e.limit(0)).count() == 0


def test_stitch(spark):
    topics = spark.createDataFrame([("t", "p", "w" * 20), ("<var:x", "p", "w")], "topic string, node string, workspace_hash string")
    assert [tuple(r) for r in G.stitch(topics, topics.withColumn("node", F.lit("ON t"))).collect()] == [("t", "p", "w" * 8, "ON t", "w" * 8)]


def test_nearest_definition(spark):
    uses = spark.createDataFrame([(1, "/a/b/u.go", "f"), (2, "/c/u.go", "f"), (3, "/x/u.go", "none")], "use_id int, path string, symbol string")
    defs = spark.createDataFrame([("/a/b/d.go", "f", "near"), ("/a/d.go", "f", "far"), ("/q/d.go", "f", "other")], "path string, symbol string, target string")
    assert {r.use_id: r.target for r in G.nearest_definition(uses, defs).collect()} == {1: "near", 2: None, 3: None}


def test_chunker(spark):
    doc = "# One\n" + "word " * 300 + "\n## Two\n" + ("line of text\n" * 200) + "```\n" + "code\n" * 100 + "```\nend\n"
    made = text.split_text(doc)
    assert [m[0] for m in made] == list(range(len(made))) and made[0][1] == 1 and made[-1][2] == len(doc.splitlines())
    assert all(m[3].strip() and len(m[3].encode()) <= 3300 for m in made) and all(a[1] < b[1] for a, b in zip(made, made[1:], strict=False))
    assert text.split_text("") == [] and text.split_text("  \n") == [] and text.split_text("x") == [(0, 1, 1, "x")]
    long = text.split_text("é" * 9000)
    assert "".join(m[3] for m in long).count("é") >= 9000 and all(len(m[3].encode()) <= 3200 for m in long)
    rows = text.chunk(spark.createDataFrame([(1, doc), (2, None)], "id long, content string")).collect()
    assert len(rows) == len(made)


def test_text_steps(spark):
    df = spark.createDataFrame([(1, "Fix DEV-12 and dev-3, see #9, UTF-8.\nDecision: use X\n## Lessons learned\nbe kind\nalways\n# Next\nLESSON: test")], "id long, content string")
    row = df.select(text.tickets(F.col("content")).alias("t"), text.semantic_tags(F.lit(None), F.col("content")).alias("s"), text.entities(F.lit("getUserName x1 THE"), 3, ("the",)).alias("e")).first()
    assert row.t == ["#9", "DEV-12"] and row.s == ["bug-fix"] and set(row.e) == {"getusername", "get", "user", "name"}
    assert {(r.kind, r.memory) for r in text.memories(df).collect()} == {("decision", "use X"), ("lesson", "test"), ("lesson", "be kind\nalways")}
    links = text.wikilinks(spark.createDataFrame([(1, "a [[One]] \\[[no]] [[two\nx]] [[b c]]")], "id long, content string"))
    assert [r.target for r in links.orderBy("place").collect()] == ["One", "b c"]
    found = text.resolve_links(links, spark.createDataFrame([(7, "one"), (5, "ONE")], "id long, title string")).orderBy("place").collect()
    assert found[0].target_id == 5 and found[0].candidates == [5, 7] and found[1].target_id is None
    cut = spark.createDataFrame([("é" * 2000,), ("a" * 3000,)], "c string").select(text.embed_text(F.col("c")).alias("c")).collect()
    assert [len(r.c) for r in cut] == [1500, 3000]


def test_sessions_and_strip(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.markdown for r in text.sessions(rows).collect()}
    assert got == {1: "## user\n\na\n\n## assistant\n\nb", 2: "## unknown\n\n"}
    raw = "k " + "A" * 120 + "\n```py\n" + "x = 1\n" * 25 + "```\n# system\nsecret\n# user\nError: no\nError: no\nok"
    out = spark.createDataFrame([(raw,)], "t string").select(text.strip_session(F.col("t")).alias("t")).first().t
    assert out == "k [base64 data]\n[code block]\n# user\nError: no (repeated)\nok"


def test_classify_files(spark):
    old = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], "path string, size int, mtime int, hash string")
    new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, "h"), ("c", 2, 2, "x"), ("e", 1, 1, "h")], "path string, size int, mtime int, hash string")
    assert {r.path: r.state for r in text.classify_files(old, new).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "deleted", "e": "new"}
    assert {r.state for r in text.classify_files(old, new.limit(0)).collect()} == {"unchanged"}


def test_best_prefix(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    assert [tuple(r) for r in text.best_prefix(paths, spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/cc",)], "prefix string")).collect()] == [("/a/b/c", "/a/b")]


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", None)], "id int, v string, w string")
    got = sorted(tuple(r) for r in merging.upsert(old, new, ["id"], {"w": lambda o, n: F.coalesce(n, o)}).collect())
    assert got == [(1, "a", None), (2, "B", "k"), (3, "c", None)]
    assert merging.where(old, id=None, v="") is old
    assert merging.delete_where(old, F.col("w") == "k").count() == 1


def test_workspaces_stay_apart(spark):
    """No statement with a workspace returns another one's rows."""
    docs = spark.createDataFrame([(k, w, f"t{k}", f"/p{k}", "c", [w]) for k, w in enumerate("aabbc")], "id int, workspace_hash string, title string, source_path string, collection string, tags array<string>")
    assert {r.tag for r in store.tag_counts(docs, "a").collect()} == {"a"}
    ws = spark.createDataFrame([("ab" * 32, "One"), ("ac" * 32, "Two")], "hash string, name string")
    assert store.resolve_workspace(ws, "one").count() == 1 and store.resolve_workspace(ws, "ab" * 4).count() == 1 and store.resolve_workspace(ws, "ab" * 32).count() == 1
    twin = ws.union(spark.createDataFrame([("ab" * 31 + "cc", "Three")], "hash string, name string"))
    with pytest.raises(ValueError):
        store.resolve_workspace(twin, "ab" * 4)


def test_sources(spark, tmp_path):
    (tmp_path / "t/node_modules").mkdir(parents=True)
    for name, body in (("a.py", b"x"), ("b.png", b"x"), ("go.sum", b"x"), ("bad.py", b"\xff\xfe"), ("node_modules/c.py", b"x"), ("d.md", b"y")):
        (tmp_path / "t" / name).write_bytes(body)
    got = sources.scan_files(spark, str(tmp_path / "t")).collect()
    assert sorted(r.path.rpartition("/")[2] for r in got) == ["a.py", "d.md"]
    (tmp_path / "s.jsonl").write_text('{"sessionId":"s","type":"user","timestamp":"1","message":{"role":"user","content":"hi"}}\nbroken\n{"sessionId":"s","timestamp":"2"}\n{"sessionId":"s","type":"x","timestamp":"3","message":{"content":[{"type":"text","text":"yo"},{"type":"tool"}]}}\n')
    assert [(r.turn, r.role, r.text) for r in sources.session_lines(spark, str(tmp_path / "s.jsonl")).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "unknown", "yo")]
    log = spark.createDataFrame([("\x1eabcdef1\x1fAnn\x1fa@b\x1f2024\x1fs\x1fb\x1eabcdef2\x1fdependabot[bot]\x1fx\x1f2024\x1fs\x1fb",)], "value string")
    assert [r.author for r in sources.commit_log(log).collect()] == ["Ann"]


def test_embedding_queue(spark):
    chunks = spark.createDataFrame([("a", "x", "pending", 0, 1), ("b", "y", "pending", 2, 2), ("c", "z", "embedded", 0, 3)], "id string, content string, embed_status string, attempts int, created_at int")
    done = feeds.embed_pending(chunks, lambda d: d.withColumn("ok", F.col("id") == "a"))
    assert {r.id: (r.embed_status, r.attempts) for r in done.collect()} == {"a": ("embedded", 0), "b": ("embed_failed", 3), "c": ("embedded", 0)}
    hard = feeds.embed_pending(chunks, lambda d: d.withColumn("ok", F.lit(None).cast("boolean")))
    assert {r.id: r.embed_status for r in hard.collect()} == {"a": "embed_failed", "b": "embed_failed", "c": "embedded"}
    timed = chunks.withColumn("tried_at", F.when(F.col("id") == "b", F.expr("timestamp_ntz'2024-01-01 00:00:00'")))
    for at, want in (("2024-01-01 00:00:01", 2), ("2024-01-01 00:00:02", 3)):
        again = feeds.embed_pending(timed, lambda d: d.withColumn("ok", F.lit(False)), now=at)
        assert {r.id: r.attempts for r in again.collect()}["b"] == want
    jobs = spark.sql("SELECT * FROM VALUES ('a', 60, timestamp_ntz'2024-01-01 00:00:00'), ('b', 3600, timestamp_ntz'2024-01-01 00:00:00'), ('c', 1, null) AS t(name, every_seconds, last_run)")
    assert {r.name for r in feeds.due(jobs, "2024-01-01 00:01:00").collect()} == {"a", "c"}


def test_incremental_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    merge = lambda old, new: new if old is None else merging.upsert(old, new, ["id"])
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "A"), (2, "B"), (3, "c")])):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, v string").parquet(src)
        feeds.ingest(stream, out, str(tmp_path / "cp"), merge, order=["v"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/v=1").collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_fold_of_three_legs(spark):
    a, b, c = leg(spark, "xyz"), leg(spark, "yzw"), leg(spark, "wvu")
    got = {r.id: r.leg for r in search.fold([a, b, c]).collect()}
    assert got == {"x": 0, "y": 0, "z": 0, "w": 1, "v": 2, "u": 2}


def test_vector_clusters(spark):
    import random

    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(k * 10 + j, [x + r.gauss(0, 0.05) for x in v]) for k, v in enumerate(base) for j in range(4)]
    got = {x.id: x.root for x in search.vector_clusters(spark.createDataFrame(rows, "id long, embedding array<double>")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (100, 102)], "a long, b long")
    got = {r.id: r.root for r in G.components(chain).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in (100, 101, 102)}
    assert G.components(chain.limit(0)).count() == 0


def test_retrieval_set_and_batches(spark):
    docs = spark.createDataFrame([(1, "a", "/1"), (2, "a ", "/2"), (3, "", "/3"), (4, "b", "/4")], "id long, title string, source_path string")
    got = {r.query: r.relevant_doc_ids for r in metrics.retrieval_set(docs, 5).collect()}
    assert got == {"a": [1, 2], "b": [4]}
    rows = spark.createDataFrame([("w", k, "x" * 8) for k in range(31)] + [("w", 99, "l\n" * 600)], "workspace_hash string, id long, content string")
    sizes = {(r.batch, r.tokens): r["count"] for r in text.summary_batches(rows).groupBy("batch", "tokens").count().collect()}
    assert sizes == {("batch-0", 150 + 30 * 27): 30, ("batch-1", 177): 1, ("long-0", 150 + 25 + 300): 1}
    parts = spark.createDataFrame([("k", p, f"t{p}") for p in range(25)], "key string, place long, text string")
    assert text.fold_summaries(parts, lambda d: d.withColumn("text", F.upper("text"))).first().summary == "\n".join(f"T{p}" for p in range(25))
