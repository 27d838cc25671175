"""Stems by published examples; matching and cover density by hand; filters, relaxation and the hybrid chain."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.english import lexeme, stem
from tessera.operators import lexical as L
from tessera.operators import search as R


@pytest.mark.parametrize("words, want", [
    ("consign consigned consigning consignment", "consign"), ("caresses", "caress"), ("flies", "fli"), ("ties", "tie"), ("gas", "gas"), ("kiwis", "kiwi"), ("agreed", "agre"), ("hopping", "hop"), ("hoping hope hopes", "hope"),
    ("luxuriated", "luxuri"), ("cry cries", "cri"), ("by", "by"), ("say", "say"), ("relational", "relat"), ("conditional", "condit"), ("hopefulness", "hope"), ("generate generated", "generat"), ("generous generously", "generous"),
    ("replacement", "replac"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("apologies", "apolog"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("inning", "inning"), ("licensed licenses licensing license", "licens"),
])
def test_stems(words, want):
    for w in words.split():
        assert stem(w) == want
        assert w.startswith(L.prefix_of(want))


def test_queries():
    assert lexeme("The") is None and lexeme("Running") == "run"
    q = L.web_query('"state of the art" cats or Dogs -birds the')
    assert q.groups == ((((0, "state"), (3, "art")),), (((0, "cat"),), ((0, "dog"),))) and q.excluded == (((0, "bird"),),)
    assert L.web_query("the of").groups == () and L.any_query(["runs", "running", "the"]).groups == ((((0, "run"),),),)


def rows(spark, *texts):
    return spark.createDataFrame([(k, *(t if isinstance(t, tuple) else ("", t))) for k, t in enumerate(texts)], "id long, title string, content string")


def test_cover_density(spark):
    df = rows(spark, "cats like dogs", "cat dog", ("cat", "x dog"), "cat x x dog x cat", "cat", None, "a_cat-dog, bird")
    got = {r.id: r.score for r in L.search(df, L.web_query("cats dogs")).collect()}
    # One cover each; in row 3 two that share the dog; in row 2 the mean of a title and a content word.
    assert got == pytest.approx({0: 0.4 / 2, 1: 0.4, 2: (2 / (1 / 1.0 + 1 / 0.4)) / 2, 3: 0.4 / 3 + 0.4 / 2, 6: 0.4})
    assert {r.id for r in L.search(df, L.web_query('"cat dog" -birds')).collect()} == {1}
    assert {r.id: r.score for r in L.search(df, L.any_query(["dog", "bird"])).collect()}[6] == pytest.approx(0.8)
    assert L.search(df, L.web_query("the")).count() == 0 and L.search(df.limit(0), L.web_query("cat")).count() == 0
    phrase = {r.id: r.score for r in L.search(rows(spark, "state of an art, state of the art", "art state"), L.web_query('"state of the art"')).collect()}
    assert phrase == pytest.approx({0: 2 * 0.4 / 3})


def test_filters_and_relaxation(spark):
    docs = spark.createDataFrame([(1, "w", "Guide", "c", ["a"], "2024-01-02", "2024-01-01"), (2, "w", "x", "d", ["b"], "2024-03-01", "2024-02-01"), (3, "v", "x", "c", ["a"], "2024-01-02", "2024-01-01")], "id long, workspace_hash string, title string, collection string, tags array<string>, updated_at string, created_at string")
    chunks = spark.createDataFrame([(f"{d}:{k}", d, w, "install the tools" if k else "other", "symbol" if k else "raw") for d, w in ((1, "w"), (2, "w"), (3, "v")) for k in (0, 1)], "id string, document_id long, workspace_hash string, content string, chunk_type string")
    find = lambda text, **f: {r.id for r in L.search(L.filtered(chunks, docs, **f), L.web_query(text)).collect()}
    assert find("tool") == {"1:1", "2:1", "3:1"} and find("tool", workspace="w") == {"1:1", "2:1"} and find("tool", tags=["a", "z"]) == {"1:1", "3:1"}
    assert find("guide") == {"1:0", "1:1"} and find("guide", chunk_type="raw") == {"1:0"} and find("tool", collection="d") == {"2:1"}
    assert find("tool", updated=("2024-02-01", None)) == {"2:1"} and find("tool", created=(None, "2024-01-15")) == {"1:1", "3:1"}
    best, was = L.relaxed(L.filtered(chunks, docs), "install missing tools", 10)
    assert was and best.count() == 3
    best, was = L.relaxed(L.filtered(chunks, docs), "install the tools", 10)
    assert not was and best.count() == 3 and L.relaxed(L.filtered(chunks, docs), "missing tools", 10)[0].count() == 0


def test_hybrid_chain(spark):
    data = [(k, k % 4, f"text {k}", "t", f"/p{k}.py" if k % 2 else f"/p{k}.md", "2024-01-01 00:00:00") for k in range(8)]
    df = spark.createDataFrame(data, "id long, document_id long, content string, title string, source_path string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    leg = lambda *ids: spark.createDataFrame([(i, 1.0 - n / 10) for n, i in enumerate(ids)], "id long, score double")
    legs = {"lexical": leg(1, 2, 3), "vector": leg(3, 1, 5, 6)}
    fused, _, k = R.settled_legs(legs, 30)
    assert k == pytest.approx(60 * (1.5 - 2 / 3)) and {r.id: (r.leg, r.leg_rank) for r in fused.collect()}[5] == ("vector", 2)
    got = [r.id for r in R.hybrid(legs, df, "q", "2024-02-01 00:00:00", 3).collect()]
    assert got == [1, 3, 2]
    entities = spark.createDataFrame([(2, "widget")], "chunk_id long, entity_name string")
    assert R.hybrid(legs, df, "the Widget", "2024-02-01 00:00:00", 3, R.Boosts(entity=5.0), entities).first().id == 2
    assert R.hybrid(legs, df, "q", "2024-02-01 00:00:00", 3, rerank=lambda d: d.withColumn("score", -F.col("id").cast("double"))).first().id == 1
    parts = R.explained(legs, df, "q", "2024-02-01 00:00:00", 3)
    assert parts["lexical"].count() == 3 and parts["vector"].count() == 4 and parts["k"] == k and parts["results"].count() == 3
    assert R.hybrid({"lexical": leg(1).limit(0), "vector": leg(1).limit(0)}, df, "q", "2024-02-01 00:00:00").count() == 0


def test_vectors_without_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.1]), (6, [1.0, None])], "id long, embedding array<double>")
    assert [r.id for r in R.vector_search(df, [1.0, 0.0], 9).collect()] == [1, 5]
    assert {(r.query_id, r.id) for r in R.vector_search_many(df, df, 3).collect()} == {(1, 5), (5, 1)}
    assert {r.id: r.root for r in R.vector_clusters(df, 0.9).collect()} == {1: 1, 5: 1} == {r.id: r.root for r in R.vector_clusters(df, 0.9, exact=True).collect()}
    line = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(8)], "id long, embedding array<double>")
    got = {r.id: r.lead for r in R.greedy_clusters(line, "id", 3, 0.98).collect()}
    assert [got[k] for k in range(5)] == [0, 0, 0, 3, 3]  # 0 leads the two that are near, then it is the turn of 3
    exact = {r.id: r.root for r in R.vector_clusters(line, 0.99, exact=True).collect()}
    assert exact == dict.fromkeys(range(8), 0)
