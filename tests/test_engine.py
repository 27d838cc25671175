"""The class over the store's tables, on a small store written here."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera import engine as N
from tessera.operators.search import Boosts

NOW = datetime(2024, 2, 1, 12, tzinfo=UTC)


@pytest.fixture(scope="module")
def store(spark):
    docs = [
        (1, "w", "Auth guide", "login with tokens\nline two\nline three", "/g.md", "docs", ["a"], "{}", "2024-01-30", None),
        (2, "w", "helper", "def helper()", "/h.py?symbol=helper&kind=function", "code", ["b"], '{"source_type":"symbol","kind":"function","start_line":"2","end_line":"3"}', "2024-01-01", None),
        (3, "w", "h.py", "import x\ndef helper():\n  return 1\n# end", "/h.py", "code", ["b"], "{}", "2024-01-01", None),
        (4, "v", "Other", "login elsewhere [[Auth guide]]", "/o.md", "sessions", ["ticket:DEV-1"], "{}", "2024-01-20", None),
    ]
    documents = spark.createDataFrame(docs, "id long, workspace_hash string, title string, content string, source_path string, collection string, tags array<string>, metadata string, updated_at string, supersedes_id long").withColumn("content_hash", F.sha2("content", 256))
    documents = documents.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")).withColumn("created_at", F.col("updated_at"))
    chunks = documents.select(F.concat_ws(":", "id", F.lit(0)).alias("id"), F.col("id").alias("document_id"), "workspace_hash", F.lit(0).cast("long").alias("chunk_index"), "content", F.sha2("content", 256).alias("content_hash"), F.lit("embedded").alias("embed_status"), F.when(F.col("id") == 2, "symbol").otherwise("raw").alias("chunk_type"), "created_at")
    embeddings = spark.createDataFrame([("1:0", [1.0, 0.0]), ("2:0", [0.0, 1.0]), ("4:0", [0.9, 0.1])], "chunk_id string, embedding array<double>")
    edges = spark.createDataFrame([("w", "GET /l", "login", "http", "r.py"), ("w", "h.py::login", "helper", "calls", "h.py"), ("w", "h.py::login", "PUBLISH t", "integration", "h.py"), ("v", "o.py::on_t", "CONSUME t", "integration", "o.py")], "workspace_hash string, source_node string, target_node string, edge_type string, source_file string")
    workspaces = spark.createDataFrame([("w", "One", "/home/one"), ("v", "Two", "/home/one/two/")], "hash string, name string, path string")
    collections = documents.select(F.col("collection").alias("name"), "workspace_hash").distinct()
    return {"documents": documents, "chunks": chunks, "embeddings": embeddings, "edges": edges, "workspaces": workspaces, "collections": collections}


def engine(store, **more):
    return N.Engine(store, embed=lambda text: [1.0, 0.0], now=lambda: NOW, **more)


def test_searches(store):
    e = engine(store)
    assert [r.document_id for r in e.search("logins", "w").collect()] == [1] and {r.document_id for r in e.search("logins").collect()} == {1, 4}
    assert e.search("login missing", "w").count() == 1 and e.search("login missing", "w", tags=["a"]).count() == 0
    assert e.search("login", chunk_type="symbol").count() == 0 and e.search("login", fields="title, nothing").columns == ["id", "title"]
    with pytest.raises(ValueError):
        e.search("login", chunk_type="text")
    assert [r.document_id for r in e.vsearch("login", "w", 1).collect()] == [1] and {r.document_id for r in e.vsearch([0.0, 1.0], k=1).collect()} == {2}
    assert N.clamp(None, 20, 100) == 20 and N.clamp(-1, 20, 100) == 20 and N.clamp(500, 20, 100) == 100
    calls = []
    memory = N.Memory(lambda t: calls.append(t) or [1.0], 2)
    assert [memory(t) for t in "aabca"] and calls == ["a", "b", "c", "a"]


def test_query_pages_and_failures(store):
    e = engine(store)
    first, cursor = e.query("login", k=1)
    second, last = e.query("login", k=1, cursor=cursor)
    assert first.first().document_id == 1 and second.first().document_id == 4 and cursor
    with pytest.raises(ValueError):
        e.query("other", k=1, cursor=cursor)
    assert {r.document_id for r in e.query("login last 3 days")[0].collect()} == {1}
    assert {r.document_id for r in e.query("login", updated=("20d", None), created=(None, "2024-01-25T00:00:00Z"))[0].collect()} == {4}

    def broken(_):
        raise OSError("no model")

    assert e.query("login", "w")[0].count() == N.Engine(store, embed=broken, rewrite=broken, rerank=broken, now=lambda: NOW).query("login", "w")[0].count() + 1
    only = N.Engine({k: v for k, v in store.items() if k != "chunks"}, now=lambda: NOW)
    with pytest.raises((RuntimeError, AttributeError)):
        only.query("login")
    entities = store["chunks"].select(F.col("id").alias("chunk_id"), F.lit("other").alias("entity_name")).filter("chunk_id = '2:0'")
    boosted = N.Engine(store | {"entities": entities}, embed=lambda t: [1.0, 0.0], now=lambda: NOW, boosts=Boosts(entity=9.0))
    assert boosted.query("login other", "w")[0].first().document_id == 2


def test_documents(store):
    e = engine(store)
    one = lambda *a, **k: [(r.id, r.content) for r in e.get(*a, **k).collect()]
    assert one("/g.md", "w", 2, 3) == [(1, "line two\nline three")] and one("/g.md", "w", 3) == [(1, "line three")] and one("/g.md", "w", 0, 1) == [(1, "login with tokens")]
    assert one("#1", "w")[0][0] == one("1:0", "w")[0][0] == 1 and one("#1", "v") == [] and one("/none", "w") == []
    assert one("/h.py::helper", "w") == [(2, "def helper():\n  return 1")] and one("/h.py::helper", "w", 4, 4) == [(2, "# end")]
    found, missed = e.multi_get(["/h.py", "nothing", "1", "/h.py"], "w")
    assert [(r.key, r.id) for r in found.collect()] == [("/h.py", 3), ("1", 1)] and [r.key for r in missed.collect()] == ["nothing"]
    assert [r.id for r in e.listed("w", ["b"]).collect()] == [2, 3] and [r.id for r in e.ticket("dev-1").collect()] == [4] and [r.id for r in e.symbols("w", "HELP").collect()] == [2]
    left = e.delete("/g.md", "w")
    assert left["documents"].count() == 3 and left["chunks"].count() == 3 and {r.chunk_id for r in left["embeddings"].collect()} == {"2:0", "4:0"}


def test_write(spark, store):
    e = engine(store)
    new = store["documents"].filter("id = 1").withColumn("content", F.lit("new text, see [[Other]] and [[none]]")).unionByName(store["documents"].filter("id = 3").withColumn("id", F.lit(9).cast("long")).withColumn("source_path", F.lit(None).cast("string")))
    made = e.write(new)
    docs = {r.id: r.content for r in made["documents"].collect()}
    assert docs[1].startswith("new text") and 9 in docs and len(docs) == 5
    mine = {(r.document_id, r.embed_status) for r in made["chunks"].collect()}
    assert (1, "pending") in mine and (1, "embedded") not in mine and (9, "pending") in mine and (4, "embedded") in mine
    assert {(r.source_node, r.target_node) for r in made["edges"].filter("edge_type = 'references'").collect()} == {("1", "4"), ("1", "none")}


def test_workspaces_and_graph(store):
    e = engine(store)
    parts = e.wake_up("w")
    assert parts["stats"].first().documents == 3 and parts["chunks"].first().chunks == 3 and "# w" in e.briefing("w")
    assert {(r.section, r.name): r.n for r in e.dashboard("w").collect()}["embeddings", "all"] == 2
    assert [r.hash for r in e.resolve("/home/one/two/x").collect()] == ["v"] and [r.hash for r in e.resolve("/home/one/three").collect()] == ["w"] and e.resolve("/else").count() == 0 and e.resolve("two").count() == 1
    left = e.remove("w")
    assert {n: df.count() for n, df in left.items()} == {"documents": 1, "chunks": 1, "edges": 1, "collections": 1, "workspaces": 1, "embeddings": 1}
    assert e.reset("w")["workspaces"].count() == 2
    nodes, drawn = e.flow("/l", "w")
    assert {"login", "helper", "PUBLISH t", "o.py::on_t"} <= {r.node for r in nodes.collect()} and drawn.filter("edge_type = 'stitch'").count() == 1
    assert e.graph("h.py::login", workspace="w").count() == 2 and {r.node for r in e.impact("helper", "w").collect()} == {"helper", "h.py::login"} and e.trace("login", "w").count() == 2


def test_chunks_of_files(spark):
    from tessera.operators import text as X

    files = spark.createDataFrame([("a.py", "import x\n\ndef f():\n  pass\nclass B:\n" + "  y = 1\n" * 2000), ("b.md", "# T\ntext\n"), ("c.py", "x = 1\n"), ("d.py", None)], "path string, content string")
    names = spark.createDataFrame([("a.py", "f", 3), ("a.py", "B", 5)], "path string, symbol string, line long")
    got = X.chunk_files(files, names).orderBy("path", "chunk_index").collect()
    mine = [(r.symbol_name, r.start_line) for r in got if r.path == "a.py"]
    assert mine[:3] == [(None, 1), ("f", 3), ("B", 5)] and len(mine) > 4 and all(n == "B" for n, _ in mine[2:])
    assert [(r.path, r.chunk_type) for r in got if r.path != "a.py"] == [("b.md", "raw"), ("c.py", "raw")]
