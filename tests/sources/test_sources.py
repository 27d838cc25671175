"""Sources and sinks against values worked out by hand."""

import datetime
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, store, text
from tessera.sources import admission, feeds, harvest
from tessera.sources.sqlite import sqlite_table


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "s.db"
    con = sqlite3.connect(path)
    con.executescript(
        """
        CREATE TABLE project (id TEXT, worktree TEXT);
        CREATE TABLE session (id TEXT, title TEXT, time_created INTEGER, time_updated INTEGER, project_id TEXT, parent_id TEXT, more REAL);
        CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT);
        CREATE TABLE part (message_id TEXT, data TEXT);
        CREATE TABLE documents (source_path TEXT, title TEXT, content TEXT, tags TEXT, collection TEXT);
        CREATE TABLE fixed (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID;
        INSERT INTO fixed VALUES ('a', 1), ('b', NULL);
        INSERT INTO project VALUES ('p', '/w');
        INSERT INTO session VALUES ('s1', NULL, 1000, NULL, 'p', NULL, 1.5), ('s2', 't', 2500, 3000, 'gone', 's1', NULL), ('s3', 'u', NULL, NULL, NULL, NULL, NULL);
        INSERT INTO documents VALUES ('/a', 'A', 'x', '["t", "u"]', ''), ('/b', 'B', 'y', 'v, w', 'c'), ('/c', 'C', '', NULL, NULL), ('/d', 'D', 'z', NULL, NULL);
        """
    )
    con.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [("m2", "s1", 20, '{"role":"assistant"}'), ("m1", "s1", 10, "broken"), ("m3", "s1", 30, '{"role":"user"}')])
    con.executemany("INSERT INTO part VALUES (?, ?)", [("m1", '{"type":"text","text":"b"}'), ("m1", '{"type":"text","text":"a"}'), ("m2", '{"type":"tool","text":"no"}'), ("m2", '{"type":"text","text":"yes"}'), ("m3", '{"type":"text","text":"  "}'), ("m1", None), ("m1", "{")])
    con.commit()
    con.close()
    return str(path)


def test_sqlite_types_ranges_and_errors(spark, database):
    assert [(f.name, f.dataType.simpleString()) for f in sqlite_table(spark, database, "session").schema][2:] == [("time_created", "bigint"), ("time_updated", "bigint"), ("project_id", "string"), ("parent_id", "string"), ("more", "double")]
    rows = spark.read.format("sqlite").option("table", "part").option("rows", 2).schema("rowid long, message_id string").load(database)
    assert rows.rdd.getNumPartitions() == 4 and sorted(r.rowid for r in rows.collect()) == list(range(1, 8))
    assert [tuple(r) for r in sqlite_table(spark, database, "fixed").orderBy("k").collect()] == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="no table"):
        sqlite_table(spark, database, "missing").collect()
    with pytest.raises(Exception, match="no such column"):
        sqlite_table(spark, database, "part", "other string").collect()


def test_database_sessions(spark, database):
    rows = harvest.database_sessions(spark, database).collect()
    at = datetime.datetime(1970, 1, 1)
    assert [(r.id, r.title, r.worktree, r.parent_id) for r in rows] == [("s2", "t", "", "s1"), ("s1", "", "/w", ""), ("s3", "u", "", "")]
    assert rows[0].created_at == at + datetime.timedelta(seconds=2.5) and rows[1].updated_at == at + datetime.timedelta(seconds=1) and rows[2].created_at is None
    assert [r.id for r in harvest.database_sessions(spark, database, ["/w"]).collect()] == ["s1"]
    assert harvest.database_sessions(spark, database, []).count() == 0
    got = harvest.database_messages(spark, database).orderBy("turn")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got.collect()] == [("s1", 0, "unknown", "ba"), ("s1", 1, "assistant", "yes")]
    assert text.sessions(got).first().markdown == "## unknown\n\nba\n\n## assistant\n\nyes"


def test_older_documents(spark, database):
    rows = harvest.older_documents(spark, database, "w").orderBy("source_path").collect()
    assert [(r.source_path, r.tags, r.collection) for r in rows] == [("/a", ["t", "u"], "v1-import"), ("/b", ["v", "w"], "c"), ("/d", [], "v1-import")]


def test_tree(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    put("session/p 1/s1.json", {"id": "s1", "title": "T", "projectID": "p 1", "time": {"created": 1000}})
    put("session/p 1/bad.json", "{")
    put("session/p 1/none.json", {"title": "no id"})
    put("message/s1/b.json", {"id": "m1", "role": "user", "time": {"created": 5}})
    put("message/s1/a.json", {"id": "m2", "role": "assistant", "time": {"created": 7}})
    put("message/s1/c.json", {"id": "m3", "role": "system", "time": {"created": 1}})
    put("message/s1/d.json", {"id": "m4", "role": "user"})
    put("part/m1/x.json", {"id": "2", "type": "text", "text": "two"})
    put("part/m1/y.json", {"id": "1", "type": "text", "text": "one"})
    put("part/m2/x.json", {"id": "1", "type": "text", "text": "answer"})
    put("part/m2/note.txt", {"id": "0", "type": "text", "text": "no"})
    put("part/m3/x.json", {"id": "1", "type": "text", "text": "no"})
    assert [(r.id, r.title, r.project_id) for r in harvest.tree_sessions(spark, str(tmp_path)).collect()] == [("s1", "T", "p 1")]
    got = harvest.tree_messages(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [("s1", 0, "user", "one\n\ntwo"), ("s1", 1, "assistant", "answer")]


def test_commits_are_read_once(spark):
    commits = spark.createDataFrame([("aa", "2024-01-01"), ("bb", "2024-01-03"), ("cc", "2024-01-02")], "sha string, date string")
    docs = spark.createDataFrame([("w", "git://commit/aa"), ("v", "git://commit/bb"), ("w", None)], "workspace_hash string, source_path string")
    assert {r.sha for r in harvest.unseen_commits(commits, docs, "w").collect()} == {"bb", "cc"}
    assert [(r.content, r.source_path) for r in harvest.last_commit(commits, "w").collect()] == [("bb", "git://meta/last-commit")]
    assert harvest.last_commit(commits.limit(0), "w").count() == 0


@pytest.mark.parametrize("title, want", [("Fix: the Bug!", "fix-the-bug"), ("  ", "untitled-session"), (None, "untitled-session"), ("Größe", "gr-e"), ("a" * 79 + " b", "a" * 79), ("--x--", "x")])
def test_slug(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(harvest.slug(F.col("t"))).first()[0] == want


def test_summaries_are_written_once_and_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("s2", "w", "", "T", "two"), ("s1", "w", "", "T", "one"), ("s3", "w", "", "T", "one"), ("s4", "w", "My W", "U", "x")], "session_id string, workspace string, name string, title string, markdown string")
    rows = rows.withColumn("date", F.lit("2024-05-06").cast("date")).withColumn("source", F.lit("Git")).withColumn("path", harvest.summary_path("name", "workspace", "date", "source", "title"))
    for _ in range(2):
        harvest.write_summaries(rows, str(tmp_path))
        found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
        mark = rows.filter("session_id = 's2'").select(F.left(F.sha2("session_id", 256), F.lit(8))).first()[0]
        assert found == {"ws-w/2024-05-06--git-t.md": "one", f"ws-w/2024-05-06--git-t_{mark}.md": "two", "my-w/2024-05-06--git-u.md": "x"}


def test_retrieval_set_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A", "/a"), (2, "B", "/b"), (3, "A", "/c"), (4, " ", "/d")], "id long, title string, source_path string")
    harvest.write_retrieval_set(metrics.retrieval_set(docs, 10).withColumn("relevant_doc_ids", F.col("relevant_doc_ids").cast("array<string>")), str(tmp_path / "d"), "w", "v2")
    rows = harvest.read_retrieval_set(spark, str(tmp_path / "d")).collect()
    assert [(r.version, r.workspace_hash, r.query, r.relevant_doc_ids, r.relevant_source_paths, r.source_title) for r in rows] == [("v2", "w", "A", ["1", "3"], ["/a", "/c"], None), ("v2", "w", "B", ["2"], ["/b"], None)]


def test_admission(spark):
    paths = ["a.py", "b.md", "node_modules/x.py", "src/build/y.py", "go.sum", "x.lock", "src/gen/a.py", "src/gen/keep.py", "src/deep/gen/a.py", "logs/a.py", "src/logs/a.py", "tmp1.py", "src/a.test.py", "docs/v1/a.py", "a[1].py", None]
    files = spark.createDataFrame([(p,) for p in paths], "relative string")
    ignores = spark.createDataFrame([("", "# note\n\n/logs/\ntmp?.py\ndocs/**/a.py\na[[]1].py\n"), ("src", "gen/*\n!gen/keep.py\n")], "folder string, content string")
    got = {r.relative for r in admission.admitted(files, ["py"], ["*.test.py"], ignores).collect()}
    assert got == {"a.py", "src/gen/keep.py", "src/deep/gen/a.py", "src/logs/a.py", "a[1].py"}
    assert {r.relative for r in admission.admitted(files, None, ["src/*/a.py"]).collect()} >= {"b.md", "src/gen/keep.py", "src/deep/gen/a.py", "src/a.test.py"} - {None}
    assert "src/gen/a.py" not in {r.relative for r in admission.admitted(files, None, ["src/*/a.py"]).collect()}


@pytest.mark.parametrize("pattern, path, fits", [("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/a", "a", True), ("**/a", "x/y/a", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False), ("[x", "[x", True), ("a+(b)", "a+(b)", True), ("a?c", "a/c", False)])
def test_glob(spark, pattern, path, fits):
    row = spark.createDataFrame([(pattern, path)], "g string, p string").select(F.rlike("p", F.concat(F.lit("^"), admission.glob(F.col("g")), F.lit("$"))))
    assert row.first()[0] is fits


def test_scan_takes_ignores(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/c.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    ignores = spark.createDataFrame([("sub", "b.py")], "folder string, content string")
    assert sorted(r.path.rpartition("/")[2] for r in feeds.scan_files(spark, str(tmp_path), ignores=ignores).collect()) == ["a.py", "c.py"]


def test_paths_hit_by_their_ends(spark):
    returned = spark.createDataFrame([("q", "/x/a.py", 0), ("q", "/X/SRC/B.py", 1), ("q", "c\\src\\b.py", 2), ("q", "/xsrc/b.py", 3), ("r", "z", 0), ("t", "z", 0)], "query_id string, path string, rank int")
    relevant = spark.createDataFrame([("q", "src/b.py"), ("q", "b.py"), ("r", "y"), ("s", "z")], "query_id string, path string")
    got = {r.query_id: (r.hits, r.relevant, r.precision, r.recall, r.reciprocal_rank) for r in metrics.per_query_paths(returned, relevant, 3).collect()}
    assert got == {"q": (2, 2, pytest.approx(2 / 3), 1.0, 0.5), "r": (0, 1, 0.0, 0.0, 0.0), "s": (0, 1, 0.0, 0.0, 0.0), "t": (0, 0, 0.0, None, 0.0)}


def test_tags_of_documents(spark):
    docs = spark.createDataFrame([(1, "sessions", "see AB-1 and #7", ["x"]), (2, "sessions", "AB-1", ["ticket:C-1"]), (3, "other", "AB-1", []), (4, "sessions", None, None)], "id int, collection string, content string, tags array<string>")
    assert {r.id: r.tags for r in text.retagged(docs).collect()} == {1: ["x", "ticket:#7", "ticket:AB-1"], 2: ["ticket:C-1"], 3: [], 4: None}
    rows = spark.createDataFrame([(1, ["session"]), (2, ["topic"]), (3, None), (4, ["claude"])], "id int, tags array<string>")

    def model(df):
        return df.select("id", F.array(F.lit("b"), F.lit("a"), F.lit("summary")).alias("tags"), F.when(F.col("id") == 4, 0.1).otherwise(0.9).alias("confidence"))

    assert {r.id: r.tags for r in text.categorised(rows, model).collect()} == {1: ["a", "b", "session"], 2: ["topic"], 3: ["a", "b"], 4: ["claude"]}


def test_noise(spark):
    docs = spark.createDataFrame([("w", "/Dist/a"), ("w", "/a"), ("v", "/dist/a"), ("w", None)], "workspace_hash string, source_path string")
    edges = spark.createDataFrame([("w", "node_modules/dist/x"), ("w", "a"), ("w", "a"), ("w", "a")], "workspace_hash string, source_file string")
    assert {r.part: (r.edges, r.documents, r.share) for r in store.noise(docs, edges, "w").collect()} == {"node_modules": (1, 0, 0.25), "dist/": (1, 1, 0.25)}
    assert store.noise(docs.limit(0), edges.limit(0)).count() == 0
