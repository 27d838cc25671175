"""Registered queries against their DuckDB SQL on the smallest tables, and the driver's entry points."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "search_keyword", "search_websearch", "search_bm25", "rank_fusion", "rank_dedup", "graph_trace", "graph_impact", "text_tickets", "text_sessions", "metric_per_query", "vector_search_many",
    "stream_event_counts", "sql_upsert_document", "sql_upsert_chunk", "sql_get_unsummarized_symbols", "sql_list_workspaces_with_stats", "sql_get_incoming_edges",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def test_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and set(catalog.queries()) <= set(known)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "score"]


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    plan = catalog.queries()["sql_count_chunks_by_document_id"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan.split("ReadSchema")[1]
    plan = catalog.queries()["sql_get_document_by_id"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan


def test_sessions_count_all_events_of_many_files_out_of_order(spark, tmp_path):
    """More files than two triggers take, the latest day first (a watermark drops rows from the third on)."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans.analytics import ANALYTICS

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(203):
        day = datetime.datetime(2024, 6, 30) - datetime.timedelta(days=k)
        path = folder / f"part-{k:03}.parquet"
        pq.write_table(pa.table({"event_id": [2 * k, 2 * k + 1], "user_id": [1, 1], "ts": pa.array([day, day + datetime.timedelta(minutes=5)], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    got = ANALYTICS["stream_user_sessions"][0](SimpleNamespace(spark=spark, folder=str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [(1, 203, 406)]


def test_sessions_stay_with_the_executors(spark, tmp_path):
    """Sessions whose rows exceed what the driver may hold (a sink in its memory fails); older batches and the state are gone."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans.analytics import ANALYTICS
    from tessera.streaming import feeds

    folder, n = tmp_path / "events.parquet", 20_000
    folder.mkdir()
    for k in range(2):
        at = [datetime.datetime(2024, 1, 1 + k) + datetime.timedelta(microseconds=i * i * 7919 % 80_000_000_000) for i in range(n)]
        pq.write_table(pa.table({"event_id": range(k * n, k * n + n), "user_id": [i * 31 % n for i in range(n)], "ts": pa.array(at, pa.timestamp("us"))}), folder / f"part-{k}.parquet")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "150k")
    try:
        got = ANALYTICS["stream_user_sessions"][0](SimpleNamespace(spark=spark, folder=str(tmp_path)))
        assert got.agg({"user_id": "count", "events": "sum"}).first().asDict() == {"count(user_id)": n, "sum(events)": 2 * n}
        twice = feeds.run_to_table(feeds.user_sessions(feeds.follow(spark, str(tmp_path), "events", files_per_trigger=1), late=None), "two_batches")
        assert twice.agg({"n": "sum"}).first()[0] == 2 * n
    finally:
        conf.remove("spark.driver.maxResultSize")
    place = Path(twice.inputFiles()[0].removeprefix("file://")).parent.parent
    assert str(place).startswith(spark.sparkContext.getCheckpointDir().removeprefix("file:")) and [p.name for p in place.iterdir() if p.is_dir()] == ["v=1"]


def test_hybrid_equals_sql_on_late_words_and_on_ties_of_rounded_scores(spark, tmp_path):
    """Contents whose first word of the query stands at their end; the 20th and 21st row differ in the seventh decimal only."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, step = 14, pow(37, -1, 99991)
    at = [[(40_000 + 40 * r + 20 * leg) * step % 99991 for r in range(n)] for leg in range(2)]
    at[1][0] = at[0][0]  # the only document of both legs, so that the pairs of equal ranks lie at places 2 and 3, 4 and 5, ...
    older = next(m for m in range(41_000, 99_000) if m * step % 99991 < (m + 1) * step % 99991)
    at[0][10], at[1][10] = older * step % 99991, (older + 1) * step % 99991
    texts = {i: f"w{i} " + "the of " * (n - r) for r, i in enumerate(at[0])} | {i: f"w{i} " + "a " * 400 + "the" for i in at[1][1:]}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values()), "lang": ["en"] * len(texts), "source": ["src2"] * len(texts), "n_chars": [len(t) for t in texts.values()]}), tmp_path / "documents.parquet")
    vectors = [[1.0 + r / 10, *[1.0] * 63] for r in range(n)]
    pq.write_table(pa.table({"vec_id": at[1], "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["search_hybrid"]).fetchall()
    assert [tuple(r) for r in entry.queries()["search_hybrid"](spark, str(tmp_path)).collect()] == want
    assert len(want) == 20 and at[0][10] in {r[0] for r in want} and at[1][10] not in {r[0] for r in want} and sum(r[2] == 700 for r in want) == 9


def test_entities_and_links_read_whole_contents(spark, duck):
    from types import SimpleNamespace

    from tessera.plans.analytics import ANALYTICS

    chunks = spark.createDataFrame([(1, "Größe año fn"), (2, "größe; the_map")], "document_id long, content string")
    got = {tuple(r) for r in ANALYTICS["text_entities"][0](SimpleNamespace(chunks=chunks)).collect()}
    assert got == {("größe", 2), ("año", 1), ("the_map", 1)}
    docs = spark.createDataFrame([(1, "a [[Other]] b", "src0"), (2, None, "other")], "id long, content string, collection string")
    got = {(r.id, r.target, r.target_id) for r in ANALYTICS["text_links"][0](SimpleNamespace(docs=docs)).collect()}
    assert (1, "Other", 2) in got and {(1, "SRC0", 1), (2, "OTHER", 2)} <= got
    sql = {tuple(map(plain, r)) for r in duck.sql(entry.oracle_sql()["text_links"]).fetchall()}
    assert {tuple(map(plain, r)) for r in entry.queries()["text_links"](spark, FOLDER).collect()} == sql
