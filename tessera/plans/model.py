"""The store's tables derived from the driver's tables, in Spark and as DuckDB common table expressions.

Documents keep their ids; a language is a workspace, a source a collection, a line a chunk. Orders, customers, parts,
suppliers, nations and pages form the typed edges; node names are table::key.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.workers import share_code
from tessera.sources.tables import table


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


EN, DE, ES = sha("en"), sha("de"), sha("es")
GRAPH = sha("graph")


class Model:
    def __init__(self, spark: SparkSession, folder: str):
        share_code(spark)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS id", "sha2(lang, 256) AS workspace_hash", "sha2(text, 256) AS content_hash", "left(split_part(text, '\\n', 1), 60) AS title", "text AS content",
            "concat(CASE WHEN source = 'src0' THEN 'summary://' WHEN source = 'src1' THEN 'raw://s/' ELSE '/' END, lang, '/', source, '/', CAST(doc_id AS STRING), '.md') AS source_path",
            "source AS collection", "array(lang, source) AS tags",
            """concat('{"source_type":"', CASE WHEN n_chars < 1000 THEN 'symbol' ELSE 'text' END, '","kind":"', lang, '","source_content_hash":"', sha2(split_part(text, '\\n', 1), 256), '"}') AS metadata""",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0) AS created_at",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id * 37 % 99991 AS INT), 0) AS updated_at",
            "CASE WHEN doc_id % 7 = 3 THEN doc_id - 1 END AS supersedes_id",
            "CASE WHEN n_chars < 5000 THEN timestamp_ntz'2024-01-01 00:00:00' END AS mod_time", "n_chars AS file_size",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        lines = self.docs.select(F.col("id").alias("document_id"), "workspace_hash", "created_at", F.posexplode(F.split("content", "\n")).alias("pos", "content"))
        return lines.selectExpr(
            "concat(CAST(document_id AS STRING), ':', CAST(pos AS STRING)) AS id", "document_id", "workspace_hash", "CAST(pos AS BIGINT) AS chunk_index", "content", "sha2(content, 256) AS content_hash",
            "CASE WHEN length(content) < 40 THEN 'embed_failed' WHEN length(content) < 200 THEN 'pending' ELSE 'embedded' END AS embed_status",
            "CASE WHEN pos = 0 THEN 'symbol' ELSE 'raw' END AS chunk_type", "split_part(content, ' ', 1) AS symbol_name",
            "CASE WHEN length(content) % 2 = 0 THEN sha2(content, 256) END AS graph_context_hash", "created_at",
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id", "concat(CAST(vec_id AS STRING), ':0') AS chunk_id", "vec_id AS document_id", "embedding", "label")

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.table("documents").filter("lang <> 'es'").select("lang").distinct().selectExpr("sha2(lang, 256) AS hash", "upper(lang) AS name", "concat('/', lang) AS path")

    @cached_property
    def collections(self) -> DataFrame:
        return self.table("documents").select("source", "lang").distinct().selectExpr("source AS name", "sha2(lang, 256) AS workspace_hash", "concat('/', lang, '/', source) AS path")

    @cached_property
    def edges(self) -> DataFrame:
        t = self.table

        def edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
            return df.selectExpr(f"'{GRAPH}' AS workspace_hash", f"{source} AS source_node", f"{target} AS target_node", f"'{kind}' AS edge_type", f"concat(split_part({source}, '::', 1), '.tbl') AS source_file")

        node = lambda name, key: f"concat('{name}::', CAST({key} AS STRING))"
        return (
            edge(t("nation"), node("nation", "n_nationkey"), node("region", "n_regionkey"), "contains")
            .union(edge(t("customer"), node("customer", "c_custkey"), node("nation", "c_nationkey"), "references"))
            .union(edge(t("orders"), node("order", "o_orderkey"), node("customer", "o_custkey"), "calls"))
            .union(edge(t("lineitem").select("l_orderkey", "l_partkey").distinct(), node("order", "l_orderkey"), node("part", "l_partkey"), "imports"))
            .union(edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), node("part", "l_partkey"), node("supplier", "l_suppkey"), "integration"))
            .union(edge(t("pages").selectExpr("page_id", "regexp_extract(url, '^https?://([^/]+)', 1) AS host"), node("page", "page_id"), node("host", "host"), "http"))
        )

    @cached_property
    def entities(self) -> DataFrame:
        words = self.chunks.select(F.col("id").alias("chunk_id"), "workspace_hash", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("word"))
        return words.select("chunk_id", "workspace_hash", F.lower("word").alias("entity_name")).distinct()

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.table("events").selectExpr("event_id AS id", "event_type", "concat('q', CAST(user_id AS STRING)) AS query_text", "props AS payload", "value AS latency_ms", "ts AS created_at")

    @cached_property
    def attempts(self) -> DataFrame:
        """Attempts at summarising: a user is a workspace, an event type the content, the payload the reason."""
        return self.table("events").selectExpr("event_id AS id", "sha2(CAST(user_id AS STRING), 256) AS workspace_hash", "event_type AS content_hash", "props AS reason", "ts")

    @cached_property
    def flowcharts(self) -> DataFrame:
        return self.table("part").selectExpr(f"'{GRAPH}' AS workspace_hash", "concat('part', CAST(p_partkey AS STRING), '::', p_name, '#', p_brand) AS entry", "p_type AS source_file", "CAST(p_size AS BIGINT) AS start_line", "p_partkey AS end_line", "'ok' AS status")


_NODE = "concat('{0}::', {1})"


def _edge(rows: str, source: str, target: str, kind: str) -> str:
    return f"SELECT '{GRAPH}' AS workspace_hash, {source} AS source_node, {target} AS target_node, '{kind}' AS edge_type, concat(split_part({source}, '::', 1), '.tbl') AS source_file FROM {rows}"


#: DuckDB expressions of the same tables, with those that each builds on.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), """SELECT doc_id AS id, sha256(lang) AS workspace_hash, sha256(text) AS content_hash, left(split_part(text, chr(10), 1), 60) AS title, text AS content,
        concat(CASE WHEN source = 'src0' THEN 'summary://' WHEN source = 'src1' THEN 'raw://s/' ELSE '/' END, lang, '/', source, '/', doc_id, '.md') AS source_path, source AS collection, [lang, source] AS tags,
        concat('{"source_type":"', CASE WHEN n_chars < 1000 THEN 'symbol' ELSE 'text' END, '","kind":"', lang, '","source_content_hash":"', sha256(split_part(text, chr(10), 1)), '"}') AS metadata,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 99991) AS updated_at,
        CASE WHEN doc_id % 7 = 3 THEN doc_id - 1 END AS supersedes_id, CASE WHEN n_chars < 5000 THEN TIMESTAMP '2024-01-01' END AS mod_time, n_chars AS file_size FROM documents"""),
    "lines": (("docs",), "SELECT id AS document_id, workspace_hash, created_at, unnest(string_split(content, chr(10))) AS content, unnest(range(len(string_split(content, chr(10))))) AS pos FROM docs"),
    "chunks": (("lines",), """SELECT concat(document_id, ':', pos) AS id, document_id, workspace_hash, pos AS chunk_index, content, sha256(content) AS content_hash,
        CASE WHEN length(content) < 40 THEN 'embed_failed' WHEN length(content) < 200 THEN 'pending' ELSE 'embedded' END AS embed_status, CASE WHEN pos = 0 THEN 'symbol' ELSE 'raw' END AS chunk_type,
        split_part(content, ' ', 1) AS symbol_name, CASE WHEN length(content) % 2 = 0 THEN sha256(content) END AS graph_context_hash, created_at FROM lines"""),
    "emb": ((), "SELECT vec_id, concat(vec_id, ':0') AS chunk_id, vec_id AS document_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"),
    "workspaces": ((), "SELECT DISTINCT sha256(lang) AS hash, upper(lang) AS name, concat('/', lang) AS path FROM documents WHERE lang <> 'es'"),
    "collections": ((), "SELECT DISTINCT source AS name, sha256(lang) AS workspace_hash, concat('/', lang, '/', source) AS path FROM documents"),
    "edges": ((), " UNION ALL ".join((
        _edge("nation", "concat('nation::', n_nationkey)", "concat('region::', n_regionkey)", "contains"),
        _edge("customer", "concat('customer::', c_custkey)", "concat('nation::', c_nationkey)", "references"),
        _edge("orders", "concat('order::', o_orderkey)", "concat('customer::', o_custkey)", "calls"),
        _edge("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "concat('order::', l_orderkey)", "concat('part::', l_partkey)", "imports"),
        _edge("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", "concat('part::', l_partkey)", "concat('supplier::', l_suppkey)", "integration"),
        _edge("(SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)", "concat('page::', page_id)", "concat('host::', host)", "http")))),
    "entities": (("chunks",), "SELECT DISTINCT chunk_id, workspace_hash, lower(word) AS entity_name FROM (SELECT id AS chunk_id, workspace_hash, unnest(regexp_extract_all(content, '[A-Za-z]{9,}')) AS word FROM chunks)"),
    "telemetry": ((), "SELECT event_id AS id, event_type, concat('q', user_id) AS query_text, props AS payload, value AS latency_ms, ts AS created_at FROM events"),
    "attempts": ((), "SELECT event_id AS id, sha256(CAST(user_id AS VARCHAR)) AS workspace_hash, event_type AS content_hash, props AS reason, ts FROM events"),
    "flowcharts": ((), f"SELECT '{GRAPH}' AS workspace_hash, concat('part', p_partkey, '::', p_name, '#', p_brand) AS entry, p_type AS source_file, CAST(p_size AS BIGINT) AS start_line, p_partkey AS end_line, 'ok' AS status FROM part"),
}


def with_tables(names: tuple[str, ...], sql: str, more: str = "") -> str:
    """``sql`` after common table expressions of the named tables (and of what they build on); ``more`` are further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in CTE[name][0]:
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTE[name][1]})" for name in order] + ([more] if more else [])
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"
