"""One registered query for each named statement of the store, over whole tables, with DuckDB SQL that says the same.

Changes (upserts, updates, deletes) return the table as it is afterwards, by its keys and the columns that changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import store as S
from tessera.operators.merging import delete_keys, delete_where, insert_missing, page, update_where, upsert, where
from tessera.plans.model import EN, GRAPH, Model, with_tables

STATEMENTS: dict[str, tuple[Callable[[Model], DataFrame], str]] = {}


def _add(name: str, run: Callable[[Model], DataFrame], tables: str, sql: str) -> None:
    STATEMENTS[f"sql_{name}"] = (run, with_tables(tuple(tables.split()), sql))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


HASH_LIKE = f"hash LIKE '{EN[:12]}%'"
WS = f"workspace_hash = '{EN}'"

# documents
_NEW_DOCS = "id + 10000000"


def _changed_docs(m: Model) -> DataFrame:
    cols = m.docs.columns
    again = m.docs.filter("collection = 'src2'").withColumn("title", F.concat(F.lit("new "), "title")).withColumn("supersedes_id", F.lit(None).cast("long")).withColumn("id", F.expr(_NEW_DOCS))
    fresh = m.docs.filter("collection = 'src3'").withColumn("source_path", F.concat("source_path", F.lit(".new"))).withColumn("id", F.expr(_NEW_DOCS))
    nameless = m.docs.filter("collection = 'src4'").withColumn("source_path", F.lit("")).withColumn("id", F.expr(_NEW_DOCS))
    return again.select(*cols).union(fresh.select(*cols)).union(nameless.select(*cols))


_UPSERTED = """SELECT id, CASE WHEN collection = 'src2' THEN concat('new ', title) ELSE title END AS title, source_path, supersedes_id FROM docs
    UNION ALL SELECT id + 10000000, title, concat(source_path, '.new'), supersedes_id FROM docs WHERE collection = 'src3'
    UNION ALL SELECT id + 10000000, title, '', supersedes_id FROM docs WHERE collection = 'src4'"""
_add("upsert_document", lambda m: S.upsert_documents(m.docs, _changed_docs(m)).select("id", "title", "source_path", "supersedes_id"), "docs", _UPSERTED)
_TIMED = "timestamp_ntz'2024-05-05 00:00:00'"


def _changed_files(m: Model) -> DataFrame:
    """Files seen again: their time and size are taken over, also where these are null."""
    return _changed_docs(m).withColumn("mod_time", F.expr(f"CASE WHEN collection = 'src2' THEN {_TIMED} END")).withColumn("file_size", F.expr("file_size + 1"))


_FILED = """SELECT id, title, CASE WHEN collection = 'src2' THEN '2024-05-05 00:00:00' ELSE CAST(mod_time AS VARCHAR) END AS mod_time, CASE WHEN collection = 'src2' THEN file_size + 1 ELSE file_size END AS file_size FROM (SELECT * REPLACE (CASE WHEN collection = 'src2' THEN concat('new ', title) ELSE title END AS title) FROM docs)
    UNION ALL SELECT id + 10000000, title, NULL, file_size + 1 FROM docs WHERE collection IN ('src3', 'src4')"""
_add("upsert_document_by_source_path", lambda m: S.upsert_documents(m.docs, _changed_files(m)).select("id", "title", F.col("mod_time").cast("string").alias("mod_time"), "file_size"), "docs", _FILED)
# A hash and a path that documents of one workspace have: those of document 17.
_OF_17 = "SELECT {} FROM docs WHERE id = 17"


def _of_17(m: Model, column: str) -> DataFrame:
    return m.docs.filter("id = 17").select(column, "workspace_hash")


_add("get_document_by_hash", lambda m: m.docs.join(F.broadcast(_of_17(m, "content_hash")), ["content_hash", "workspace_hash"], "left_semi").select("id", "title"), "docs", f"SELECT id, title FROM docs WHERE content_hash = ({_OF_17.format('content_hash')}) AND workspace_hash = ({_OF_17.format('workspace_hash')})")
_add("get_document_by_id", lambda m: where(m.docs, id=17).select("id", "title", "content"), "docs", "SELECT id, title, content FROM docs WHERE id = 17")
_add("get_document_by_source_path", lambda m: m.docs.join(F.broadcast(_of_17(m, "source_path")), ["source_path", "workspace_hash"], "left_semi").select("id", "source_path"), "docs", f"SELECT id, source_path FROM docs WHERE source_path = ({_OF_17.format('source_path')}) AND workspace_hash = ({_OF_17.format('workspace_hash')})")
_add("list_documents_by_workspace", lambda m: S.documents_with_successor(m.docs, EN).select("id", "title", "collection", "superseded_by"), "docs", f"SELECT id, title, collection, (SELECT min(s.id) FROM docs s WHERE s.supersedes_id = d.id) AS superseded_by FROM docs d WHERE {WS}")
_add("delete_document_by_id_and_workspace", lambda m: delete_where(m.docs, (F.col("id") == 17) & (F.col("workspace_hash") == EN)).select("id"), "docs", f"SELECT id FROM docs WHERE NOT (id = 17 AND {WS})")
_add("update_documents_collection", lambda m: update_where(m.docs, (F.col("workspace_hash") == EN) & (F.col("collection") == "src1"), collection="renamed").select("id", "collection"), "docs", f"SELECT id, CASE WHEN {WS} AND collection = 'src1' THEN 'renamed' ELSE collection END AS collection FROM docs")
_add("resolve_symbol_by_name", lambda m: S.resolve_symbol(m.docs, EN, "That it."), "docs", f"SELECT id, title, source_path FROM docs WHERE {WS} AND title = 'That it.' AND json_extract_string(metadata, '$.source_type') = 'symbol'")
_add("list_symbols_by_workspace", lambda m: S.list_symbols(m.docs, EN, "The", "en", 50), "docs", f"SELECT id, title, source_path FROM docs WHERE {WS} AND json_extract_string(metadata, '$.source_type') = 'symbol' AND title ILIKE '%the%' AND json_extract_string(metadata, '$.kind') = 'en' ORDER BY title, id LIMIT 50")
_add("delete_symbol_documents_by_collection", lambda m: delete_where(m.docs, (F.col("collection") == "src1") & (S.json_text("metadata", "source_type") == "symbol")).select("id"), "docs", "SELECT id FROM docs WHERE NOT (collection = 'src1' AND json_extract_string(metadata, '$.source_type') = 'symbol')")
_add("list_tags_by_workspace", lambda m: S.tag_counts(m.docs, EN), "docs", f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM docs WHERE {WS}) GROUP BY tag")
_add("list_session_documents_by_workspace", lambda m: S.documents_by_tag(m.docs, "en", EN, "src1", 50).select("id", "title"), "docs", f"SELECT id, title FROM docs WHERE {WS} AND collection = 'src1' AND list_contains(tags, 'en') ORDER BY updated_at DESC, id LIMIT 50")
_add("delete_documents_by_workspace", lambda m: delete_where(m.docs, F.col("workspace_hash") == EN).select("id"), "docs", f"SELECT id FROM docs WHERE NOT ({WS})")
_RAW, _SUM = "raw://s/", "summary://"
_STALE = "SELECT * FROM docs r WHERE starts_with(source_path, 'raw://s/') AND EXISTS (SELECT 1 FROM docs s WHERE s.workspace_hash = r.workspace_hash AND s.source_path = concat('summary://', split_part(r.source_path, '/', 4), '/src0/0.md'))"


def _stale(m: Model) -> DataFrame:
    marked = m.docs.withColumn("source_path", F.when(F.col("source_path").startswith(_SUM), F.concat(F.lit(_SUM), F.split_part(F.col("source_path"), F.lit("/"), F.lit(3)))).otherwise(F.col("source_path")))
    return S.stale_raw(marked, _RAW, _SUM, 4)


_STALE = "SELECT * FROM docs r WHERE starts_with(source_path, 'raw://s/') AND EXISTS (SELECT 1 FROM docs s WHERE s.workspace_hash = r.workspace_hash AND starts_with(s.source_path, 'summary://') AND split_part(s.source_path, '/', 3) = split_part(r.source_path, '/', 4))"
_add("count_stale_raw_documents", lambda m: _count(_stale(m)), "docs", f"SELECT count(*) AS n FROM ({_STALE})")
_add("delete_stale_raw_documents", lambda m: delete_keys(m.docs, _stale(m), ["id"]).select("id"), "docs", f"SELECT id FROM docs WHERE id NOT IN (SELECT id FROM ({_STALE}))")
_add("list_summary_documents_for_backfill", lambda m: S.summaries_for_backfill(m.docs, _SUM, None, "src0").select("id", "source_path"), "docs", "SELECT id, source_path FROM docs WHERE starts_with(source_path, 'summary://') AND collection = 'src0'")
_add("list_document_source_paths_and_hashes", lambda m: m.docs.select("source_path", "content_hash").orderBy("source_path"), "docs", "SELECT source_path, content_hash FROM docs")
_add("delete_flow_documents_by_workspace", lambda m: delete_where(m.docs, (F.col("workspace_hash") == EN) & (F.col("collection") == "src5")).select("id"), "docs", f"SELECT id FROM docs WHERE NOT ({WS} AND collection = 'src5')")
_add("list_documents_by_tag", lambda m: S.documents_by_tag(m.docs, "src3").select("id", "title"), "docs", "SELECT id, title FROM docs WHERE list_contains(tags, 'src3') ORDER BY updated_at DESC, id LIMIT 50")
_add("preload_file_state_by_workspace", lambda m: S.file_states(m.docs, EN), "docs", f"SELECT source_path, content_hash, file_size FROM docs WHERE {WS} AND mod_time IS NOT NULL AND file_size IS NOT NULL")
_add("delete_legacy_summary_docs_for_symbol", lambda m: delete_where(m.docs, F.col("source_path").startswith("summary://en/src0/1")).select("id"), "docs", "SELECT id FROM docs WHERE NOT starts_with(source_path, 'summary://en/src0/1')")
_add("update_document_file_state", lambda m: update_where(m.docs, F.col("mod_time").isNull(), file_size=F.length("content"), mod_time=F.expr(_TIMED)).select("id", "file_size", F.col("mod_time").cast("string").alias("mod_time")), "docs", "SELECT id, CASE WHEN mod_time IS NULL THEN length(content) ELSE file_size END AS file_size, CASE WHEN mod_time IS NULL THEN '2024-05-05 00:00:00' ELSE CAST(mod_time AS VARCHAR) END AS mod_time FROM docs")

# chunks


def _changed_chunks(m: Model) -> DataFrame:
    same = m.chunks.filter("chunk_index = 1").dropDuplicates(["content_hash", "workspace_hash", "document_id"])
    fresh = m.chunks.filter("chunk_index = 0").withColumn("content", F.concat("content", F.lit("!"))).withColumn("content_hash", F.sha2("content", 256)).withColumn("id", F.concat("id", F.lit("n")))
    return same.select(*m.chunks.columns).union(fresh.select(*m.chunks.columns))


_add("upsert_chunk", lambda m: S.upsert_chunks(m.chunks.dropDuplicates(["content_hash", "workspace_hash", "document_id"]), _changed_chunks(m)).groupBy("document_id", "embed_status").agg(F.count("*").alias("n")),
     "chunks", "SELECT document_id, embed_status, count(*) AS n FROM (SELECT document_id, embed_status FROM (SELECT DISTINCT ON (content_hash, document_id) document_id, embed_status FROM chunks) UNION ALL SELECT document_id, 'pending' FROM chunks c WHERE chunk_index = 0 AND NOT EXISTS (SELECT 1 FROM chunks o WHERE o.document_id = c.document_id AND o.content = concat(c.content, '!'))) GROUP BY ALL")
_add("delete_chunks_by_document_id", lambda m: _count(delete_where(m.chunks, F.col("document_id") == 17)), "chunks", "SELECT count(*) AS n FROM chunks WHERE document_id <> 17")
_add("delete_chunks_by_ids", lambda m: delete_keys(m.chunks, m.chunks.filter("chunk_index = 0"), ["id"]).select("id"), "chunks", "SELECT id FROM chunks WHERE chunk_index <> 0")
_add("count_chunks_by_document_id", lambda m: m.chunks.groupBy("document_id").agg(F.count("*").alias("n")), "chunks", "SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id")
_add("get_chunk_by_id", lambda m: S.chunk_with_path(m.chunks, m.docs.filter("collection <> 'src0'")), "chunks", "SELECT c.id, document_id, chunk_index, coalesce(source_path, '') AS source_path FROM chunks c LEFT JOIN (SELECT * FROM docs WHERE collection <> 'src0') d ON d.id = c.document_id")
_add("list_chunks_by_document_id", lambda m: where(m.chunks, document_id=17).select("id", "chunk_index", "content").orderBy("chunk_index"), "chunks", "SELECT id, chunk_index, content FROM chunks WHERE document_id = 17")

# embeddings


def _embedding_changes(m: Model) -> DataFrame:
    return m.embeddings.filter("label < 3").withColumn("label", F.col("label") + 100).union(m.embeddings.filter("label >= 3").withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))))


_add("insert_embedding", lambda m: S.insert_embeddings(m.embeddings, _embedding_changes(m), m.chunks).select("chunk_id", "label"), "emb", "SELECT chunk_id, CASE WHEN label < 3 THEN label + 100 ELSE label END AS label FROM emb")
for _name, _state, _ws, _reg, _limit in (("get_pending_chunks", "pending", EN, False, 100), ("get_all_pending_chunks", "pending", None, False, 1000), ("get_all_failed_chunks", "embed_failed", None, False, 1000), ("get_pending_chunks_all_workspaces", "pending", None, True, 500), ("get_failed_chunks_all_workspaces", "embed_failed", None, True, 500)):
    _sql = f"SELECT id, document_id FROM chunks WHERE embed_status = '{_state}'" + (f" AND {WS}" if _ws else "") + (" AND EXISTS (SELECT 1 FROM workspaces w WHERE w.hash = workspace_hash)" if _reg else "") + f" ORDER BY created_at, id LIMIT {_limit}"
    _add(_name, lambda m, s=_state, w=_ws, r=_reg, n=_limit: S.chunks_by_state(m.chunks, s, w, m.workspaces if r else None, n).select("id", "document_id"), "chunks workspaces", _sql)
for _name, _state in (("mark_chunk_embedded", "embedded"), ("mark_chunk_embed_failed", "embed_failed")):
    _add(_name, lambda m, s=_state: S.mark_chunks(m.chunks, m.embeddings.select(F.col("chunk_id").alias("id")), s).groupBy("embed_status").agg(F.count("*").alias("n")), "chunks emb", f"SELECT CASE WHEN e.chunk_id IS NOT NULL THEN '{_state}' ELSE embed_status END AS embed_status, count(*) AS n FROM chunks c LEFT JOIN emb e ON e.chunk_id = c.id GROUP BY 1")
for _name, _state in (("count_pending_chunks", "pending"), ("count_embed_failed_chunks", "embed_failed")):
    _add(_name, lambda m, s=_state: _count(where(m.chunks, workspace_hash=EN, embed_status=s)), "chunks", f"SELECT count(*) AS n FROM chunks WHERE {WS} AND embed_status = '{_state}'")
_add("reset_embed_status", lambda m: update_where(m.chunks, F.col("workspace_hash") == EN, embed_status="pending").groupBy("embed_status").agg(F.count("*").alias("n")), "chunks", f"SELECT CASE WHEN {WS} THEN 'pending' ELSE embed_status END AS embed_status, count(*) AS n FROM chunks GROUP BY 1")
_add("reset_embed_status_by_collection", lambda m: S.mark_chunks(m.chunks, S.chunks_of_collection(m.chunks, m.docs, "src0"), "pending").groupBy("embed_status").agg(F.count("*").alias("n")), "chunks", "SELECT CASE WHEN d.collection = 'src0' THEN 'pending' ELSE embed_status END AS embed_status, count(*) AS n FROM chunks c JOIN docs d ON d.id = c.document_id GROUP BY 1")
_add("reset_and_return_chunk_ids_by_collection", lambda m: S.chunks_of_collection(m.chunks, m.docs, "src0", EN), "chunks", f"SELECT c.id FROM chunks c JOIN docs d ON d.id = c.document_id WHERE d.collection = 'src0' AND d.{WS}")
_add("delete_embeddings_by_workspace", lambda m: delete_keys(m.embeddings, where(m.docs, workspace_hash=EN).select(F.col("id").alias("document_id")), ["document_id"]).select("vec_id"), "emb docs", f"SELECT vec_id FROM emb WHERE document_id NOT IN (SELECT id FROM docs WHERE {WS})")
_add("count_embeddings_by_workspace", lambda m: m.embeddings.join(m.docs.select(F.col("id").alias("document_id"), "workspace_hash"), "document_id").groupBy("workspace_hash").agg(F.count("*").alias("n")), "emb docs", "SELECT workspace_hash, count(*) AS n FROM emb JOIN docs ON docs.id = document_id GROUP BY 1")

# collections
_add("upsert_collection", lambda m: upsert(m.collections, m.collections.filter("name = 'src1'").withColumn("path", F.concat("path", F.lit("/x"))), ["name", "workspace_hash"]), "collections", "SELECT name, workspace_hash, CASE WHEN name = 'src1' THEN concat(path, '/x') ELSE path END AS path FROM collections")
_add("list_collections", lambda m: where(m.collections, workspace_hash=EN).orderBy("name"), "collections", f"SELECT * FROM collections WHERE {WS}")
_add("get_collection_by_name", lambda m: where(m.collections, name="src1", workspace_hash=EN), "collections", f"SELECT * FROM collections WHERE name = 'src1' AND {WS}")
_add("rename_collection", lambda m: update_where(m.collections, F.col("name") == "src1", name="renamed"), "collections", "SELECT CASE WHEN name = 'src1' THEN 'renamed' ELSE name END AS name, workspace_hash, path FROM collections")
_add("delete_collection", lambda m: delete_where(m.collections, (F.col("name") == "src1") & (F.col("workspace_hash") == EN)), "collections", f"SELECT * FROM collections WHERE NOT (name = 'src1' AND {WS})")
_add("count_documents_by_collection", lambda m: _count(where(m.docs, collection="src1", workspace_hash=EN)), "docs", f"SELECT count(*) AS n FROM docs WHERE collection = 'src1' AND {WS}")
_add("list_collections_with_doc_count", lambda m: S.collections_with_counts(m.collections, m.docs.filter("collection <> 'src1'")).drop("last_updated"), "collections docs", "SELECT name, c.workspace_hash, coalesce(n, 0) AS doc_count FROM collections c LEFT JOIN (SELECT collection, workspace_hash, count(*) AS n FROM docs WHERE collection <> 'src1' GROUP BY 1, 2) d ON d.collection = name AND d.workspace_hash = c.workspace_hash")

# entities
_add("insert_chunk_entity", lambda m: insert_missing(m.entities.select("chunk_id", "entity_name"), m.entities.filter(F.length("entity_name") > 12).select("chunk_id", F.left("entity_name", F.lit(12)).alias("entity_name")), ["chunk_id", "entity_name"]), "entities", "SELECT chunk_id, entity_name FROM entities UNION SELECT chunk_id, left(entity_name, 12) FROM entities WHERE length(entity_name) > 12")
_add("get_chunk_ids_by_entity_names", lambda m: where(m.entities, entity_name=["therening", "licensed", "worthless"]).select("chunk_id").distinct(), "entities", "SELECT DISTINCT chunk_id FROM entities WHERE entity_name IN ('therening', 'licensed', 'worthless')")
_add("delete_entities_by_chunk_ids", lambda m: delete_keys(m.entities, m.chunks.filter("chunk_index = 0").select(F.col("id").alias("chunk_id")), ["chunk_id"]).groupBy("entity_name").agg(F.count("*").alias("n")), "entities chunks", "SELECT entity_name, count(*) AS n FROM entities WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE chunk_index = 0) GROUP BY 1")

# flowcharts
_FC = ["source_file", "start_line", "end_line"]
_add("upsert_function_flowchart", lambda m: upsert(m.flowcharts, m.flowcharts.filter("start_line < 10").withColumn("status", F.lit("stale")), ["workspace_hash", *_FC]).select(*_FC, "status"), "flowcharts", "SELECT source_file, start_line, end_line, CASE WHEN start_line < 10 THEN 'stale' ELSE status END AS status FROM flowcharts")
_add("get_function_flowchart", lambda m: where(m.flowcharts, source_file="ECONOMY", start_line=11).select("entry", *_FC), "flowcharts", "SELECT entry, source_file, start_line, end_line FROM flowcharts WHERE source_file = 'ECONOMY' AND start_line = 11")
_add("get_function_flowchart_by_handler", lambda m: S.flowchart_of_handler(m.flowcharts, "Brand#2").union(S.flowchart_of_handler(m.flowcharts, "Brand")), "flowcharts", "(SELECT entry, source_file, start_line, end_line FROM flowcharts WHERE entry = 'Brand#2' OR regexp_extract(entry, '::(.*)', 1) = 'Brand#2' OR split_part(entry, '#', 2) = 'Brand#2' ORDER BY start_line, entry LIMIT 1) UNION ALL (SELECT entry, source_file, start_line, end_line FROM flowcharts WHERE entry = 'Brand' OR regexp_extract(entry, '::(.*)', 1) = 'Brand' OR split_part(entry, '#', 2) = 'Brand' ORDER BY start_line, entry LIMIT 1)")
_add("get_function_flowchart_by_entry", lambda m: where(m.flowcharts, entry="part0::small ring#Brand#2").select("entry", *_FC), "flowcharts", "SELECT entry, source_file, start_line, end_line FROM flowcharts WHERE entry = 'part0::small ring#Brand#2'")
_add("delete_function_flowcharts_by_file", lambda m: delete_where(m.flowcharts, F.col("source_file") == "ECONOMY").select("entry"), "flowcharts", "SELECT entry FROM flowcharts WHERE source_file <> 'ECONOMY'")
_add("delete_all_function_flowcharts", lambda m: _count(delete_where(m.flowcharts, F.col("workspace_hash") == GRAPH)), "flowcharts", f"SELECT count(*) AS n FROM flowcharts WHERE workspace_hash <> '{GRAPH}'")

# graph
_EK = ["source_node", "target_node", "edge_type"]
_ES = "source_node, target_node, edge_type"
_add("upsert_graph_edge", lambda m: upsert(m.edges, m.edges.filter("edge_type = 'http'").withColumn("source_file", F.lit("new.tbl")), ["workspace_hash", *_EK]).select(*_EK, "source_file"), "edges", f"SELECT {_ES}, CASE WHEN edge_type = 'http' THEN 'new.tbl' ELSE source_file END AS source_file FROM edges")
_add("delete_graph_edges_by_file", lambda m: delete_where(m.edges, F.col("source_file") == "order.tbl").select(*_EK), "edges", f"SELECT {_ES} FROM edges WHERE source_file <> 'order.tbl'")
_add("get_outgoing_edges", lambda m: S.outgoing(m.edges, GRAPH, "order::5"), "edges", f"SELECT {_ES} FROM edges WHERE source_node = 'order::5'")
_add("get_outgoing_edges_by_symbol", lambda m: S.outgoing_of_symbol(m.edges, GRAPH, "5"), "edges", f"SELECT {_ES} FROM edges WHERE source_node = '5' OR split_part(source_node, '::', 2) = '5'")
_add("get_incoming_edges", lambda m: S.incoming(m.edges, GRAPH, "customer::5").union(S.incoming(m.edges, GRAPH, "7", "imports")), "edges", f"SELECT {_ES} FROM edges WHERE target_node IN ('customer::5', '5') UNION ALL SELECT {_ES} FROM edges WHERE edge_type = 'imports' AND (target_node = '7' OR split_part(target_node, '::', 2) = '7')")
_add("graph_stats", lambda m: S.edge_stats(m.edges, GRAPH), "edges", "SELECT count(*) AS total, count(*) FILTER (WHERE edge_type = 'contains') AS contains, count(*) FILTER (WHERE edge_type = 'calls') AS calls, count(*) FILTER (WHERE edge_type = 'imports') AS imports FROM edges")
_add("get_impactors", lambda m: where(m.edges, target_node="part::7").select("source_node", "edge_type").distinct(), "edges", "SELECT DISTINCT source_node, edge_type FROM edges WHERE target_node = 'part::7'")
_PARTS = "SELECT concat('part::', p_partkey) FROM part WHERE p_size < 10"


def _small_parts(m: Model) -> DataFrame:
    return m.table("part").filter("p_size < 10").selectExpr("concat('part::', CAST(p_partkey AS STRING)) AS node")


_add("get_impactors_by_targets", lambda m: S.callers(m.edges, _small_parts(m)).select("source_node", "edge_type").distinct(), "edges", f"SELECT DISTINCT source_node, edge_type FROM edges WHERE target_node IN ({_PARTS})")
_add("get_outgoing_edges_by_sources", lambda m: S.callees(m.edges, _small_parts(m)), "edges", f"SELECT DISTINCT {_ES} FROM edges WHERE source_node IN ({_PARTS})")
_add("list_doc_ids_by_title", lambda m: m.docs.filter(F.lower("title") == "that it.").select("id"), "docs", "SELECT id FROM docs WHERE lower(title) = 'that it.'")
_add("exists_doc_by_id", lambda m: _count(m.docs.filter("id = 17").limit(1)).select((F.col("n") > 0).alias("found")), "docs", "SELECT EXISTS (SELECT 1 FROM docs WHERE id = 17) AS found")
_add("list_reference_edges_by_source", lambda m: S.outgoing(m.edges, GRAPH, "customer::5", "references"), "edges", f"SELECT {_ES} FROM edges WHERE source_node = 'customer::5' AND edge_type = 'references'")
_add("upsert_reference_edge", lambda m: insert_missing(m.edges.select(*_EK), m.edges.filter("edge_type IN ('calls', 'references')").withColumn("edge_type", F.lit("references")).select(*_EK), _EK), "edges", f"SELECT {_ES} FROM edges UNION SELECT source_node, target_node, 'references' FROM edges WHERE edge_type = 'calls'")
_add("delete_reference_edges_by_source", lambda m: delete_where(m.edges, (F.col("edge_type") == "references") & (F.col("source_node") == "customer::5")).select(*_EK), "edges", f"SELECT {_ES} FROM edges WHERE NOT (edge_type = 'references' AND source_node = 'customer::5')")
_DEG = "SELECT node, count(*) AS degree FROM (SELECT source_node AS node FROM edges UNION ALL SELECT target_node FROM edges) GROUP BY node"
_add("list_top_graph_nodes_by_degree", lambda m: S.degrees(m.edges, GRAPH, None, 50), "edges", f"{_DEG} ORDER BY degree DESC, node LIMIT 50")
_add("count_distinct_graph_nodes", lambda m: S.node_count(m.edges, GRAPH), "edges", "SELECT count(*) AS n FROM (SELECT source_node FROM edges UNION SELECT target_node FROM edges)")
_NODES = "SELECT concat('customer::', c_custkey) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT concat('nation::', n_nationkey) FROM nation"


def _some_nodes(m: Model) -> DataFrame:
    rich = m.table("customer").filter("c_acctbal > 5000").selectExpr("concat('customer::', CAST(c_custkey AS STRING)) AS node")
    return rich.union(m.table("nation").selectExpr("concat('nation::', CAST(n_nationkey AS STRING)) AS node"))


_add("list_edges_between_nodes", lambda m: S.edges_between(m.edges, _some_nodes(m)), "edges", f"SELECT {_ES} FROM edges WHERE source_node IN ({_NODES}) AND target_node IN ({_NODES})")
_add("list_edges_touching_nodes", lambda m: S.edges_touching(m.edges, _some_nodes(m)), "edges", f"SELECT {_ES} FROM edges WHERE source_node IN ({_NODES}) OR target_node IN ({_NODES})")
_add("list_all_edges_by_workspace", lambda m: where(m.edges, workspace_hash=GRAPH).select(*_EK).orderBy(*_EK), "edges", f"SELECT {_ES} FROM edges")
_add("list_consumer_entry_nodes_by_workspace", lambda m: m.edges.withColumn("node", F.concat(F.lit("ON "), "source_node")).filter(F.col("node").startswith("CONSUME ") | F.col("node").startswith("ON page")).select("node").distinct(), "edges", "SELECT DISTINCT concat('ON ', source_node) AS node FROM edges WHERE concat('ON ', source_node) LIKE 'ON page%'")
_add("list_http_endpoints_by_workspace", lambda m: where(m.edges, workspace_hash=GRAPH, edge_type="http").select("source_node", "target_node").distinct(), "edges", "SELECT DISTINCT source_node, target_node FROM edges WHERE edge_type = 'http'")

# pagerank table
_add("list_call_edges", lambda m: where(m.edges, edge_type="calls").select("source_node", "target_node"), "edges", "SELECT source_node, target_node FROM edges WHERE edge_type = 'calls'")
_add("count_call_edges", lambda m: _count(where(m.edges, edge_type="calls")), "edges", "SELECT count(*) AS n FROM edges WHERE edge_type = 'calls'")
_SCORES = "SELECT target_node AS node, CAST(count(*) AS DOUBLE) AS score FROM edges GROUP BY 1"


def _scores(m: Model) -> DataFrame:
    return m.edges.groupBy(F.col("target_node").alias("node")).agg(F.count("*").cast("double").alias("score"))


_add("upsert_pagerank_score", lambda m: upsert(_scores(m), _scores(m).filter("score > 5").withColumn("score", F.lit(1.0)), ["node"]), "edges", f"SELECT node, CASE WHEN score > 5 THEN 1.0::DOUBLE ELSE score END AS score FROM ({_SCORES})")
_add("get_pagerank_scores", lambda m: _scores(m), "edges", _SCORES)
_add("delete_pagerank_scores", lambda m: _count(delete_where(_scores(m), F.lit(True))), "edges", "SELECT 0::BIGINT AS n")

# stats
_add("count_docs_by_collection_grouped", lambda m: m.docs.groupBy("collection").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection"), "docs", "SELECT collection, count(*) AS n FROM docs GROUP BY 1")
_add("count_chunks_by_embed_status", lambda m: m.chunks.join(m.docs.select(F.col("id").alias("document_id"), "collection"), "document_id").groupBy("collection", "embed_status").agg(F.count("*").alias("n")), "chunks", "SELECT collection, embed_status, count(*) AS n FROM chunks c JOIN docs d ON d.id = c.document_id GROUP BY 1, 2")
_add("count_graph_edges_by_type", lambda m: m.edges.groupBy("edge_type").agg(F.count("*").alias("n")), "edges", "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
_add("list_top_tags", lambda m: S.tag_counts(m.docs, None, 20), "docs", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
_add("list_recent_documents", lambda m: page(m.docs.select("id", "title", "updated_at"), [F.desc("updated_at"), "id"], 10).select("id", "title"), "docs", "SELECT id, title FROM docs ORDER BY updated_at DESC, id LIMIT 10")
_add("list_recent_queries", lambda m: S.recent_queries(m.telemetry, "view").select("id", "query_text"), "telemetry", "SELECT id, query_text FROM telemetry WHERE event_type = 'view' ORDER BY created_at DESC, id LIMIT 20")
_add("get_edges_by_nodes", lambda m: S.edges_touching(m.edges, _some_nodes(m), None, ["references", "contains"]), "edges", f"SELECT {_ES} FROM edges WHERE edge_type IN ('references', 'contains') AND (source_node IN ({_NODES}) OR target_node IN ({_NODES}))")
_add("list_documents_by_ids", lambda m: m.docs.join(m.embeddings.select(F.col("document_id").alias("id")), "id", "left_semi").select("id", "title"), "docs emb", "SELECT id, title FROM docs WHERE id IN (SELECT document_id FROM emb)")


def _references(m: Model) -> DataFrame:
    old = m.docs.filter("supersedes_id is not null")
    return old.selectExpr("CAST(id AS STRING) AS source_node", "collection AS target_node", "'references' AS edge_type")


_BACK = "SELECT d.id, d.title, d.source_path FROM docs d JOIN (SELECT CAST(id AS VARCHAR) AS source_node, collection AS target_node FROM docs WHERE supersedes_id IS NOT NULL) e ON CAST(d.id AS VARCHAR) = e.source_node WHERE e.target_node = 'src0'"
_add("list_backlinks_by_target", lambda m: S.backlinks(_references(m), m.docs, "src0", 20, 5), "docs", f"{_BACK} ORDER BY title, id LIMIT 20 OFFSET 5")
_add("count_backlinks_by_target", lambda m: _count(S.backlinks(_references(m), m.docs, "src0", None)), "docs", f"SELECT count(*) AS n FROM ({_BACK})")

# telemetry and wake-up
_add("insert_search_telemetry", lambda m: m.telemetry.select("id", "event_type").union(m.telemetry.filter("event_type = 'error'").selectExpr("id + 10000000", "'retry'")), "telemetry", "SELECT id, event_type FROM telemetry UNION ALL SELECT id + 10000000, 'retry' FROM telemetry WHERE event_type = 'error'")
_add("cleanup_telemetry_logs", lambda m: S.expired(m.telemetry, "2024-01-31 00:00:00", 10).select("id"), "telemetry", "SELECT id FROM telemetry WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
_add("recent_documents", lambda m: S.recent_documents(m.docs, EN, ["src1", "src2"], 10).drop("updated_at"), "docs", f"SELECT id, title, left(content, 200) AS preview FROM docs WHERE {WS} AND collection IN ('src1', 'src2') ORDER BY updated_at DESC, id LIMIT 10")
_add("workspace_doc_stats", lambda m: m.docs.groupBy("workspace_hash").agg(F.count("*").alias("n"), F.max("updated_at").cast("string").alias("last")), "docs", "SELECT workspace_hash, count(*) AS n, CAST(max(updated_at) AS VARCHAR) AS last FROM docs GROUP BY 1")
_add("workspace_chunk_count", lambda m: _count(where(m.chunks, workspace_hash=EN)), "chunks", f"SELECT count(*) AS n FROM chunks WHERE {WS}")
_add("list_collections_with_last_updated", lambda m: S.collections_with_counts(m.collections, m.docs).withColumn("last_updated", F.col("last_updated").cast("string")), "collections docs", "SELECT name, c.workspace_hash, coalesce(n, 0) AS doc_count, CAST(last AS VARCHAR) AS last_updated FROM collections c LEFT JOIN (SELECT collection, workspace_hash, count(*) AS n, max(updated_at) AS last FROM docs GROUP BY 1, 2) d ON d.collection = name AND d.workspace_hash = c.workspace_hash")

# workspaces
_add("upsert_workspace", lambda m: upsert(m.workspaces, m.workspaces.filter("name = 'EN'").withColumn("path", F.lit("/moved")), ["hash"]), "workspaces", "SELECT hash, name, CASE WHEN name = 'EN' THEN '/moved' ELSE path END AS path FROM workspaces")
_add("get_workspace_by_hash", lambda m: S.resolve_workspace(m.workspaces, EN), "workspaces", f"SELECT * FROM workspaces WHERE hash = '{EN}'")
_add("list_workspaces", lambda m: m.workspaces.orderBy("name"), "workspaces", "SELECT * FROM workspaces")
_add("count_documents_by_workspace", lambda m: m.docs.groupBy("workspace_hash").agg(F.count("*").alias("n")), "docs", "SELECT workspace_hash, count(*) AS n FROM docs GROUP BY 1")
_add("count_workspaces", lambda m: _count(m.workspaces), "workspaces", "SELECT count(*) AS n FROM workspaces")
_add("list_workspaces_with_stats", lambda m: S.workspaces_with_stats(m.workspaces, m.docs, m.chunks).drop("last_updated"), "workspaces chunks", "SELECT hash, name, (SELECT count(*) FROM docs WHERE workspace_hash = hash) AS doc_count, (SELECT count(*) FROM chunks WHERE workspace_hash = hash) AS chunk_count FROM workspaces")


def _without_workspace(m: Model) -> DataFrame:
    """What each table keeps once a workspace is gone with all that belongs to it."""
    left = S.delete_workspace(EN, m.workspaces, docs=m.docs, chunks=m.chunks, collections=m.collections)
    counted = [_count(df).select(F.lit(name).alias("name"), "n") for name, df in sorted(left.items())]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


_add("delete_workspace", _without_workspace, "workspaces chunks collections", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} WHERE {c} <> '{EN}'" for t, c in (("workspaces", "hash"), ("docs", "workspace_hash"), ("chunks", "workspace_hash"), ("collections", "workspace_hash"))))
_OUT = "workspace_hash NOT IN (SELECT hash FROM workspaces)"
_add("list_orphan_document_workspaces", lambda m: S.orphans(m.docs, m.workspaces).groupBy("workspace_hash").agg(F.count("*").alias("n")), "docs workspaces", f"SELECT workspace_hash, count(*) AS n FROM docs WHERE {_OUT} GROUP BY 1")
_add("count_orphan_documents", lambda m: _count(S.orphans(m.docs, m.workspaces)), "docs workspaces", f"SELECT count(*) AS n FROM docs WHERE {_OUT}")
_add("count_orphan_chunks", lambda m: _count(S.orphans(m.chunks, m.workspaces)), "chunks workspaces", f"SELECT count(*) AS n FROM chunks WHERE {_OUT}")
_add("delete_orphan_documents", lambda m: S.owned(m.docs, m.workspaces).select("id"), "docs workspaces", f"SELECT id FROM docs WHERE NOT ({_OUT})")
_add("delete_orphan_chunks", lambda m: S.owned(m.chunks, m.workspaces).select("id"), "chunks workspaces", f"SELECT id FROM chunks WHERE NOT ({_OUT})")
_add("get_workspace_by_name", lambda m: S.resolve_workspace(m.workspaces, "de"), "workspaces", "SELECT * FROM workspaces WHERE lower(name) = 'de'")
_add("get_workspace_by_hash_prefix", lambda m: S.resolve_workspace(m.workspaces, EN[:12]), "workspaces", f"SELECT * FROM workspaces WHERE {HASH_LIKE}")
_add("count_workspaces_by_hash_prefix", lambda m: _count(m.workspaces.filter(F.col("hash").startswith(EN[:12]))), "workspaces", f"SELECT count(*) AS n FROM workspaces WHERE {HASH_LIKE}")

# summaries of code
_add("increment_summarization_usage", lambda m: S.count_usage(m.attempts).withColumn("usage_date", F.col("usage_date").cast("string")), "attempts", "SELECT workspace_hash, CAST(CAST(ts AS DATE) AS VARCHAR) AS usage_date, count(*) AS request_count FROM attempts GROUP BY 1, 2")
_add("get_summarization_usage", lambda m: where(S.count_usage(m.attempts), usage_date="2024-01-10").select("workspace_hash", "request_count"), "attempts", "SELECT workspace_hash, count(*) AS request_count FROM attempts WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
_DONE = "SELECT json_extract_string(metadata, '$.source_content_hash') FROM docs s WHERE s.workspace_hash = c.workspace_hash AND list_contains(s.tags, 'src1')"
_add("get_unsummarized_symbols", lambda m: S.unsummarised(m.chunks, m.docs, EN, "src1"), "chunks", f"SELECT id, document_id FROM chunks c WHERE {WS} AND chunk_type = 'symbol' AND content_hash NOT IN ({_DONE})")
_add("get_symbol_chunks_by_graph_context_stale", lambda m: S.stale_context(m.chunks, m.docs, EN, "src1"), "chunks", f"SELECT id, document_id FROM chunks c WHERE {WS} AND chunk_type = 'symbol' AND graph_context_hash IS NULL AND content_hash IN ({_DONE})")
_FAIL = "SELECT workspace_hash, content_hash, count(*) AS attempts, max_by(reason, (ts, id)) AS reason, max(ts) AS last FROM attempts GROUP BY 1, 2"
_add("upsert_summarization_failure", lambda m: S.failures(m.attempts).drop("last_attempt_at"), "attempts", f"SELECT workspace_hash, content_hash, attempts, reason FROM ({_FAIL})")
_add("update_summarization_failure", lambda m: update_where(S.failures(m.attempts), F.col("attempts") > 10, reason="gave up").select("workspace_hash", "content_hash", "reason"), "attempts", f"SELECT workspace_hash, content_hash, CASE WHEN attempts > 10 THEN 'gave up' ELSE reason END AS reason FROM ({_FAIL})")
_add("get_unresolved_failures", lambda m: S.failures(m.attempts).filter("attempts > 10").orderBy(F.desc("last_attempt_at"), "content_hash").select("workspace_hash", "content_hash", "attempts"), "attempts", f"SELECT workspace_hash, content_hash, attempts FROM ({_FAIL}) WHERE attempts > 10")
_add("resolve_failure", lambda m: S.failures(m.attempts).select("workspace_hash", "content_hash", F.when(F.col("content_hash") == "view", F.lit("2024-02-01")).alias("resolved_at")), "attempts", f"SELECT workspace_hash, content_hash, CASE WHEN content_hash = 'view' THEN '2024-02-01' END AS resolved_at FROM ({_FAIL})")


def _status(m: Model) -> DataFrame:
    symbols = where(m.chunks, chunk_type="symbol").agg(F.count("*").alias("symbols"))
    done = m.docs.filter(F.array_contains("tags", "src1")).agg(F.count("*").alias("summaries"))
    return symbols.crossJoin(F.broadcast(done)).crossJoin(F.broadcast(S.failures(m.attempts).agg(F.count("*").alias("failures"))))  # one row each


_add("get_summarization_status", _status, "chunks attempts", f"SELECT (SELECT count(*) FROM chunks WHERE chunk_type = 'symbol') AS symbols, (SELECT count(*) FROM docs WHERE list_contains(tags, 'src1')) AS summaries, (SELECT count(*) FROM ({_FAIL})) AS failures")
_add("get_failure_by_symbol", lambda m: where(S.failures(m.attempts), content_hash="error").select("workspace_hash", "attempts"), "attempts", f"SELECT workspace_hash, attempts FROM ({_FAIL}) WHERE content_hash = 'error'")
_add("delete_summarization_usage_by_workspace", lambda m: _count(delete_where(S.count_usage(m.attempts), F.col("workspace_hash") == F.sha2(F.lit("5"), 256))), "attempts", "SELECT count(*) AS n FROM (SELECT DISTINCT workspace_hash, CAST(ts AS DATE) FROM attempts WHERE workspace_hash <> sha256('5'))")
_add("delete_summarization_failures_by_workspace", lambda m: _count(delete_where(S.failures(m.attempts), F.col("workspace_hash") == F.sha2(F.lit("5"), 256))), "attempts", f"SELECT count(*) AS n FROM ({_FAIL}) WHERE workspace_hash <> sha256('5')")
_CUST = "SELECT concat('customer::', c_custkey) FROM customer WHERE c_acctbal > 5000"


def _rich(m: Model) -> DataFrame:
    return m.table("customer").filter("c_acctbal > 5000").selectExpr("concat('customer::', CAST(c_custkey AS STRING)) AS node")


_add("bulk_get_caller_context", lambda m: S.caller_counts(m.edges, _rich(m)), "edges", f"SELECT target_node, source_node, count(*) AS frequency FROM edges WHERE edge_type = 'calls' AND target_node IN ({_CUST}) GROUP BY 1, 2")
_add("get_callee_nodes", lambda m: S.outgoing(m.edges, GRAPH, "order::5", "imports").select("target_node").distinct(), "edges", "SELECT DISTINCT target_node FROM edges WHERE source_node = 'order::5' AND edge_type = 'imports'")
_add("bulk_get_callee_nodes", lambda m: S.callees(m.edges, _rich(m), ["references"]).select("source_node", "target_node"), "edges", f"SELECT DISTINCT source_node, target_node FROM edges WHERE edge_type = 'references' AND source_node IN ({_CUST})")
_add("update_chunk_graph_context_hash", lambda m: _count(update_where(m.chunks, F.col("chunk_type") == "symbol", graph_context_hash="x").filter("graph_context_hash = 'x'")), "chunks", "SELECT count(*) AS n FROM chunks WHERE chunk_type = 'symbol'")
_add("nullify_graph_context_hash_by_symbols", lambda m: update_where(m.chunks, F.col("symbol_name").isin("The", "A", "In"), graph_context_hash=F.lit(None)).agg(F.count("graph_context_hash").alias("n")), "chunks", "SELECT count(*) AS n FROM chunks WHERE graph_context_hash IS NOT NULL AND symbol_name NOT IN ('The', 'A', 'In')")

# audits
_add("audit_duplicates", lambda m: m.docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.countDistinct("workspace_hash").alias("workspaces")).filter("copies > 1"), "docs", "SELECT content_hash, count(*) AS copies, count(DISTINCT workspace_hash) AS workspaces FROM docs GROUP BY 1 HAVING count(*) > 1")
_add("audit_documents_without_embeddings", lambda m: m.docs.join(m.embeddings.select(F.col("document_id").alias("id")), "id", "left_anti").groupBy("collection").agg(F.count("*").alias("n")), "docs emb", "SELECT collection, count(*) AS n FROM docs WHERE id NOT IN (SELECT document_id FROM emb) GROUP BY 1")
_add("audit_noise", lambda m: m.docs.withColumn("noise", F.expr("exists(array('%src1/%', '%SRC2/1%'), p -> source_path ILIKE p)")).groupBy("noise").agg(F.count("*").alias("n")), "docs", "SELECT source_path ILIKE '%src1/%' OR source_path ILIKE '%SRC2/1%' AS noise, count(*) AS n FROM docs GROUP BY 1")
_add("audit_edge_sources", lambda m: page(m.edges.groupBy("source_file", "edge_type").agg(F.count("*").alias("n")), [F.desc("n"), "source_file", "edge_type"], 20), "edges", "SELECT source_file, edge_type, count(*) AS n FROM edges GROUP BY 1, 2 ORDER BY n DESC, source_file, edge_type LIMIT 20")
_NOISY = ("part", "Nation", "SRC1/", "nowhere")
_add("audit_edge_noise", lambda m: S.noise(m.docs, m.edges, None, _NOISY).select("part", "edges", "documents", F.round("share", 6).alias("share")), "docs edges", f"SELECT part, edges, documents, round(edges / (SELECT count(*) FROM edges), 6) AS share FROM (SELECT part, (SELECT count(*) FROM edges WHERE source_file ILIKE '%' || part || '%') AS edges, (SELECT count(*) FROM docs WHERE source_path ILIKE '%' || part || '%') AS documents FROM (SELECT unnest({list(_NOISY)}) AS part)) WHERE edges + documents > 0")


def _without_subtree(m: Model) -> DataFrame:
    left = S.delete_subtree("/de/", m.docs, m.chunks, m.edges.withColumn("source_file", F.concat(F.lit("/de/"), "source_file")).filter("edge_type <> 'calls'").unionByName(m.edges.filter("edge_type = 'calls'")), m.flowcharts)
    counted = [_count(df).select(F.lit(name).alias("name"), "n") for name, df in sorted(left.items())]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


_add("delete_subtree", _without_subtree, "chunks edges flowcharts", "SELECT 'docs' AS name, count(*) AS n FROM docs WHERE NOT starts_with(source_path, '/de/') UNION ALL SELECT 'chunks', count(*) FROM chunks c JOIN docs d ON d.id = c.document_id WHERE NOT starts_with(d.source_path, '/de/') UNION ALL SELECT 'edges', count(*) FROM edges WHERE edge_type = 'calls' UNION ALL SELECT 'flowcharts', count(*) FROM flowcharts")
_add("orphan_graph_sweep", lambda m: S.sweep_edges(m.edges, m.edges.filter("edge_type <> 'http'").select(F.col("source_file").alias("path"))).select(*_EK), "edges", f"SELECT {_ES} FROM edges JOIN (SELECT DISTINCT source_file FROM edges WHERE edge_type <> 'http') USING (source_file)")


def _gaps(m: Model) -> DataFrame:
    """Documents without chunks, chunks without documents, embedded chunks without embeddings, embeddings without chunks."""
    some = m.chunks.filter("document_id % 3 <> 0")
    left = S.audit_gaps(m.docs.filter("collection <> 'src5'"), some, m.embeddings)
    return left.groupBy("gap").agg(F.count("*").alias("n"))


_add("audit_gaps", _gaps, "chunks emb", "SELECT 'document without chunks' AS gap, count(*) AS n FROM docs WHERE collection <> 'src5' AND id % 3 = 0 UNION ALL SELECT 'chunk without document', count(*) FROM chunks c JOIN docs d ON d.id = c.document_id WHERE document_id % 3 <> 0 AND d.collection = 'src5' UNION ALL SELECT 'embedded chunk without embedding', count(*) FROM chunks c LEFT JOIN emb e ON e.chunk_id = c.id WHERE c.document_id % 3 <> 0 AND embed_status = 'embedded' AND e.chunk_id IS NULL UNION ALL SELECT 'embedding without chunk', count(*) FROM emb e LEFT JOIN (SELECT id FROM chunks WHERE document_id % 3 <> 0) c ON c.id = e.chunk_id WHERE c.id IS NULL")

