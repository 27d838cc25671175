"""The store's statements: documents, chunks, embeddings, collections, workspaces, edges, summaries, flowcharts, telemetry.

Each takes the tables that it reads as DataFrames and returns rows, or the table as it is after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.merging import delete_keys, delete_where, page, upsert, where
from tessera.operators.text import resolve_links, wikilinks

BODYLESS = ["id", "workspace_hash", "content_hash", "title", "source_path", "collection", "tags"]


def json_text(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


# --- documents ---


def upsert_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Key: (source_path, workspace). Rows without a path (null or empty) always append; an old supersedes_id survives a null one."""
    has_path = F.coalesce(F.col("source_path"), F.lit("")) != ""
    named, nameless = new.filter(has_path), new.filter(~has_path)
    merged = upsert(docs, named, ["source_path", "workspace_hash"], {"supersedes_id": lambda o, n: F.coalesce(n, o)}, keep=["id", "created_at"])
    return merged.unionByName(nameless.select(*docs.columns))


def documents_with_successor(docs: DataFrame, workspace: str) -> DataFrame:
    """Documents without content, with the least id that supersedes each, latest first."""
    after = docs.filter("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.min("id").alias("superseded_by"))
    return where(docs, workspace_hash=workspace).select(*BODYLESS, "updated_at").join(after, "id", "left").orderBy(F.desc("updated_at"), "id")


def list_symbols(docs: DataFrame, workspace: str, text: str = "", kind: str = "", limit: int = 50) -> DataFrame:
    rows = where(docs, workspace_hash=workspace).filter(json_text("metadata", "source_type") == "symbol")
    if text:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(text.lower())))  # % and _ stand for themselves
    if kind:
        rows = rows.filter(json_text("metadata", "kind") == kind)
    return page(rows.select("id", "title", "source_path"), ["title", "id"], limit)


def resolve_symbol(docs: DataFrame, workspace: str, name: str) -> DataFrame:
    rows = where(docs, workspace_hash=workspace).filter((F.col("title") == name) & (json_text("metadata", "source_type") == "symbol"))
    return rows.select("id", "title", "source_path").orderBy("source_path", "id")


def tag_counts(docs: DataFrame, workspace: str | None, limit: int | None = None) -> DataFrame:
    counted = where(docs, workspace_hash=workspace).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return page(counted, [F.desc("n"), "tag"], limit)


def documents_by_tag(docs: DataFrame, tag: str | None, workspace: str | None = None, collection: str | None = None, limit: int = 50) -> DataFrame:
    rows = where(docs, workspace_hash=workspace, collection=collection)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    return page(rows.select("id", "title", "source_path", "updated_at"), [F.desc("updated_at"), "id"], limit)


def stale_raw(docs: DataFrame, raw_prefix: str, summary_prefix: str, part: int) -> DataFrame:
    """Raw documents for which a summary exists in the workspace: its path is the summary prefix and a part of theirs."""
    raw = docs.filter(F.col("source_path").startswith(raw_prefix)).withColumn("__key", F.concat(F.lit(summary_prefix), F.split_part("source_path", F.lit("/"), F.lit(part))))
    done = docs.filter(F.col("source_path").startswith(summary_prefix)).select("workspace_hash", F.col("source_path").alias("__key")).distinct()
    return raw.join(done, ["workspace_hash", "__key"], "left_semi").drop("__key")


def summaries_for_backfill(docs: DataFrame, prefix: str, workspace: str | None = None, collection: str | None = None) -> DataFrame:
    rows = where(docs, workspace_hash=workspace, collection=collection).filter(F.col("source_path").startswith(prefix))
    return rows.select("id", "source_path", "created_at").orderBy("created_at", "id")


def file_states(docs: DataFrame, workspace: str) -> DataFrame:
    return where(docs, workspace_hash=workspace).filter("mod_time is not null and file_size is not null").select("source_path", "content_hash", "file_size")


# --- chunks and embeddings ---


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Key: (content_hash, workspace, document). The embedding state goes back to pending only where the content changed."""
    old_content = chunks.select("content_hash", "workspace_hash", "document_id", F.col("content").alias("__old"), F.col("embed_status").alias("__state"))
    staged = new.join(old_content, ["content_hash", "workspace_hash", "document_id"], "left")
    state = F.when(F.col("__old").isNull() | (F.col("__old") != F.col("content")), F.lit("pending")).otherwise(F.col("__state"))
    return upsert(chunks, staged.withColumn("embed_status", state).select(*chunks.columns), ["content_hash", "workspace_hash", "document_id"], keep=["id", "created_at"])


def replace_chunks(chunks: DataFrame, fresh: DataFrame, written: DataFrame) -> DataFrame:
    """``chunks`` after documents (``written``: document_id) were chunked anew: equal contents keep their id and state, others of these documents go."""
    theirs = chunks.join(written.select("document_id").distinct(), "document_id", "left_semi").select(*chunks.columns)
    key = ["content_hash", "workspace_hash", "document_id"]
    same = theirs.dropDuplicates(key).join(fresh.select(*key).distinct(), key, "left_semi").select(*chunks.columns)
    kept = upsert_chunks(same, fresh.dropDuplicates(key))
    return chunks.join(written.select("document_id").distinct(), "document_id", "left_anti").select(*chunks.columns).unionByName(kept)


def replace_links(edges: DataFrame, written: DataFrame, docs: DataFrame) -> DataFrame:
    """``edges`` with the references of the written documents' wikilinks in place of their old ones; a link that names no document keeps its text."""
    links = resolve_links(wikilinks(written.select("id", "workspace_hash", "content")), docs)
    drawn = links.select("workspace_hash", F.col("id").cast("string").alias("source_node"), F.coalesce(F.col("target_id").cast("string"), F.col("target")).alias("target_node"), F.lit("references").alias("edge_type")).distinct()
    for c in edges.columns:
        if c not in drawn.columns:
            drawn = drawn.withColumn(c, F.lit(None).cast(edges.schema[c].dataType))
    old = written.select(F.col("id").cast("string").alias("source_node"), F.lit("references").alias("edge_type"))
    return edges.join(old, ["source_node", "edge_type"], "left_anti").select(*edges.columns).unionByName(drawn.select(*edges.columns))


def chunk_with_path(chunks: DataFrame, docs: DataFrame, chunk_id: str | None = None) -> DataFrame:
    paths = docs.select(F.col("id").alias("document_id"), "source_path")
    return where(chunks, id=chunk_id).join(paths, "document_id", "left").select("id", "document_id", "chunk_index", F.coalesce("source_path", F.lit("")).alias("source_path"))


def chunks_by_state(chunks: DataFrame, state: str, workspace: str | None = None, registered: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """Oldest first; with ``registered`` only chunks of those workspaces."""
    rows = where(chunks, embed_status=state, workspace_hash=workspace)
    if registered is not None:
        rows = rows.join(registered.select(F.col("hash").alias("workspace_hash")), "workspace_hash", "left_semi")
    return page(rows.select("id", "document_id", "created_at"), ["created_at", "id"], limit)


def mark_chunks(chunks: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return chunks.join(hit, "id", "left").withColumn("embed_status", F.when(F.col("__hit"), F.lit(state)).otherwise(F.col("embed_status"))).select(*chunks.columns)


def chunks_of_collection(chunks: DataFrame, docs: DataFrame, collection: str, workspace: str | None = None) -> DataFrame:
    """ids of the chunks whose document is in the collection."""
    own = where(docs, collection=collection, workspace_hash=workspace).select(F.col("id").alias("document_id"))
    return chunks.join(own, "document_id", "left_semi").select("id")


def insert_embeddings(embeddings: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """Upsert on chunk_id, only for chunks that still exist."""
    live = new.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return upsert(embeddings, live.select(*embeddings.columns), ["chunk_id"])


# --- collections and workspaces ---


def collections_with_counts(collections: DataFrame, docs: DataFrame, workspace: str | None = None) -> DataFrame:
    """name, doc_count, last_updated: zero and null for empty collections."""
    counts = docs.groupBy(F.col("collection").alias("name"), "workspace_hash").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))
    rows = where(collections, workspace_hash=workspace).join(counts, ["name", "workspace_hash"], "left")
    return rows.select("name", "workspace_hash", F.coalesce("n", F.lit(0)).alias("doc_count"), "last_updated").orderBy("name", "workspace_hash")


def workspaces_with_stats(workspaces: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    d = docs.groupBy(F.col("workspace_hash").alias("hash")).agg(F.count("*").alias("d"), F.max("updated_at").alias("last_updated"))
    c = chunks.groupBy(F.col("workspace_hash").alias("hash")).agg(F.count("*").alias("c"))
    rows = workspaces.join(d, "hash", "left").join(c, "hash", "left")
    return rows.select("hash", "name", F.coalesce("d", F.lit(0)).alias("doc_count"), F.coalesce("c", F.lit(0)).alias("chunk_count"), "last_updated").orderBy("name")


def orphans(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    return rows.join(workspaces.select(F.col("hash").alias("workspace_hash")), "workspace_hash", "left_anti")


def owned(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    return rows.join(workspaces.select(F.col("hash").alias("workspace_hash")), "workspace_hash", "left_semi")


def resolve_workspace(workspaces: DataFrame, given: str) -> DataFrame:
    """64 hexadecimal digits: the hash; 8 to 63: a prefix, ambiguous ones are an error; else the name, whatever its case."""
    import re

    if re.fullmatch("[0-9a-f]{64}", given):
        return where(workspaces, hash=given)
    if re.fullmatch("[0-9a-f]{8,63}", given):
        found = workspaces.filter(F.col("hash").startswith(given))
        if found.limit(2).count() > 1:
            raise ValueError(f"ambiguous workspace prefix {given!r}")
        return found
    return workspaces.filter(F.lower("name") == given.lower())


def delete_workspace(workspace: str, workspaces: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """All tables without the workspace's rows."""
    gone = {name: delete_where(df, F.col("workspace_hash") == workspace) for name, df in children.items()}
    return gone | {"workspaces": delete_where(workspaces, F.col("hash") == workspace)}


def delete_subtree(prefix: str, docs: DataFrame, chunks: DataFrame, edges: DataFrame, flowcharts: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files below a directory: their documents, those documents' chunks, edges and flowcharts."""
    gone = F.startswith("source_path", F.lit(prefix))
    doomed = docs.filter(gone).select(F.col("id").alias("document_id"))
    below = F.startswith("source_file", F.lit(prefix))
    return {"docs": delete_where(docs, gone), "chunks": delete_keys(chunks, doomed, ["document_id"]), "edges": delete_where(edges, below), "flowcharts": delete_where(flowcharts, below)}


def sweep_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges whose source file still exists."""
    return edges.join(files.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi")


def audit_gaps(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """gap, id of every row that lacks its counterpart."""
    def without(rows: DataFrame, key: str, others: DataFrame, gap: str) -> DataFrame:
        left = rows.select(F.col(key).alias("__k"), F.col("__id")).join(others.withColumnRenamed(others.columns[0], "__k").distinct(), "__k", "left_anti")
        return left.select(F.lit(gap).alias("gap"), F.col("__id").cast("string").alias("id"))

    named = lambda df, c: df.withColumn("__id", F.col(c))
    found = without(named(docs, "id"), "id", chunks.select("document_id"), "document without chunks")
    found = found.union(without(named(chunks, "id"), "document_id", docs.select("id"), "chunk without document"))
    found = found.union(without(named(chunks.filter("embed_status = 'embedded'"), "id"), "id", embeddings.select("chunk_id"), "embedded chunk without embedding"))
    return found.union(without(named(embeddings, "chunk_id"), "chunk_id", chunks.select("id"), "embedding without chunk"))


# Parts of paths that no index should hold.
NOISE = (".output", "_nuxt", "node_modules", ".worktrees", ".pr-reviews", ".opencode", ".next", ".nuxt", "dist/", "build/")


def noise(docs: DataFrame, edges: DataFrame, workspace: str | None = None, parts: tuple[str, ...] = NOISE) -> DataFrame:
    """part, edges, documents, share (of all edges): how many paths hold a part, whatever the case; a path counts for each part it holds."""
    held = lambda path: F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(path), F.lower(p)))
    kept = lambda df: df if workspace is None else df.filter(F.col("workspace_hash") == workspace)
    per_file = kept(edges).groupBy("source_file").agg(F.count("*").alias("n"))
    rows = per_file.select(F.explode(held("source_file")).alias("part"), F.col("n").alias("edges"), F.lit(0).cast("long").alias("documents"))
    rows = rows.union(kept(docs).select(F.explode(held("source_path")).alias("part"), F.lit(0).cast("long"), F.lit(1).cast("long")))
    total = kept(edges).agg(F.count("*").alias("total"))
    found = rows.groupBy("part").agg(F.sum("edges").alias("edges"), F.sum("documents").alias("documents"))
    return found.select("part", "edges", "documents", (F.col("edges") / F.greatest(total.scalar(), F.lit(1))).alias("share"))


# --- edges ---


def symbol_of(node: str) -> Column:
    """The part after '::', or the bare name itself."""
    return F.when(F.instr(node, "::") > 0, F.split_part(node, F.lit("::"), F.lit(2))).otherwise(F.col(node))


def outgoing(edges: DataFrame, workspace: str | None, source: str, kind: str | None = None) -> DataFrame:
    return where(edges, workspace_hash=workspace, source_node=source, edge_type=kind).select("source_node", "target_node", "edge_type").orderBy("edge_type", "target_node")


def outgoing_of_symbol(edges: DataFrame, workspace: str | None, symbol: str, kind: str | None = None) -> DataFrame:
    rows = where(edges, workspace_hash=workspace, edge_type=kind)
    rows = rows.filter((F.col("source_node") == symbol) | (F.split_part("source_node", F.lit("::"), F.lit(2)) == symbol))
    return rows.select("source_node", "target_node", "edge_type").orderBy("edge_type", "target_node", "source_node")


def incoming(edges: DataFrame, workspace: str | None, target: str, kind: str | None = None) -> DataFrame:
    """Edges to a node, to its bare name, or to any node with that symbol."""
    bare = target.partition("::")[2] or target
    hit = F.col("target_node").isin(*{target, bare})
    if "::" not in target:
        hit = hit | (F.split_part("target_node", F.lit("::"), F.lit(2)) == target)
    return where(edges, workspace_hash=workspace, edge_type=kind).filter(hit).select("source_node", "target_node", "edge_type").orderBy("edge_type", "source_node", "target_node")


def candidate_keys(nodes: DataFrame) -> DataFrame:
    """node, key: each node with itself and, if qualified, its bare symbol, so that an OR of two forms is an equi-join."""
    qualified = F.instr("node", "::") > 0
    both = F.when(qualified, F.array("node", F.split_part("node", F.lit("::"), F.lit(2)))).otherwise(F.array("node"))
    return nodes.select("node", F.explode(both).alias("key"))


def callers(edges: DataFrame, targets: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Distinct (source_node, edge_type, node) of edges to any of the targets, in full or bare form."""
    keys = candidate_keys(targets)
    return where(edges, edge_type=kinds).join(keys, F.col("target_node") == F.col("key")).select("source_node", "edge_type", "node").distinct()


def callees(edges: DataFrame, sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return where(edges, edge_type=kinds).join(sources.select(F.col("node").alias("source_node")).distinct(), "source_node", "left_semi").select("source_node", "target_node", "edge_type").distinct()


def caller_counts(edges: DataFrame, targets: DataFrame) -> DataFrame:
    own = targets.select(F.col("node").alias("target_node")).distinct()
    counted = where(edges, edge_type="calls").join(own, "target_node", "left_semi").groupBy("target_node", "source_node").agg(F.count("*").alias("frequency"))
    return counted.orderBy("target_node", F.desc("frequency"), "source_node")


def edge_stats(edges: DataFrame, workspace: str | None) -> DataFrame:
    one = lambda kind: F.count_if(F.col("edge_type") == kind).alias(kind)
    return where(edges, workspace_hash=workspace).agg(F.count("*").alias("total"), one("contains"), one("calls"), one("imports"))


def degrees(edges: DataFrame, workspace: str | None = None, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """node, degree over both ends of all edges; the largest first."""
    own = where(edges, workspace_hash=workspace, edge_type=kinds)
    ends = own.select(F.explode(F.array("source_node", "target_node")).alias("node"))
    return page(ends.groupBy("node").agg(F.count("*").alias("degree")), [F.desc("degree"), "node"], limit)


def node_count(edges: DataFrame, workspace: str | None = None) -> DataFrame:
    return where(edges, workspace_hash=workspace).select(F.explode(F.array("source_node", "target_node")).alias("node")).agg(F.countDistinct("node").alias("n"))


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select("node").distinct()
    rows = edges.join(own.withColumnRenamed("node", "source_node"), "source_node", "left_semi").join(own.withColumnRenamed("node", "target_node"), "target_node", "left_semi")
    return rows.select("source_node", "target_node", "edge_type").orderBy("source_node", "target_node", "edge_type")


def edges_touching(edges: DataFrame, nodes: DataFrame, limit: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Edges with an end among the nodes, in the order of their ends."""
    own = nodes.select("node").distinct()
    rows = where(edges, edge_type=kinds)
    out = rows.join(own.withColumnRenamed("node", "source_node"), "source_node", "left_semi").select(*rows.columns)
    into = rows.join(own.withColumnRenamed("node", "target_node"), "target_node", "left_semi").select(*rows.columns)
    return page(out.unionByName(into).distinct().select("source_node", "target_node", "edge_type"), ["source_node", "target_node", "edge_type"], limit)


def backlinks(edges: DataFrame, docs: DataFrame, target: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Documents that refer to the target; edges name documents by their id as text."""
    refs = where(edges, edge_type="references", target_node=target).select(F.col("source_node"))
    rows = docs.select("id", "title", "source_path").withColumn("source_node", F.col("id").cast("string")).join(refs, "source_node")
    return page(rows.select("id", "title", "source_path"), ["title", "id"], limit, offset)


# --- summaries, flowcharts, telemetry ---


def unsummarised(chunks: DataFrame, docs: DataFrame, workspace: str, tag: str, limit: int | None = None) -> DataFrame:
    """Symbol chunks for which no document with the tag refers to their content."""
    done = docs.filter(F.array_contains("tags", tag)).select("workspace_hash", json_text("metadata", "source_content_hash").alias("content_hash")).distinct()
    rows = where(chunks, workspace_hash=workspace, chunk_type="symbol").join(done, ["workspace_hash", "content_hash"], "left_anti")
    return page(rows.select("id", "document_id"), ["document_id", "id"], limit)


def stale_context(chunks: DataFrame, docs: DataFrame, workspace: str, tag: str) -> DataFrame:
    """Summarised symbol chunks whose graph context has to be computed anew."""
    done = docs.filter(F.array_contains("tags", tag)).select("workspace_hash", json_text("metadata", "source_content_hash").alias("content_hash")).distinct()
    rows = where(chunks, workspace_hash=workspace, chunk_type="symbol").filter("graph_context_hash is null").join(done, ["workspace_hash", "content_hash"], "left_semi")
    return rows.select("id", "document_id").orderBy("document_id", "id")


def count_usage(events: DataFrame) -> DataFrame:
    """A counter for each workspace and day."""
    return events.groupBy("workspace_hash", F.to_date("ts").alias("usage_date")).agg(F.count("*").alias("request_count"))


def failures(attempts: DataFrame) -> DataFrame:
    """One open row for each (workspace, content): how often it failed, and the last reason."""
    return attempts.groupBy("workspace_hash", "content_hash").agg(F.count("*").alias("attempts"), F.max_by("reason", F.struct("ts", "id")).alias("reason"), F.max("ts").alias("last_attempt_at"))


def flowchart_of_handler(charts: DataFrame, handler: str) -> DataFrame:
    """The first chart whose entry is the handler, ends in it after '::', or has it after '#'."""
    hit = (F.col("entry") == handler) | (F.regexp_extract("entry", "::(.*)", 1) == handler) | (F.split_part("entry", F.lit("#"), F.lit(2)) == handler)
    return page(charts.filter(hit).select("entry", "source_file", "start_line", "end_line"), ["start_line", "entry"], 1)


def recent_queries(telemetry: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    return page(where(telemetry, event_type=kind).select("id", "query_text", "created_at"), [F.desc("created_at"), "id"], limit)


def expired(telemetry: DataFrame, now: str, days: int) -> DataFrame:
    """What retention leaves: rows not older than ``days`` before ``now``."""
    return telemetry.filter(F.col("created_at") >= F.expr(f"timestamp_ntz'{now}' - make_dt_interval({int(days)})"))


def recent_documents(docs: DataFrame, workspace: str | None, collections: list[str] | None, limit: int) -> DataFrame:
    rows = where(docs, workspace_hash=workspace, collection=collections).select("id", "title", F.left("content", F.lit(200)).alias("preview"), "updated_at")
    return page(rows, [F.desc("updated_at"), "id"], limit)


