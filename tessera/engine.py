"""One class over the store's tables: searches, documents, graph, workspaces, as methods that return DataFrames.

``Engine(tables)`` takes DataFrames by name: documents, chunks, embeddings, edges, workspaces, collections, entities,
pagerank, flowcharts, telemetry; only those that a call uses have to be there. Changes return the tables as they are
afterwards. Models (embedding, rewriting, reranking) are functions that a caller hands in; a search goes on without one
that fails.
"""

from __future__ import annotations

import logging
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import queries as Q
from tessera.operators import flows as W
from tessera.operators import graph as G
from tessera.operators import lexical as L
from tessera.operators import search as R
from tessera.operators import store as S
from tessera.operators import text as X
from tessera.operators.merging import delete_keys, page, where, within

log = logging.getLogger(__name__)
# Results of a search if none are asked for and at most; likewise of a briefing and of symbols; kinds of chunks that can be asked for.
RESULTS, MOST_RESULTS, BRIEFING, MOST_BRIEFING, SYMBOLS, MOST_SYMBOLS = 20, 100, 10, 50, 50, 200
CHUNK_TYPES = ("raw", "symbol")
ALL = "all"


def clamp(asked: int | None, usual: int, most: int) -> int:
    """``usual`` without a positive number, ``most`` above it."""
    return usual if not asked or asked <= 0 else min(asked, most)


def project(df: DataFrame, fields: str | None) -> DataFrame:
    """The id and the fields asked for ("title, score"), in the order of the table; unknown names are ignored, none means all."""
    wanted = {f.strip() for f in (fields or "").split(",")} - {""}
    return df.select(*(c for c in df.columns if c == "id" or c in wanted)) if wanted else df


class Memory:
    """Vectors of the texts that were asked for last, so that a model is asked once for each."""

    def __init__(self, embed: Callable[[str], list[float]], most: int = 1000):
        self.embed, self.most, self.known = embed, most, OrderedDict()

    def __call__(self, text: str) -> list[float]:
        if text not in self.known:
            self.known[text] = self.embed(text)
            if len(self.known) > self.most:
                self.known.popitem(last=False)
        self.known.move_to_end(text)
        return self.known[text]


class Engine:
    def __init__(self, tables: dict[str, DataFrame], embed: Callable[[str], list[float]] | None = None, rewrite: Callable[[str], str] | None = None, imagine: Callable[[str], str] | None = None,
                 rerank: Callable[[DataFrame], DataFrame] | None = None, boosts: R.Boosts = R.Boosts(), now: Callable[[], datetime] = lambda: Q.utc_now()):
        """``embed``: text to vector; ``rewrite``: a query in other words; ``imagine``: an answer whose vector is searched instead of the query's."""
        self.tables, self.rewrite, self.imagine, self.rerank, self.boosts, self.now = tables, rewrite, imagine, rerank, boosts, now
        self.embed = Memory(embed) if embed else None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(f"no table {name!r}") from None

    # --- searches ---

    def _rows(self, workspace: str | None, tags: list[str] | None, collection: str | None, chunk_type: str | None, updated: tuple, created: tuple) -> DataFrame:
        if chunk_type is not None and chunk_type not in CHUNK_TYPES:
            raise ValueError(f"chunk_type is one of {CHUNK_TYPES}")
        own = None if workspace in (None, ALL) else workspace
        return L.filtered(self.chunks, self.documents, own, tags, collection, chunk_type, updated, created)

    def _times(self, bounds: tuple) -> tuple:
        """Bounds as they are, or texts such as 7d, counted back from now."""
        return tuple(Q.parse_time(b, self.now()).replace(tzinfo=None) if isinstance(b, str) and b else b or None for b in bounds)

    def _shown(self, ranked: DataFrame, query: str, size: int = 700) -> DataFrame:
        """Ranked chunks (id, score) with what a result shows of them and of their documents; a few rows."""
        ids = [r.id for r in ranked.select("id").collect()]
        found = self.chunks.filter(F.col("id").isin(ids) if ids else F.lit(False)).select("id", "document_id", "chunk_index", "content", "workspace_hash")
        docs = self.documents.select(F.col("id").alias("document_id"), "title", "source_path", "collection", "tags", "created_at", "updated_at")
        rows = F.broadcast(found.join(F.broadcast(ranked), "id")).join(docs, "document_id")
        return rows.withColumn("snippet", R.snippet(F.col("content"), query, size)).orderBy(F.desc("score"), "id")

    def search(self, query: str, workspace: str | None = None, k: int | None = None, tags: list[str] | None = None, collection: str | None = None, chunk_type: str | None = None, updated: tuple = (None, None),
               created: tuple = (None, None), mode: str = "document", fields: str | None = None) -> DataFrame:
        """Lexical search. A query that finds nothing asks for any of its words, if two of them carry meaning and neither tags nor times narrow it."""
        k = clamp(k, RESULTS, MOST_RESULTS)
        rows = self._rows(workspace, tags, collection, chunk_type, self._times(updated), self._times(created))
        ranked = L.search(rows, L.web_query(query), k)
        terms = Q.relaxed_terms(query)
        if not tags and not any((*updated, *created)) and len(terms) >= 2 and ranked.isEmpty():
            ranked = L.search(rows, L.any_query(terms), k)
        shown = self._shown(ranked, query)
        return project(R.best_of_documents(shown) if mode == "document" else shown, fields)

    def vsearch(self, query: str | list[float], workspace: str | None = None, k: int | None = None, tags: list[str] | None = None, mode: str = "document", fields: str | None = None) -> DataFrame:
        """Vector search; more rows than asked for are looked at, so that a document's chunks do not crowd out others."""
        k = clamp(k, RESULTS, MOST_RESULTS)
        ranked = self._vector_leg(query, self._rows(workspace, tags, None, None, (None, None), (None, None)), 3 * k)
        shown = self._shown(ranked, query if isinstance(query, str) else "")
        return project(page(R.best_of_documents(shown) if mode == "document" else shown, [F.desc("score"), "id"], k), fields)

    def _vector_leg(self, query: str | list[float], rows: DataFrame, depth: int) -> DataFrame:
        if isinstance(query, str):
            if self.embed is None:
                raise ValueError("a vector search for a text needs an embedding model")
            query = self.embed(query)
        own = self.embeddings.join(rows.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        return R.vector_search(own, query, depth, "chunk_id")

    def query(self, query: str, workspace: str | None = None, k: int | None = None, tags: list[str] | None = None, collection: str | None = None, chunk_type: str | None = None, updated: tuple = (None, None),
              created: tuple = (None, None), mode: str = "document", fields: str | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """(results, cursor of the next page or None): hybrid search.

        Words such as "last 7 days" bound the time of change unless bounds are given. A leg that fails is left out; if
        both fail, that is an error. Grouping by document comes after the cut, so a page may be short.
        """
        k = clamp(k, RESULTS, MOST_RESULTS)
        key = Q.filter_key(query, tags or [], workspace or ALL, [collection or "", chunk_type or ""], [str(t or "") for t in (*updated, *created)])
        offset = Q.decode_cursor(cursor, key) if cursor else 0
        asked = self._tried("rewriting", lambda: self.rewrite(query)) or query if self.rewrite else query
        meant = Q.temporal_intent(query, self.now()) if not any((*updated, *created)) else None
        bounds = tuple(t and t.replace(tzinfo=None) for t in meant) if meant else self._times(updated)
        rows = self._rows(workspace, tags, collection, chunk_type, bounds, self._times(created))
        depth = max(3 * (offset + k + 1), 30)
        legs = {}
        lexical = self._tried("lexical search", lambda: L.relaxed(rows, asked, depth)[0])
        if lexical is not None:
            legs["lexical"] = lexical
        if self.embed is not None:
            goal = self._tried("imagining", lambda: self.imagine(asked)) or asked if self.imagine else asked
            vector = self._tried("vector search", lambda: self._vector_leg(goal, rows, depth))
            if vector is not None:
                legs["vector"] = vector
        if not legs:
            raise RuntimeError("all legs of the search failed")
        docs = self.documents.select(F.col("id").alias("document_id"), "title", "source_path", "updated_at")
        found = self.chunks.select("id", "document_id", "content").join(docs, "document_id")
        fine = workspace not in (None, ALL)
        best = R.hybrid(legs, found, asked, self.now().strftime("%Y-%m-%d %H:%M:%S"), offset + k + 1, self.boosts, self.tables.get("entities") if fine else None, self.tables.get("pagerank") if fine else None, self._rerank(), depth=depth)
        ordered = best.withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))  # offset + k + 1 rows at most
        more = ordered.filter(F.col("__r") > offset + k).limit(1).count() > 0
        shown = ordered.filter(F.col("__r").between(offset + 1, offset + k)).drop("__r")
        shown = R.best_of_documents(shown) if mode == "document" else shown
        return project(shown.orderBy(F.desc("score"), "id"), fields), Q.encode_cursor(offset + k, key) if more else None

    def _rerank(self):
        """The reranker, or the rows as they are where it fails."""
        if self.rerank is None:
            return None
        return lambda df: (lambda made: df if made is None else made)(self._tried("reranking", lambda: self.rerank(df)))

    def _tried(self, what: str, run: Callable):
        try:
            return run()
        except Exception as e:  # noqa: BLE001 - a search goes on without a part that fails
            log.warning("%s failed: %s", what, e)
            return None

    # --- documents ---

    def get(self, path: str, workspace: str, start: int = 0, end: int = 0) -> DataFrame:
        """The document of a path, an id ("#id" or bare; a chunk's id names its document) or a node "file::Symbol", or no row.

        ``start`` and ``end`` are lines, from 1, both inclusive. A symbol's document shows its file's lines, those of the
        symbol (start_line, end_line of its metadata) unless others are asked for.
        """
        docs = where(self.documents, workspace_hash=workspace)
        if "::" in path:
            file, _, name = path.partition("::")
            hits = docs.filter((F.col("title") == name) & (S.json_text("metadata", "source_type") == "symbol") & (F.split_part("source_path", F.lit("?"), F.lit(1)) == file))
        else:
            key = path.removeprefix("#")
            of_chunk = self.chunks.filter((F.col("id").cast("string") == key) & (F.col("workspace_hash") == workspace)).select(F.col("document_id").alias("id"))
            hits = docs.filter(F.col("id").cast("string") == key).union(docs.join(of_chunk, "id", "left_semi"))
            if not path.startswith("#"):
                hits = hits.union(docs.filter(F.col("source_path") == path))
        one = hits.orderBy("id").limit(1)
        is_symbol = S.json_text("metadata", "source_type") == "symbol"
        files = docs.select(F.col("source_path").alias("__file"), F.col("content").alias("__whole"))
        one = one.withColumn("__file", F.when(is_symbol, F.split_part("source_path", F.lit("?"), F.lit(1)))).join(files, "__file", "left")
        first = F.lit(start) if start or end else F.coalesce(F.when(F.col("__whole").isNotNull(), S.json_text("metadata", "start_line").cast("int")), F.lit(0))
        last = F.lit(end) if start or end else F.coalesce(F.when(F.col("__whole").isNotNull(), S.json_text("metadata", "end_line").cast("int")), F.lit(0))
        return one.withColumn("content", lines(F.coalesce("__whole", "content"), first, last)).select(*docs.columns)

    def multi_get(self, keys: list[str], workspace: str) -> tuple[DataFrame, DataFrame]:
        """(key and document of each key that is a path or an id, in their order; the keys that are none)."""
        asked = F.broadcast(self.documents.sparkSession.createDataFrame([(k, n) for n, k in enumerate(dict.fromkeys(keys))], "key string, place int"))  # the keys of one request
        docs = where(self.documents, workspace_hash=workspace)
        tried = docs.withColumn("__key", F.explode(F.array_distinct(F.array("source_path", F.col("id").cast("string")))))
        found = tried.join(asked, F.col("__key") == F.col("key"))
        first = found.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("__r = 1")
        return first.orderBy("place").select("key", *docs.columns), asked.join(first.select("key"), "key", "left_anti").orderBy("place").select("key")

    def write(self, new: DataFrame) -> dict[str, DataFrame]:
        """documents, chunks and edges after documents were written: upserted by path, chunked anew (chunks that are left over go), links drawn."""
        docs = S.upsert_documents(self.documents, new)
        keys = new.filter(F.coalesce("source_path", F.lit("")) != "").select("source_path", "workspace_hash").distinct()
        written = docs.join(keys, ["source_path", "workspace_hash"], "left_semi").unionByName(new.filter(F.coalesce("source_path", F.lit("")) == "").select(*docs.columns)).select(*docs.columns)
        pieces = X.chunk(written).join(written.select("id", "workspace_hash", "created_at"), "id")
        fresh = pieces.select(F.concat_ws(":", "id", "chunk_index").alias("id"), F.col("id").alias("document_id"), "workspace_hash", "chunk_index", F.col("chunk").alias("content"), F.col("chunk_hash").alias("content_hash"), F.lit("pending").alias("embed_status"), F.lit("raw").alias("chunk_type"), "created_at")
        for c in self.chunks.columns:
            if c not in fresh.columns:
                fresh = fresh.withColumn(c, F.lit(None).cast(self.chunks.schema[c].dataType))
        return {"documents": docs, "chunks": S.replace_chunks(self.chunks, fresh.select(*self.chunks.columns), written.select(F.col("id").alias("document_id"))), "edges": S.replace_links(self.edges, written, docs)}

    def delete(self, path: str, workspace: str) -> dict[str, DataFrame]:
        """documents, chunks, embeddings and edges without a document and what belongs to it."""
        doomed = self.get(path, workspace).select(F.col("id").alias("document_id"))
        gone = self.chunks.join(doomed, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
        return {
            "documents": delete_keys(self.documents, doomed.withColumnRenamed("document_id", "id"), ["id"]), "chunks": delete_keys(self.chunks, doomed, ["document_id"]), "embeddings": delete_keys(self.embeddings, gone, ["chunk_id"]),
            "edges": self.edges.join(doomed.select(F.col("document_id").cast("string").alias("source_node"), F.lit("references").alias("edge_type")), ["source_node", "edge_type"], "left_anti").select(*self.edges.columns),
        }

    def listed(self, workspace: str | None = None, tags: list[str] | None = None, collection: str | None = None, k: int | None = None, updated: tuple = (None, None)) -> DataFrame:
        rows = within(where(self.documents, workspace_hash=workspace, collection=collection), "updated_at", *self._times(updated))
        if tags:
            rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
        return page(rows.drop("content"), [F.desc("updated_at"), "id"], clamp(k, RESULTS, MOST_RESULTS))

    def ticket(self, name: str, k: int | None = None) -> DataFrame:
        """The sessions of all workspaces that are about a ticket, latest first."""
        return S.documents_by_tag(self.documents, f"ticket:{name.upper()}", None, "sessions", clamp(k, 50, 50))

    def tags(self, workspace: str | None = None) -> DataFrame:
        return S.tag_counts(self.documents, workspace)

    def symbols(self, workspace: str, text: str = "", kind: str = "", k: int | None = None) -> DataFrame:
        return S.list_symbols(self.documents, workspace, text, kind, clamp(k, SYMBOLS, MOST_SYMBOLS))

    # --- workspaces ---

    def wake_up(self, workspace: str, k: int | None = None, collections: list[str] | None = None) -> dict[str, DataFrame]:
        """What one needs to know at the beginning: recent documents, how many there are and since when, chunks, collections."""
        own = where(self.documents, workspace_hash=workspace)
        return {
            "recent": S.recent_documents(self.documents, workspace, collections, clamp(k, BRIEFING, MOST_BRIEFING)), "stats": own.agg(F.count("*").alias("documents"), F.max("updated_at").alias("last_updated")),
            "chunks": where(self.chunks, workspace_hash=workspace).agg(F.count("*").alias("chunks")), "collections": S.collections_with_counts(self.collections, own, workspace),
        }

    def briefing(self, workspace: str, k: int | None = None) -> str:
        """The same as Markdown."""
        parts = {name: df.collect() for name, df in self.wake_up(workspace, k).items()}  # k rows and a row for each collection
        head = f"{parts['stats'][0].documents} documents, {parts['chunks'][0].chunks} chunks, last change {parts['stats'][0].last_updated}"
        return "\n".join([f"# {workspace}", "", head, "", "## Collections", *(f"- {r.name}: {r.doc_count}" for r in parts["collections"]), "", "## Recent", *(f"- {r.title}" for r in parts["recent"])])

    def dashboard(self, workspace: str | None = None) -> DataFrame:
        """section, name, n: documents by collection, chunks by state, edges by kind, the most used tags, embeddings."""
        docs, chunks = where(self.documents, workspace_hash=workspace), where(self.chunks, workspace_hash=workspace)
        count = lambda df, section, name: df.groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
        held = self.embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").agg(F.count("*").alias("n"))
        parts = [count(docs, "collection", "collection"), count(chunks, "embed_status", "embed_status"), count(where(self.edges, workspace_hash=workspace), "edge_type", "edge_type")]
        parts += [S.tag_counts(docs, None, 20).select(F.lit("tag"), "tag", "n"), held.select(F.lit("embeddings"), F.lit("all"), "n")]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def resolve(self, given: str) -> DataFrame:
        """The workspace of a hash, a prefix or a name; of a path the deepest registered directory above it, if there is one."""
        if not given.startswith("/"):
            return S.resolve_workspace(self.workspaces, given)
        asked = self.workspaces.sparkSession.createDataFrame([(given.rstrip("/"),)], "path string")
        best = X.best_prefix(asked, self.workspaces.select(F.rtrim("path", F.lit("/")).alias("prefix")))
        return self.workspaces.join(best.select(F.col("prefix").alias("__p")), F.rtrim("path", F.lit("/")) == F.col("__p"), "left_semi")

    def remove(self, workspace: str) -> dict[str, DataFrame]:
        """All tables without a workspace and its rows; embeddings go with their chunks."""
        gone = self.chunks.filter(F.col("workspace_hash") == workspace).select(F.col("id").alias("chunk_id"))
        children = {n: t for n, t in self.tables.items() if n != "workspaces" and "workspace_hash" in t.columns}
        return S.delete_workspace(workspace, self.workspaces, **children) | {"embeddings": delete_keys(self.embeddings, gone, ["chunk_id"])}

    def reset(self, workspace: str) -> dict[str, DataFrame]:
        """The same, but the workspace stays registered, empty."""
        return self.remove(workspace) | {"workspaces": self.workspaces}

    # --- graph ---

    def graph(self, node: str, direction: str = "out", workspace: str | None = None, kinds: list[str] | None = None) -> DataFrame:
        return G.neighbours(where(self.edges, workspace_hash=workspace), node, direction, kinds)

    def trace(self, node: str, workspace: str | None = None, depth: int = 5) -> DataFrame:
        return G.trace(where(self.edges, workspace_hash=workspace), self._node(node), depth)

    def impact(self, node: str, workspace: str | None = None, depth: int = 1) -> DataFrame:
        return G.impact(where(self.edges, workspace_hash=workspace), self._node(node), depth)

    def _node(self, node: str) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(node,)], "node string")

    def flow(self, asked: str, workspace: str | None = None, depth: int = 10, fanout: int = 8, stitched: bool = True) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of an endpoint's flow, with the consumers of what it publishes, in whatever workspace they are."""
        own = where(self.edges, workspace_hash=workspace)
        ends = [r.entry for r in W.resolve_entry(own, asked).limit(2).collect()]
        nodes, drawn = W.build_flow(own, ends[0] if len(ends) == 1 else asked, depth, fanout)
        if not stitched:
            return nodes, drawn
        topic = lambda verb: F.regexp_replace("target_node", f"^{verb} ", "")
        sends = self.edges.filter(F.startswith("target_node", F.lit("PUBLISH "))).select(topic("PUBLISH").alias("topic"), F.col("source_node").alias("node"), "workspace_hash")
        takes = self.edges.filter(F.startswith("target_node", F.lit("CONSUME "))).select(topic("CONSUME").alias("topic"), F.col("source_node").alias("node"), "workspace_hash")
        return W.with_consumers(nodes, drawn, G.stitch(sends, takes))


def lines(content, first, last):
    """The lines from ``first`` to ``last`` (from 1, both inclusive); 0 or less is the beginning, or the end."""
    parts = F.split(content, "\n")
    begin = F.greatest(first, F.lit(1))
    end = F.when(last > 0, F.least(last, F.size(parts))).otherwise(F.size(parts))
    return F.when((first <= 0) & (last <= 0), content).otherwise(F.array_join(F.slice(parts, begin, F.greatest(end - begin + 1, F.lit(0))), "\n"))
