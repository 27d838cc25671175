"""Flows of endpoints over a code graph: handlers, calls across files, guards and integrations, level by level.

An edge has source_node (file::symbol, a bare symbol or "METHOD /path"), target_node, edge_type, source_file and line.
Calls name their targets without files, so a name is reconciled with the definitions that have it: with those in the
caller's own file if there are any, else with all of them, unless they lie in more than MOST_FILES files, as names that
mean nothing do. Each level is a handful of joins on equality; a definition is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import settled

# In how many files a name may be defined; names of logging that are hidden wherever they are defined;
# beginnings and endings of names of logging and output that are hidden where the workspace does not define them.
MOST_FILES = 8
LOGGING = ("log", "info", "warn", "warning", "error", "debug", "trace", "fatal", "calllog", "addlog", "addlogstripe", "getlogprefix")
NOISE_STARTS = ("console.", "log.", "fmt.print", "fmt.sprint", "fmt.fprint", "process.stdout", "process.stderr", "system.out", "system.err", "rails.logger", "logger.", "puts ", "p ", "pp ")
NOISE_ENDS = (".log", ".debug", ".trace", ".info", ".warn", ".warning", ".error")
# Parts of names that tell a role, in the order in which they are tried.
ROLES = (("service", "service|svc"), ("repository", "repository|repo|store|model"))
NODE = "node string, role string, depth long, ambiguous boolean"
EDGE = "from_node string, to_node string, edge_type string, line long"


def symbol(node: Column) -> Column:
    """What follows the last "::", or the whole name."""
    return F.substring_index(node, "::", -1)


def role(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("function")
    for found, pattern in reversed(ROLES):
        out = F.when(F.rlike(low, F.lit(pattern)), found).otherwise(out)
    return out


def hidden(target: Column, defined: Column) -> Column:
    """Whether a callee is left out of flows."""
    low = F.lower(target)
    outside = F.contains(low, F.lit("logger"))
    for s in NOISE_STARTS:
        outside = outside | F.startswith(low, F.lit(s))
    for s in NOISE_ENDS:
        outside = outside | F.endswith(low, F.lit(s))
    return low.isin(*LOGGING) | (~defined & outside)


def build_flow(edges: DataFrame, entry: str, depth: int = 10, fanout: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, role, depth, ambiguous; edges: from_node, to_node, edge_type, line) of an endpoint's flow.

    Handlers are the targets of the entry's http edges; a plain name without them is its own handler, also with
    #perform. Middleware of a handler is a guard. A definition's calls go to its first ``fanout`` callees by line and
    name; integrations are leaves and do not count; a reconcile edge takes over what its target does. Names of logging
    are hidden, of callees from outside also those of output. Placeholders and pieces of code are no integrations.
    """
    spark = edges.sparkSession
    lines = F.col("line").cast("long") if "line" in edges.columns else F.lit(None).cast("long")
    own = settled(edges.select("source_node", "target_node", "edge_type", "source_file", lines.alias("line"), symbol(F.col("source_node")).alias("symbol")))
    names = settled(own.groupBy(F.col("symbol").alias("name")).agg(F.countDistinct("source_file").alias("files")))
    definitions = settled(own.filter("edge_type IN ('calls', 'reconcile')").groupBy("source_node", "symbol").agg(F.min("source_file").alias("file"), F.max(F.col("edge_type") == "reconcile").alias("reconciles")))

    start = [r[0] for r in own.filter((F.col("source_node") == entry) & (F.col("edge_type") == "http")).select("target_node").distinct().orderBy("target_node").collect()]  # an endpoint's handlers
    handlers = start or ([] if " " in entry else [entry] if "#" in entry else [entry, f"{entry}#perform"])
    nodes = [(entry, "entry", 0, False)] + [(h, "handler", 0, False) for h in start]
    drawn = [(entry, h, "http", None) for h in start]
    guards = own.filter((F.col("edge_type") == "middleware") & F.col("target_node").isin(handlers)) if handlers else own.limit(0)
    all_nodes = spark.createDataFrame(nodes, NODE).union(guards.select(F.col("source_node"), F.lit("middleware"), F.lit(0).cast("long"), F.lit(False)).distinct())
    all_edges = spark.createDataFrame(drawn, EDGE).union(guards.select("source_node", "target_node", F.lit("middleware"), F.lit(None).cast("long")).distinct())

    frontier = spark.createDataFrame([(h, "") for h in handlers], "name string, parent string")
    seen: list[DataFrame] = []
    for level in range(depth):
        sources = _reconciled(frontier, definitions)
        for earlier in seen:
            sources = sources.join(earlier, "source_node", "left_anti")
        # A definition that several names of a level lead to belongs to the first.
        sources = settled(sources.groupBy("source_node").agg(F.min(F.struct("name", "file")).alias("s")).select("source_node", "s.name", "s.file"))
        if sources.isEmpty():
            break
        seen.append(sources.select("source_node"))
        out = _outgoing(sources, own).join(names.select(F.col("name").alias("target_node"), "files"), "target_node", "left")
        out = out.withColumn("kept", F.when(F.col("edge_type") == "integration", ~F.contains("target_node", F.lit("<var:")) & ~F.rlike("target_node", F.lit(r"[\n\r]"))).when(F.col("edge_type") == "calls", ~hidden(F.col("target_node"), F.col("files").isNotNull())).otherwise(True)).filter("kept")
        order = Window.partitionBy("source_node", "edge_type").orderBy(F.col("line").asc_nulls_last(), "target_node")
        out = settled(out.withColumn("place", F.row_number().over(order)).filter((F.col("edge_type") != "calls") | (F.col("place") <= fanout)))
        shown = F.when(F.col("edge_type") == "reconcile", symbol(F.col("target_node"))).otherwise(F.col("target_node"))
        part = F.when(F.col("edge_type") == "integration", "integration").when(F.col("edge_type") == "reconcile", role(shown)).when(F.col("files").isNull(), "external").otherwise(role(shown))
        all_nodes = all_nodes.union(out.select(shown, part, F.lit(level + 1).cast("long"), F.coalesce(F.col("files") > 1, F.lit(False))))
        all_edges = all_edges.union(out.filter("edge_type <> 'reconcile'").select("name", "target_node", "edge_type", "line"))
        frontier = settled(out.filter("edge_type = 'calls' AND files IS NOT NULL").select(F.col("target_node").alias("name"), "parent").distinct())
        if frontier.isEmpty():
            break
    # The first role of a node counts; of one level the first by name.
    first = all_nodes.groupBy("node").agg(F.min(F.struct("depth", "role")).alias("f"), F.max("ambiguous").alias("ambiguous"))
    return first.select("node", "f.role", "f.depth", "ambiguous"), all_edges.distinct()


def _reconciled(frontier: DataFrame, definitions: DataFrame) -> DataFrame:
    """name, source_node, file of the definitions that each (name, parent) of the frontier stands for."""
    by_name = frontier.join(definitions, F.col("name") == F.col("symbol")).select("name", "parent", "source_node", "file", "reconciles")
    known = by_name.select("name").distinct()
    exact = frontier.join(known, "name", "left_anti").join(definitions, F.col("name") == F.col("source_node")).select("name", "parent", "source_node", "file", "reconciles")
    found = by_name.union(exact)
    facts = found.groupBy("name", "parent").agg(F.countDistinct("file").alias("files"), F.max((F.col("file") == F.col("parent")) & (F.col("parent") != "")).alias("same"))
    chosen = found.join(facts, ["name", "parent"])
    keep = F.when(F.col("same"), F.col("file") == F.col("parent")).otherwise(F.col("files") <= MOST_FILES)
    return chosen.filter(keep | F.col("reconciles")).select("name", "source_node", "file")


def _outgoing(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """name, source_node, target_node, edge_type, line, parent of what the sources do, and of what their reconcile edges lead to."""
    mine = ["source_node", "target_node", "edge_type", "line"]
    steps = edges.filter("edge_type IN ('calls', 'integration', 'reconcile')").select(*mine)
    direct = sources.join(steps, "source_node").select("name", "source_node", "target_node", "edge_type", "line", F.col("file").alias("parent"))
    led = direct.filter("edge_type = 'reconcile'").select("name", F.col("source_node").alias("by"), F.col("target_node").alias("source_node"))
    further = led.join(steps.filter("edge_type <> 'reconcile'"), "source_node").select("name", F.col("by").alias("source_node"), "target_node", "edge_type", "line", F.lit("").alias("parent"))
    return direct.union(further).distinct()


def service_name(edges: DataFrame, default: str = "Backend") -> DataFrame:
    """One row, service: the first directory that most source files have; ties go to the first by name."""
    path = F.regexp_replace(F.regexp_replace("source_file", "^[A-Za-z]:", ""), "^/+", "")
    counted = edges.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("s")).filter("s <> ''").groupBy("s").agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.min_by("s", F.struct(-F.col("n"), F.col("s"))), F.lit(default)).alias("service"))


def publishers(nodes: DataFrame) -> DataFrame:
    """node, topic of the publishing integrations that a flow reaches."""
    return nodes.filter("role = 'integration'").filter(F.rlike("node", F.lit("^PUBLISH "))).select("node", F.regexp_replace("node", "^PUBLISH ", "").alias("topic"))


def with_consumers(nodes: DataFrame, flow_edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A flow with the consumers of the topics that it publishes: ``links`` has topic, publisher, consumer (see stitch)."""
    reached = publishers(nodes).join(links.select("topic", "consumer").distinct(), "topic")
    more = reached.join(nodes.select(F.col("node").alias("consumer")), "consumer", "left_anti").select(F.col("consumer").alias("node"), F.lit("consumer").alias("role")).distinct()
    last = nodes.agg(F.max("depth").alias("d"))  # one row
    added = more.crossJoin(F.broadcast(last)).select("node", "role", (F.col("d") + 1).alias("depth"), F.lit(False).alias("ambiguous"))
    return nodes.union(added), flow_edges.union(reached.select("node", "consumer", F.lit("stitch"), F.lit(None).cast("long"))).distinct()


def resolve_entry(edges: DataFrame, asked: str) -> DataFrame:
    """entry of the endpoints that a request may mean: the node itself, a path with any method, or those whose path ends in it."""
    ends = edges.filter("edge_type = 'http'").select(F.col("source_node").alias("entry")).distinct()
    path = F.split_part("entry", F.lit(" "), F.lit(2))
    rank = F.when(F.col("entry") == asked, 0).when(path == asked, 1).when(F.endswith(path, F.lit(asked)), 2)
    best = ends.select("entry", rank.alias("r")).filter("r IS NOT NULL")
    least = best.agg(F.min("r").alias("least"))  # one row
    return best.join(F.broadcast(least), F.col("r") == F.col("least")).select("entry").orderBy("entry")


def flow_documents(nodes: DataFrame, flow_edges: DataFrame, entry: str, workspace: str) -> DataFrame:
    """The flow as a document to be upserted: workspace_hash, source_path, title, collection, tags, content (Markdown with a diagram)."""
    drawn = sequence_diagram(flow_edges)
    steps = nodes.agg(F.array_sort(F.collect_list(F.struct("depth", "node", "role"))).alias("ns"))  # the nodes of one flow
    listed = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("- "), n["node"], F.lit(" ("), n["role"], F.lit(")"))), "\n")
    text = F.concat(F.lit(f"# {entry}\n\n"), listed, F.lit("\n\n```mermaid\n"), F.col("diagram"), F.lit("\n```\n"))
    return steps.crossJoin(F.broadcast(drawn)).select(F.lit(workspace).alias("workspace_hash"), F.lit(f"flow://{entry}").alias("source_path"), F.lit(f"Flow: {entry}").alias("title"), F.lit("flows").alias("collection"), F.array(F.lit("flow")).alias("tags"), text.alias("content"))


def _label(name: Column) -> Column:
    return F.regexp_replace(name, "[\"<>\\[\\]{}|;#\\n]", " ")


def flow_chart(flow_edges: DataFrame) -> DataFrame:
    """One row, diagram: a Mermaid flowchart of the edges, in the order of their ends."""
    ident = lambda c: F.concat(F.lit("n"), F.left(F.sha2(c, 256), F.lit(10)))
    line = F.concat(F.lit("  "), ident(F.col("from_node")), F.lit('["'), _label(F.col("from_node")), F.lit('"] -->|'), F.col("edge_type"), F.lit("| "), ident(F.col("to_node")), F.lit('["'), _label(F.col("to_node")), F.lit('"]'))
    return flow_edges.select(line.alias("line")).agg(F.concat_ws("\n", F.lit("flowchart TD"), F.array_join(F.array_sort(F.collect_set("line")), "\n")).alias("diagram"))


def sequence_diagram(flow_edges: DataFrame) -> DataFrame:
    """One row, diagram: a Mermaid sequence diagram of the edges, by line and name."""
    row = F.struct(F.col("line").alias("at"), F.concat(F.lit("  "), _label(F.col("from_node")), F.lit("->>"), _label(F.col("to_node")), F.lit(": "), F.col("edge_type")).alias("text"))
    lines = F.transform(F.array_sort(F.collect_set(row)), lambda r: r["text"])
    return flow_edges.agg(F.concat_ws("\n", F.lit("sequenceDiagram"), F.array_join(lines, "\n")).alias("diagram"))


def invalidated(chunks: DataFrame, edges: DataFrame, changed: DataFrame, workspace: str, queue: int = 1000, most: int = 100) -> DataFrame:
    """``chunks`` with the graph context hash of the callers of ``changed`` (node) taken away, so that they are summarised anew.

    The feature's limits: at most ``most`` callers at a time, and no more than the queue of stale chunks has room for;
    the first by name.
    """
    stale = chunks.filter((F.col("workspace_hash") == workspace) & (F.col("chunk_type") == "symbol") & F.col("graph_context_hash").isNull()).limit(queue).count()
    room = max(0, min(most, queue - stale))
    keys = changed.select("node").union(changed.select(symbol(F.col("node")))).distinct()
    callers = edges.filter("edge_type = 'calls'").join(keys, F.col("target_node") == F.col("node"), "left_semi").select(symbol(F.col("source_node")).alias("symbol_name")).distinct().orderBy("symbol_name").limit(room)
    hit = F.broadcast(callers.withColumn("__hit", F.lit(True)))  # ``most`` rows at most
    cleared = F.when(F.col("__hit") & (F.col("workspace_hash") == workspace), F.lit(None)).otherwise(F.col("graph_context_hash"))
    return chunks.join(hit, "symbol_name", "left").withColumn("graph_context_hash", cleared).select(*chunks.columns)
