"""Graph operators over an edge table (source_node, target_node, edge_type): walks, ranks, overviews, stitching.

Walks go level by level: each level joins the frontier with the edges, keeps the first way to each new node, and is
settled before the next one, so plans stay short. A node that was reached is never expanded again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import settled
from tessera.operators.merging import where
from tessera.operators.store import candidate_keys, degrees, edges_touching

EDGE = ["source_node", "target_node", "edge_type"]

def neighbours(edges: DataFrame, node: str, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """Edges of a node: out, in or both."""
    rows = where(edges, edge_type=kinds).select(*EDGE)
    hit = {"out": F.col("source_node") == node, "in": F.col("target_node") == node, "both": (F.col("source_node") == node) | (F.col("target_node") == node)}
    if direction not in hit:
        raise ValueError(f"unknown direction {direction!r}")
    return rows.filter(hit[direction]).orderBy(*EDGE)


def _walk(steps: DataFrame, start: DataFrame, depth: int, frontier_keys=None) -> DataFrame:
    """node, depth, via, edge_type of all nodes within ``depth`` steps; ``steps`` has near, far, edge_type.

    Of several ways to a node in one level the first by (edge_type, via) counts. Each level is settled once, by itself.
    """
    levels = [settled(start.select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("edge_type")).distinct())]
    reached = levels[0]
    for level in range(1, depth + 1):
        near = levels[-1].select("node")
        keys = frontier_keys(near) if frontier_keys else near.select("node", F.col("node").alias("key"))
        ways = keys.join(steps, F.col("key") == F.col("near")).select(F.col("far"), F.struct("edge_type", F.col("node").alias("via")).alias("way"))
        new = ways.groupBy(F.col("far").alias("node")).agg(F.min("way").alias("way")).join(reached.select("node"), "node", "left_anti")
        levels.append(settled(new.select("node", F.lit(level).cast("long").alias("depth"), "way.via", "way.edge_type")))
        if levels[-1].isEmpty():
            break
        reached = reached.union(levels[-1])
    return reached


def symbol_keys(nodes: DataFrame) -> DataFrame:
    """node, key: a bare name stands for itself and, over the edges of its kind, for every node with that symbol."""
    return nodes.select("node", F.col("node").alias("key")).union(nodes.filter(F.instr("node", "::") == 0).select("node", F.concat(F.lit("::"), "node").alias("key")))


def trace(edges: DataFrame, start: DataFrame, depth: int = 5, kinds: list[str] | None = ("calls",)) -> DataFrame:
    """Forward walk; a bare name goes on from every node with that symbol. Depths out of 1 to 10 become 5."""
    depth = depth if 1 <= depth <= 10 else 5
    own = where(edges, edge_type=kinds)
    # A bare name is looked for among the sources' symbols too: each qualified source also stands under "::symbol".
    near = F.when(F.instr("source_node", "::") > 0, F.array("source_node", F.concat(F.lit("::"), F.substring_index("source_node", "::", -1)))).otherwise(F.array("source_node"))
    steps = own.select(F.explode(near).alias("near"), F.col("target_node").alias("far"), "edge_type")
    return _walk(steps, start, depth, symbol_keys)


def impact(edges: DataFrame, start: DataFrame, depth: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """Reverse walk; a qualified node is also looked for by its bare symbol. Depths out of 1 to 3 become 1."""
    depth = depth if 1 <= depth <= 3 else 1
    steps = where(edges, edge_type=kinds).select(F.col("target_node").alias("near"), F.col("source_node").alias("far"), "edge_type")
    return _walk(steps, start, depth, candidate_keys)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges between them). Depths out of 1 to 5 are an error; ``most`` keeps the nearest nodes."""
    nodes, _ = _near(edges, start, depth, direction, most)
    inside = edges.join(nodes.select(F.col("node").alias("source_node")), "source_node", "left_semi").join(nodes.select(F.col("node").alias("target_node")), "target_node", "left_semi")
    return nodes, inside.select(*EDGE).distinct()


def _near(edges: DataFrame, start: DataFrame, depth: int, direction: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    out = edges.select(F.col("source_node").alias("near"), F.col("target_node").alias("far"), "edge_type")
    into = edges.select(F.col("target_node").alias("near"), F.col("source_node").alias("far"), "edge_type")
    every = _walk({"out": out, "in": into, "both": out.union(into)}[direction], start, depth).select("node", "depth")
    return (every if most is None else settled(every.orderBy("depth", "node").limit(most))), every


def neighbourhood_facts(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: nodes, total, truncated; the frontier: nodes of the neighbourhood with an edge that leads out of it)."""
    nodes, every = _near(edges, start, depth, direction, most)
    ends = edges.select(F.col("source_node").alias("a"), F.col("target_node").alias("b"))
    both = ends.union(ends.select(F.col("b"), F.col("a")))
    leading = both.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_anti").select(F.col("a").alias("node")).distinct()
    facts = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(every.agg(F.count("*").alias("total"))))  # one row each
    return facts.withColumn("truncated", F.col("nodes") < F.col("total")), leading


def document_nodes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` that are ids of documents, with title, collection and tags (null for others)."""
    known = docs.select(F.col("id").cast("string").alias("node"), "title", "collection", "tags")
    return nodes.join(known, "node", "left")


# How many nodes an overview has if none are asked for, at most, and how many edges it shows.
OVERVIEW, MOST_OVERVIEW, OVERVIEW_EDGES = 50, 200, 400


def overview(edges: DataFrame, kinds: list[str] | None, top: int = OVERVIEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the nodes of the largest degree, the first edges that touch them, one row: total nodes, truncated).

    Without a positive ``top`` it is 50, above 200 it is 200.
    """
    top = min(top, MOST_OVERVIEW) if top > 0 else OVERVIEW
    own = where(edges, edge_type=kinds)
    nodes = settled(degrees(own, limit=top))
    total = own.select(F.explode(F.array("source_node", "target_node")).alias("node")).agg(F.countDistinct("node").alias("total"))
    return nodes, edges_touching(own, nodes, OVERVIEW_EDGES), total.withColumn("truncated", F.col("total") > top)


#: Edges of one source in one place; a source of more is spread over several.
HUB = 1 << 20
#: Iterations between two checkpoints where no change is asked for.
STRETCH = 5


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score in [0, 1]: parallel edges count each, mass of nodes without edges is lost, the greatest score is 1.

    The shares that edges carry are dealt by their source once and stay there, so an iteration moves ranks and sums only;
    a source of more than HUB edges lies in several places, and its rank goes to each. Shares that are lost with an
    executor are made again from the checkpoint.
    """
    counted = settled(edges.groupBy("source_node", "target_node").agg(F.count("*").alias("n")))
    out = counted.groupBy("source_node").agg(F.sum("n").alias("out"), (F.floor(F.count("*") / HUB) + 1).alias("places"))
    ends = counted.select(F.explode(F.array("source_node", "target_node")).alias("node")).distinct()
    nodes = settled(ends.join(out.select(F.col("source_node").alias("node"), "places"), "node", "left").select("node", F.coalesce("places", F.lit(1).cast("long")).alias("places")))
    shares = counted.join(out, "source_node").select("source_node", F.pmod(F.xxhash64("target_node"), F.col("places")).alias("place"), "target_node", (F.col("n") / F.col("out")).alias("share"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("score"))
    # A number of partitions of its own keeps the cached shares as they are dealt; ranks come to them.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shares.repartition(parts, "source_node", "place").sortWithinPartitions("source_node", "place").persist()
    nodes = nodes.repartition(parts, "node").sortWithinPartitions("node").persist()
    try:
        ranks = nodes.select("node", "places", F.lit(1.0 / n).alias("score"))
        for number in range(1, iterations + 1):
            sent = ranks.filter("score > 0").select(F.col("node").alias("source_node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), "score")
            given = dealt.join(sent, ["source_node", "place"]).groupBy(F.col("target_node").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("given"))
            before, ranks = ranks, nodes.join(given, "node", "left").select("node", "places", ((1 - damping) / n + damping * F.coalesce("given", F.lit(0.0))).alias("score"))
            if tolerance > 0 or number % STRETCH == 0 or number == iterations:
                ranks = settled(ranks)
            if tolerance > 0 and ranks.join(before.select("node", F.col("score").alias("was")), "node").agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] < tolerance:
                break
    finally:
        dealt.unpersist()
        nodes.unpersist()
    top = ranks.agg(F.max("score").alias("__top"))  # one row
    return ranks.crossJoin(F.broadcast(top)).select("node", (F.col("score") / F.col("__top")).alias("score"))


def refreshed_scores(edges: DataFrame, scores: DataFrame | None, counted: int | None, share: float = 0.1) -> tuple[DataFrame, int, bool]:
    """(scores, call edges that they are of, whether they are new): ranks are computed anew once call edges changed by more than ``share``."""
    calls = where(edges, edge_type="calls")
    n = calls.count()
    if scores is not None and counted is not None and abs(n - counted) <= share * max(1, counted):
        return scores, counted, False
    return settled(pagerank(calls)), n, True


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: the least id that each linked id reaches.

    Each round every id takes its least neighbour as its parent, parents are followed to their ends (each step doubles
    the way), and links are drawn between these ends instead; links within one go. Stars and chains take one round.
    """
    edges = settled(links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    roots = None
    while roots is None or not edges.isEmpty():
        both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))
        parent = settled(edges.select(F.explode(both).alias("e")).groupBy("e.id").agg(F.least(F.col("id"), F.min("e.to")).alias("root")))
        moving = True
        while moving:
            above = parent.select(F.col("id").alias("root"), F.col("root").alias("far"))
            jumped = settled(parent.join(above, "root").select("id", "root", "far"))
            moving = not jumped.filter("root <> far").isEmpty()
            parent = jumped.select("id", F.col("far").alias("root"))
        side = lambda c: parent.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        drawn = edges.join(side("a"), "a").join(side("b"), "b").filter("ra <> rb")
        edges = settled(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        step = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
        roots = parent if roots is None else settled(roots.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    return roots


def stitch(publishers: DataFrame, consumers: DataFrame) -> DataFrame:
    """topic, publisher, consumer and their workspaces (first 8 characters): equal topics that are no variables."""
    p = publishers.filter(~F.startswith("topic", F.lit("<var:"))).select("topic", F.col("node").alias("publisher"), F.left("workspace_hash", F.lit(8)).alias("from_workspace"))
    c = consumers.select("topic", F.col("node").alias("consumer"), F.left("workspace_hash", F.lit(8)).alias("to_workspace"))
    return p.join(c, "topic").distinct()


def context_hash(edges: DataFrame) -> DataFrame:
    """node, hash of its sorted callers and callees."""
    calls = edges.filter("edge_type = 'calls'")
    ins = calls.groupBy(F.col("target_node").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("source_node")), ",").alias("callers"))
    outs = calls.groupBy(F.col("source_node").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("target_node")), ",").alias("callees"))
    return ins.join(outs, "node", "full_outer").select("node", F.sha2(F.concat(F.coalesce("callers", F.lit("")), F.lit("|"), F.coalesce("callees", F.lit(""))), 256).alias("hash"))


def common_steps(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(0))), lambda p, q: p.eqNullSafe(q) & p.isNotNull())
    return F.coalesce(F.array_position(pairs, False) - 1, F.size(pairs).cast("long")) + F.when(F.array_position(pairs, False) == 0, F.size(pairs) + 1).otherwise(0)


def nearest_definition(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """use_id, path, symbol, target: the definition of the symbol with the longest common directory; a tie is left open (null).

    ``uses``: use_id, path, symbol; ``definitions``: path, symbol, target. Uses and definitions meet by the symbol and a
    directory that both lie in, of which each has as many as it has steps; a directory that holds several targets of a
    symbol keeps two of them, which is enough to see a tie. So common names make no pairs of all uses and definitions.
    """
    def folders(path: Column) -> Column:
        steps = F.split(path, "/")
        return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("folder")))

    above = definitions.select("symbol", "target", F.explode(folders(F.col("path"))).alias("f")).groupBy("symbol", F.col("f.folder").alias("folder")).agg(F.min("target").alias("low"), F.max("target").alias("high"))
    tried = uses.select("use_id", "path", "symbol", F.explode(folders(F.col("path"))).alias("f")).select("use_id", "path", "symbol", "f.depth", "f.folder")
    best = tried.join(above, ["symbol", "folder"], "left").groupBy("use_id", "path", "symbol").agg(F.max_by(F.struct("low", "high"), F.when(F.col("low").isNotNull(), F.col("depth"))).alias("t"))
    return best.select("use_id", "path", "symbol", F.when(F.col("t.low") == F.col("t.high"), F.col("t.low")).alias("target"))


def changed_symbols(files: DataFrame, definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """path, symbol, caller of everything defined in the changed files, callers one step away."""
    own = definitions.join(files.select("path").distinct(), "path", "left_semi")
    return own.join(edges.filter("edge_type = 'calls'").select("source_node", "target_node"), F.col("target") == F.col("target_node"), "left").select("path", "symbol", F.col("source_node").alias("caller"))
