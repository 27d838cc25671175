"""Flows of small code graphs written here."""


from tessera.operators import flows as W
from tessera.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(s, t, k, f, n) for n, (s, t, k, f) in enumerate(rows)], "source_node string, target_node string, edge_type string, source_file string, line long")


def flow(spark, rows, entry="GET /u", **more):
    nodes, drawn = W.build_flow(edges(spark, rows), entry, **more)
    return {r.node: r.role for r in nodes.collect()}, {(r.from_node, r.to_node, r.edge_type) for r in drawn.collect()}


BASE = [("GET /u", "list", "http", "app/r.go"), ("auth", "list", "middleware", "app/r.go"), ("app/h.go::list", "UserService", "calls", "app/h.go"), ("app/s.go::UserService", "UserRepo", "calls", "app/s.go"), ("app/d.go::UserRepo", "db", "integration", "app/d.go"), ("app/d.go::UserRepo", "x", "calls", "app/d.go")]


def test_roles_guards_and_noise(spark):
    rows = [*BASE, ("app/h.go::list", "console.log", "calls", "app/h.go"), ("app/h.go::list", "Info", "calls", "app/h.go"), ("app/h.go::list", "my.info", "calls", "app/h.go"), ("app/i.go::my.info", "y", "calls", "app/i.go"), ("app/d.go::UserRepo", "<var:q>", "integration", "app/d.go"), ("app/d.go::UserRepo", "a\nb", "integration", "app/d.go")]
    roles, drawn = flow(spark, rows)
    assert roles == {"GET /u": "entry", "list": "handler", "auth": "middleware", "UserService": "service", "UserRepo": "repository", "db": "integration", "x": "external", "my.info": "function", "y": "external"}
    assert ("auth", "list", "middleware") in drawn and ("UserRepo", "db", "integration") in drawn and ("list", "Info", "calls") not in drawn


def test_fanout_depth_and_plain_entries(spark):
    rows = [*BASE, *[("app/h.go::list", f"z{k}", "calls", "app/h.go") for k in range(9)], ("app/h.go::list", "topic", "integration", "app/h.go")]
    roles, _ = flow(spark, rows, fanout=3)
    assert sum(n.startswith("z") for n in roles) == 2 and "topic" in roles
    assert "db" not in flow(spark, BASE, depth=2)[0] and flow(spark, BASE, depth=2)[0]["UserRepo"] == "repository"
    assert set(flow(spark, [("j.rb::Job#perform", "run", "calls", "j.rb")], "Job")[0]) == {"Job", "run"}
    assert flow(spark, BASE, "GET /none")[0] == {"GET /none": "entry"}


def test_names_are_reconciled_by_file(spark):
    generic = [(f"app/f{k}.go::get", f"g{k}", "calls", f"app/f{k}.go") for k in range(9)]
    rows = [("GET /u", "list", "http", "r"), ("app/h.go::list", "helper", "calls", "app/h.go"), ("app/h.go::list", "get", "calls", "app/h.go"), ("app/h.go::helper", "near", "calls", "app/h.go"), ("app/o.go::helper", "far", "calls", "app/o.go"), *generic]
    roles, _ = flow(spark, rows)
    assert "near" in roles and "far" not in roles and "get" in roles and not any(n.startswith("g") and n != "get" for n in roles)
    nodes, _ = W.build_flow(edges(spark, rows), "GET /u")
    assert {r.node for r in nodes.filter("ambiguous").collect()} == {"helper", "get"}
    roles, drawn = flow(spark, [*rows, ("app/f0.go::get", "app/q.go::Real", "reconcile", "app/f0.go"), ("app/q.go::Real", "queue", "integration", "app/q.go")])
    assert {"g0", "Real", "queue"} <= set(roles) and "g1" not in roles and ("get", "queue", "integration") in drawn


def test_stitched_consumers_documents_and_diagrams(spark):
    rows = [*BASE, ("app/h.go::list", "PUBLISH orders", "integration", "app/h.go")]
    nodes, drawn = W.build_flow(edges(spark, rows), "GET /u")
    links = spark.createDataFrame([("orders", "PUBLISH orders", "ON orders"), ("other", "PUBLISH other", "ON other")], "topic string, publisher string, consumer string")
    more, joined = W.with_consumers(nodes, drawn, links)
    assert {r.node for r in more.collect()} - {r.node for r in nodes.collect()} == {"ON orders"} and ("PUBLISH orders", "ON orders", "stitch") in {(r.from_node, r.to_node, r.edge_type) for r in joined.collect()}
    doc = W.flow_documents(nodes, drawn, "GET /u", "w").first()
    assert doc.source_path == "flow://GET /u" and "sequenceDiagram\n" in doc.content and "- list (handler)" in doc.content
    assert W.flow_chart(drawn).first().diagram.startswith("flowchart TD\n  n")
    assert [r.entry for r in W.resolve_entry(edges(spark, [*rows, ("POST /api/u", "x", "http", "r")]), "/u").collect()] == ["GET /u"]
    assert W.service_name(edges(spark, rows)).first().service == "app" and W.service_name(edges(spark, rows).limit(0)).first().service == "Backend"
    windows = spark.createDataFrame([("C:/web/a",), ("/web/b",), ("api/c",)], "source_file string")
    assert W.service_name(windows).first().service == "web"


def test_cascade(spark):
    chunks = spark.createDataFrame([("w", "symbol", n, "h") for n in ("list", "UserService", "other")] + [("v", "symbol", "list", "h")], "workspace_hash string, chunk_type string, symbol_name string, graph_context_hash string")
    changed = spark.createDataFrame([("app/s.go::UserService",)], "node string")
    left = {(r.workspace_hash, r.symbol_name) for r in W.invalidated(chunks, edges(spark, BASE), changed, "w").filter("graph_context_hash is null").collect()}
    assert left == {("w", "list")}
    assert W.invalidated(chunks, edges(spark, BASE), changed, "w", queue=0).filter("graph_context_hash is null").count() == 0


def test_neighbourhood_facts_and_hubs(spark, monkeypatch):
    e = edges(spark, [("a", f"n{k}", "calls", "f") for k in range(9)] + [("n0", "far", "calls", "f")])
    start = spark.createDataFrame([("a",)], "node string")
    facts, leading = G.neighbourhood_facts(e, start, 1, "out", 5)
    assert facts.first().asDict() == {"nodes": 5, "total": 10, "truncated": True} and {r.node for r in leading.collect()} == {"a", "n0"}
    whole = {r.node: r.score for r in G.pagerank(e).collect()}
    monkeypatch.setattr(G, "HUB", 2)
    assert {r.node: round(r.score, 12) for r in G.pagerank(e).collect()} == {n: round(s, 12) for n, s in whole.items()}
    scores, n, fresh = G.refreshed_scores(e, None, None)
    assert fresh and n == 10 and G.refreshed_scores(e, scores, 10)[2] is False and G.refreshed_scores(e, scores, 5)[2] is True
    docs = spark.createDataFrame([(7, "T", "c", ["x"])], "id long, title string, collection string, tags array<string>")
    assert {r.node: r.title for r in G.document_nodes(spark.createDataFrame([("7",), ("z",)], "node string"), docs).collect()} == {"7": "T", "z": None}
    bare = edges(spark, [("f::a", "b", "calls", "f"), ("g::b", "c", "calls", "g")])
    assert {r.node: r.depth for r in G.trace(bare, spark.createDataFrame([("f::a",)], "node string")).collect()} == {"f::a": 0, "b": 1, "c": 2}
