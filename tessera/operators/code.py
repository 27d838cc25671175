"""Code graphs from source files (path, content): symbols, edges, routes, integrations, import resolution.

Python is read by its own parser in Arrow batches. For other languages declarations and imports are found by patterns in
the JVM; calls, integrations and routes by the functions of ``calls``, file by file. Extractors are plain functions from
files to edges; ``extract`` joins those that a caller asks for.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import calls

EDGES = "source_node string, target_node string, edge_type string, source_file string, line long"
# Names of methods by which Python code sends to a topic or listens to one.
PUBLISH = frozenset("publish send emit enqueue dispatch broadcast notify produce push".split())
CONSUME = frozenset("subscribe consume basic_consume listen on".split())
HTTP_CLIENTS = frozenset("requests httpx aiohttp session client".split())
HTTP_METHODS = frozenset("get post put patch delete head options".split())
# What an import may leave out, in the order in which it is tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue")


def _name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def python_edges(path: str, content: str) -> list[tuple[str, str, str, str, int]]:
    """contains: definitions and module-level names; imports: as written; calls: names called within functions; each once.

    Text that is no Python has no edges.
    """
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: dict[tuple[str, str, str], int] = {}

    def add(source: str, target: str, kind: str, line: int) -> None:
        out.setdefault((source, target, kind), line)

    for node in tree.body:
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    add(path, f"{path}::{target.id}", "contains", node.lineno)
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            add(path, f"{path}::{node.target.id}", "contains", node.lineno)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            add(path, f"{path}::{node.name}", "contains", node.lineno)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                add(path, alias.name, "imports", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            add(path, "." * node.level + (node.module or ""), "imports", node.lineno)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for part in node.body:
                for call in ast.walk(part):
                    if isinstance(call, ast.Call) and (callee := _name(call.func)):
                        add(f"{path}::{node.name}", callee, "calls", call.lineno)
    return [(s, t, k, path, line) for (s, t, k), line in out.items()]


def python_integrations(path: str, content: str) -> list[tuple[str, str, str, str, int]]:
    """integration: from functions to topics (PUBLISH t, CONSUME t) and to addresses (HTTP GET url), where these are literals.

    Addresses that are put together are <var:...>. Calls outside of functions belong to the file's <module>.
    """
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    owner: dict[int, str] = {}

    def own(node: ast.AST, name: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = child.name if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else name
            owner[id(child)] = inner
            own(child, inner)

    own(tree, "<module>")
    out = []
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.args):
        first = call.args[0]
        target = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else f"<var:{ast.unparse(first)}>"
        verb = call.func.attr
        if verb in HTTP_METHODS and (_name(call.func.value) or "").lower() in HTTP_CLIENTS:
            node = f"HTTP {verb.upper()} {target}"
        elif verb in PUBLISH:
            node = f"PUBLISH {target}"
        elif verb in CONSUME:
            node = f"CONSUME {target}"
        else:
            continue
        out.append((f"{path}::{owner.get(id(call), '<module>')}", node, "integration", path, call.lineno))
    return out


def _by_parser(files: DataFrame, parse: Callable[[str, str], list[tuple]], extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse(p, c)]
            yield pd.DataFrame(rows, columns=["source_node", "target_node", "edge_type", "source_file", "line"])

    own = F.lit(False)
    for e in extensions:
        own = own | F.endswith("path", F.lit(e))
    return files.filter(own).select("path", "content").mapInPandas(step, EDGES)


# Declarations and imports by extension: patterns whose first group is the name.
PATTERNS: dict[str, dict[str, str]] = {
    "go": {"contains": r"^(?:func(?:[ ]+\([^)]*\))?|type)[ ]+([A-Za-z_]\w*)", "imports": r"^(?:import[ ]+(?:[\w.]+[ ]+)?|[ \t]+(?:[\w.]+[ ]+)?)\"([^\"]+)\"[ \t]*$"},
    "ts|tsx|js|jsx|vue": {
        "contains": r"^[ \t]*(?:export[ ]+)?(?:default[ ]+)?(?:async[ ]+)?(?:function\*?|class|interface|type|enum|const|let)[ ]+([A-Za-z_$][\w$]*)(?=[ \t]*[({<=:]|[ ]+extends|[ ]+implements|[ ]*$)",
        "imports": r"^[ \t]*(?:import|export)\b[^'\"\n;]*?['\"]([^'\"]+)['\"]|\brequire\([ ]*['\"]([^'\"]+)['\"][ ]*\)",
    },
    "rb": {"contains": r"^[ \t]*(?:def|class|module)[ ]+(?:self\.)?([A-Za-z_][\w:]*[?!]?)", "imports": r"^[ \t]*require(?:_relative)?[ ]+['\"]([^'\"]+)['\"]"},
}
# Routes by framework: the endings of the files that have them, and a function from path and content to edges; net/http by a pattern.
ROUTES: dict[str, tuple[tuple[str, ...], Callable[[str, str], list[tuple]]]] = {
    "express": ((".ts", ".tsx", ".js", ".jsx"), calls.express_routes),
    "echo": ((".go",), calls.grouped_routes),
    "gin": ((".go",), calls.grouped_routes),
    "nestjs": ((".ts", ".tsx"), calls.nest_routes),
    "nuxt": ((".vue", ".ts", ".js"), lambda path, content: calls.nuxt_routes(path)),
    "rails": (("routes.rb",), calls.rails_routes),
}
NET_HTTP = r"\b\w+\.(HandleFunc|Handle)\([ ]*\"(?:(GET|POST|PUT|PATCH|DELETE)[ ]+)?([^\"]+)\"[ ]*,[ ]*([\w.]+)"


def _lines(files: DataFrame, extensions: str) -> DataFrame:
    own = files.filter(F.rlike("path", F.lit(rf"\.({extensions})$")))
    return own.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at").cast("long") + 1)


def declarations(files: DataFrame) -> DataFrame:
    """contains and imports edges of all languages with patterns."""
    out = None
    for extensions, kinds in PATTERNS.items():
        for kind, pattern in kinds.items():
            names = [F.regexp_extract("text", pattern, g) for g in range(1, 3 if "|\\b" in pattern else 2)]
            name = F.coalesce(*(F.when(n != "", n) for n in names))
            target = F.concat("path", F.lit("::"), name) if kind == "contains" else name
            rows = _lines(files, extensions).select(F.col("path").alias("source_node"), target.alias("target_node"), F.lit(kind).alias("edge_type"), F.col("path").alias("source_file"), "line").filter("target_node is not null")
            out = rows if out is None else out.union(rows)
    return out.groupBy("source_node", "target_node", "edge_type", "source_file").agg(F.min("line").alias("line"))


def routes(files: DataFrame, frameworks: list[str]) -> DataFrame:
    """http and middleware edges from "METHOD path" to handlers, of the frameworks in use; if none is known, of all."""
    chosen = [f for f in frameworks if f in ROUTES or f == "nethttp"] or [*ROUTES, "nethttp"]
    out = None
    for parse, endings in {ROUTES[f][1]: ROUTES[f][0] for f in chosen if f in ROUTES}.items():
        rows = _by_parser(files, parse, endings)
        out = rows if out is None else out.union(rows)
    if "nethttp" in chosen:
        found = _lines(files, "go").select("path", "line", *(F.regexp_extract("text", NET_HTTP, g).alias(f"g{g}") for g in range(1, 5))).filter("g1 <> ''")
        rows = found.select(F.concat_ws(" ", F.when(F.col("g2") != "", F.col("g2")).otherwise("ANY"), "g3"), F.substring_index("g4", ".", -1), F.lit("http"), "path", "line")
        out = rows if out is None else out.union(rows)
    return out.toDF("source_node", "target_node", "edge_type", "source_file", "line").distinct()


def extract(files: DataFrame, frameworks: list[str] = ()) -> DataFrame:
    """All edges of all files, each (kind, source, target, file) once at its first line."""
    every = _by_parser(files, python_edges).union(_by_parser(files, python_integrations)).union(_by_parser(files, calls.edges_of, calls.EXTENSIONS)).union(declarations(files)).union(routes(files, list(frameworks)))
    return every.groupBy("source_node", "target_node", "edge_type", "source_file").agg(F.min("line").alias("line"))


def symbols(files: DataFrame) -> DataFrame:
    """path, symbol, line of all declarations of all languages: a document's or a chunk's name."""
    every = _by_parser(files, python_edges).union(declarations(files)).filter("edge_type = 'contains'")
    return every.select(F.col("source_file").alias("path"), F.substring_index("target_node", "::", -1).alias("symbol"), "line").groupBy("path", "symbol").agg(F.min("line").alias("line"))


# How good a place a class of a name is in a Ruby program, best first.
RUBY_PLACES = ("app/", "lib/", "")


def resolve_ruby(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``edges`` with reconcile edges from calls on classes (Name.method) to the file that defines the class.

    ``classes``: path, symbol. Of several files the first by place (app, lib, others), then the one whose name is the
    class's in snake case, then the shortest path; reconcile edges that were there before go.
    """
    rank = F.lit(len(RUBY_PLACES))
    for k, place in reversed(list(enumerate(RUBY_PLACES))):
        rank = F.when(F.startswith("path", F.lit(place)) | F.contains("path", F.lit(f"/{place}")), k).otherwise(rank) if place else rank
    last = F.regexp_replace(F.substring_index("symbol", "::", -1), "(?<=[a-z0-9])(?=[A-Z])", "_")
    named = F.when(F.endswith("path", F.concat(F.lit("/"), F.lower(last), F.lit(".rb"))), 0).otherwise(1)
    best = classes.withColumn("__class", F.substring_index("symbol", "::", -1)).groupBy("__class").agg(F.min_by("path", F.struct(rank, named, F.length("path"), "path")).alias("file"))
    plain = edges.filter("edge_type <> 'reconcile'")
    asked = plain.filter((F.col("edge_type") == "calls") & F.rlike("target_node", F.lit(r"^[A-Z][\w:]*\.\w"))).withColumns({"__class": F.substring_index(F.substring_index("target_node", ".", 1), "::", -1), "__method": F.substring_index("target_node", ".", -1)})
    found = asked.join(best, "__class").select("source_node", F.concat("file", F.lit("::"), "__method").alias("target_node"), F.lit("reconcile").alias("edge_type"), "source_file", "line")
    return plain.select("source_node", "target_node", "edge_type", "source_file", "line").union(found.distinct())


def frameworks(manifests: DataFrame) -> DataFrame:
    """path, framework of go.mod, package.json and Gemfile contents."""
    hits = {
        "go": ("go.mod", r"(?m)^module "), "echo": ("go.mod", "labstack/echo"), "gin": ("go.mod", "gin-gonic/gin"), "express": ("package.json", "\"express\"[ ]*:"),
        "nestjs": ("package.json", "\"@nestjs/core\"[ ]*:"), "nuxt": ("package.json", "\"nuxt3?\"[ ]*:"), "rails": ("Gemfile", r"gem[ ]+['\"]rails['\"]"),
    }
    found = F.array_compact(F.array(*(F.when(F.endswith("path", F.lit(file)) & F.rlike("content", F.lit(p)), F.lit(name)) for name, (file, p) in hits.items())))
    return manifests.select("path", F.explode(found).alias("framework"))


def normalised(path: Column) -> Column:
    """A path without '.' and '..' steps; null if it leaves the root."""
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        skip, up = part.isin("", "."), part == ".."
        out = F.when(skip, acc["out"]).when(up, F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(F.concat(acc["out"], F.array(part)))
        return F.struct((acc["ok"] & ~(up & (F.size(acc["out"]) == 0))).alias("ok"), out.alias("out"))

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/")))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """source_file, specifier, target: the file that an import names, or the specifier as it is if there is none.

    Relative ones start at the importing file's directory; of aliases (prefix, root; a prefix without a final slash has
    to match as a whole) the longest counts; then endings are tried in the order of SUFFIXES. Joins are on equality: an
    import tries each of its own prefixes and endings.
    """
    rows = imports.select("source_file", "specifier").distinct()
    folder = F.regexp_replace("source_file", r"/?[^/]*$", "")
    relative = rows.filter(F.rlike("specifier", F.lit(r"^\.\.?/"))).select("*", normalised(F.concat(folder, F.lit("/"), F.col("specifier"))).alias("path"))
    cuts = F.transform(F.sequence(F.lit(1), F.length("specifier")), lambda i: F.left(F.col("specifier"), i))
    tried = rows.filter(~F.rlike("specifier", F.lit(r"^\.\.?/")) & (F.col("specifier") != "")).select("*", F.explode(F.filter(cuts, lambda c: c.endswith("/") | (c == F.col("specifier")))).alias("prefix"))
    best = tried.join(aliases, "prefix").groupBy("source_file", "specifier").agg(F.max_by(F.struct("prefix", "root"), F.length("prefix")).alias("a"))
    aliased = best.select("source_file", "specifier", normalised(F.concat(F.col("a.root"), F.lit("/"), F.substr("specifier", F.length("a.prefix") + 1))).alias("path"))
    endings = F.array(*(F.struct(F.lit(k).alias("k"), F.concat("path", F.lit(s)).alias("target")) for k, s in enumerate(SUFFIXES)))
    probes = relative.union(aliased).filter("path is not null").select("source_file", "specifier", F.explode(endings).alias("p")).select("source_file", "specifier", "p.k", "p.target")
    found = probes.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").groupBy("source_file", "specifier").agg(F.min_by("target", "k").alias("target"))
    return rows.join(found, ["source_file", "specifier"], "left").select("source_file", "specifier", F.coalesce("target", "specifier").alias("target"))
