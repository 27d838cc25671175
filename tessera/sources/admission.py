"""Which files of a tree a scan admits, by their paths below its root ("a/b.py").

In this order: directories that no scan enters, lock files, rules of ignore files, excluded patterns, allowed extensions.
All of it is DataFrame functions; rules meet only the files below their folder, in an equi-join on that folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories that no scan enters, and generated files (besides *.lock).
DIRECTORIES = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", "vendor", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "venv", ".venv", "env", ".cache", "coverage", ".terraform",
    "target", ".worktrees", ".pr-reviews", ".opencode", ".output", "_nuxt", "_next", ".svelte-kit", ".angular", ".astro", ".turbo", ".vercel", ".netlify", ".parcel-cache", "bower_components", "jspm_packages", "web_modules",
)
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "bun.lockb", "packages.lock.json", "go.sum", "Package.resolved", "gradle.lockfile", ".terraform.lock.hcl", "Podfile.lock", "composer.lock")


def glob(pattern: Column) -> Column:
    """The regular expression of a file pattern: ** goes through folders, * and ? stay in one, [...] is a class if it is closed."""
    held = F.regexp_replace(pattern, r"([\\.+^$(){}|])", r"\\$1")
    closed = ~F.rlike(F.regexp_replace(held, r"\[[^\[\]]+\]", ""), F.lit(r"[\[\]]"))
    held = F.when(closed, F.regexp_replace(held, r"\[(?:!|\\\^)", "[^")).otherwise(F.regexp_replace(held, r"([\[\]])", r"\\$1"))
    for found, mark in ((r"^\*\*/", "\x01"), (r"/\*\*/", "/\x01"), (r"/\*\*$", "/\x02"), (r"\*+", "\x03"), (r"\?", "[^/]")):
        held = F.regexp_replace(held, found, mark)
    for mark, expression in (("\x01", "(?:[^/]+/)*"), ("\x02", ".+"), ("\x03", "[^/]*")):
        held = F.replace(held, F.lit(mark), F.lit(expression))
    return held


def rules(ignores: DataFrame) -> DataFrame:
    """folder, place, expression, negated of the lines of ignore files (folder below the root, "" for the root itself; content).

    Blank lines and comments are no rules; ! takes a match back; a slash before the end ties a pattern to the folder; one
    at the end asks for a directory. A match of a directory is one of all below it.
    """
    lines = ignores.select("folder", F.posexplode(F.split("content", "\r?\n")).alias("place", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"[ \t]+$", "")).filter("line <> '' AND NOT startswith(line, '#')")
    negated = F.startswith("line", F.lit("!"))
    bare = F.regexp_replace(F.when(negated, F.substring("line", 2, 1 << 20)).otherwise(F.col("line")), r"^\\(?=[#!])", "")
    tied = F.contains(F.regexp_replace(bare, "/$", ""), F.lit("/"))
    goal = F.concat(F.lit("^"), F.when(tied, "").otherwise("(?:.*/)?"), glob(F.regexp_replace(bare, "^/|/$", "")), F.when(F.endswith(bare, F.lit("/")), "/.+").otherwise("(?:/.+)?"), F.lit("$"))
    return lines.select("folder", "place", goal.alias("expression"), negated.alias("negated"))


def ignored(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """relative: the paths that an ignore file of a folder above them rules out; in one file the last rule that fits decides."""
    steps = F.split("relative", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    met = files.select("relative", F.explode(above).alias("folder")).distinct().join(rules(ignores), "folder")
    below = F.when(F.col("folder") == "", F.col("relative")).otherwise(F.expr("substring(relative, length(folder) + 2)"))
    fits = met.filter(F.rlike(below, F.col("expression")))
    return fits.groupBy("relative", "folder").agg(F.max(F.struct("place", "negated"))["negated"].alias("negated")).filter("NOT negated").select("relative").distinct()


def admitted(files: DataFrame, extensions: list[str] | None = None, exclude: list[str] = (), ignores: DataFrame | None = None) -> DataFrame:
    """The rows of ``files`` (relative, ...) that a scan admits.

    ``exclude``: patterns of a name, or of a whole path if they have a slash. A null path is not admitted.
    """
    steps = F.split("relative", "/")
    name = F.element_at(steps, -1)
    kept = files.filter(~F.arrays_overlap(steps, F.array(*map(F.lit, DIRECTORIES))) & ~name.isin(*LOCK_FILES) & ~F.endswith(name, F.lit(".lock")))
    for pattern in exclude:
        whole = F.concat(F.lit("^"), glob(F.lit(pattern)), F.lit("$"))
        kept = kept.filter(~F.rlike(name, whole) & (~F.rlike("relative", whole) if "/" in pattern else F.lit(True)))
    if extensions:
        kept = kept.filter(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*("." + e.lstrip(".").lower() for e in extensions)))
    return kept if ignores is None else kept.join(ignored(kept, ignores), "relative", "left_anti").select(*files.columns)
