"""Sessions of a database or of a tree of JSON files, import of an older store, summaries as files, retrieval sets as files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.workers import share_code
from tessera.sources.sqlite import sqlite_table

# The collection of imported documents that have none, names of files and folders.
IMPORTED, SLUG, UNTITLED, UNNAMED = "v1-import", 80, "untitled-session", "ws-"
COMMIT, LAST_COMMIT, COMMITS = "git://commit/", "git://meta/last-commit", "git-history"


def from_millis(column: str) -> Column:
    """The time (UTC) of milliseconds since 1970; null without a positive number."""
    return F.expr(f"CASE WHEN {column} > 0 THEN timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({column} AS DECIMAL(18, 3)) / 1000) END")


def _turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, created_at; turns follow time, then the message's id."""
    order = Window.partitionBy("conv_id").orderBy(F.col("ms").asc_nulls_first(), "message_id")
    rows = messages.withColumn("turn", F.row_number().over(order).cast("long") - 1)
    return rows.select("conv_id", "turn", "role", "text", from_millis("ms").alias("created_at"))


def _joined(parts: DataFrame, order: str, between: str) -> DataFrame:
    """message_id, text: the texts of its parts in their order."""
    texts = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "text"))).alias("all"))
    return texts.select("message_id", F.array_join(F.transform("all", lambda p: p["text"]), between).alias("text"))


# --- a database: session, project, message, part ---


def database_sessions(spark: SparkSession, path: str, worktrees: list[str] | None = None) -> DataFrame:
    """id, title, worktree, parent_id, created_at, updated_at, latest first; of the given worktrees only, if there is a list (an empty one: none)."""
    sessions = sqlite_table(spark, path, "session", "id string, title string, time_created long, time_updated long, project_id string, parent_id string")
    projects = sqlite_table(spark, path, "project", "id string, worktree string").withColumnRenamed("id", "project_id")
    rows = sessions.join(projects, "project_id", "left")
    if worktrees is not None:
        rows = rows.filter(F.col("worktree").isin(worktrees) if worktrees else F.lit(False))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    named = rows.select("id", empty("title"), empty("worktree"), empty("parent_id"), from_millis("time_created").alias("created_at"), from_millis("coalesce(time_updated, time_created)").alias("updated_at"))
    return named.orderBy(F.desc_nulls_last("created_at"), "id")


def database_messages(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text, created_at: text parts in the order of their rows, put together without anything between; messages without text are left out."""
    messages = sqlite_table(spark, path, "message", "id string, session_id string, time_created long, data string")
    parts = sqlite_table(spark, path, "part", "rowid long, message_id string, data string").select("rowid", "message_id", F.from_json("data", "type string, text string").alias("p"))
    texts = _joined(parts.filter("p.type = 'text' AND trim(p.text) <> ''").select("rowid", "message_id", "p.text"), "rowid", "")
    role = F.coalesce(F.nullif(F.get_json_object("data", "$.role"), F.lit("")), F.lit("unknown"))
    return _turns(messages.select(F.col("id").alias("message_id"), F.col("session_id").alias("conv_id"), F.col("time_created").alias("ms"), role.alias("role")).join(texts, "message_id"))


# --- a tree: session/<project>/*.json, message/<session>/*.json, part/<message>/*.json ---
_TREE = "id string, title string, projectID string, directory string, role string, type string, text string, time struct<created: long, updated: long>"


def _tree(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The JSON objects below one folder, with the folder they lie in; broken files and other names are left out."""
    rows = spark.read.schema(_TREE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    place = F.regexp_extract("_metadata.file_path", f"/{kind}/([^/]+)/[^/]+[.]json$", 1)
    return rows.withColumn("folder", F.url_decode(place)).filter("folder <> ''")


def tree_sessions(spark: SparkSession, root: str) -> DataFrame:
    """id, title, project_id, directory, created_at, updated_at."""
    rows = _tree(spark, root, "session").filter("id <> ''")
    return rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.col("projectID").alias("project_id"), "directory", from_millis("time.created").alias("created_at"), from_millis("time.updated").alias("updated_at"))


def tree_messages(spark: SparkSession, root: str) -> DataFrame:
    """conv_id, turn, role, text, created_at of users and assistants: text parts in the order of their ids, an empty line between; messages without text are left out."""
    messages = _tree(spark, root, "message").filter("id <> '' AND role IN ('user', 'assistant')")
    parts = _tree(spark, root, "part").filter("type = 'text' AND text <> ''").select(F.col("folder").alias("message_id"), F.coalesce("id", F.lit("")).alias("id"), "text")
    return _turns(messages.select(F.col("id").alias("message_id"), F.col("folder").alias("conv_id"), F.col("time.created").alias("ms"), "role").join(_joined(parts, "id", "\n\n"), "message_id"))


# --- commits ---


def unseen_commits(commits: DataFrame, docs: DataFrame, workspace: str) -> DataFrame:
    """Commits (sha, ...) of which the workspace has no document yet."""
    known = docs.filter((F.col("workspace_hash") == workspace) & F.startswith("source_path", F.lit(COMMIT)))
    return commits.join(known.select(F.substring("source_path", len(COMMIT) + 1, 64).alias("sha")).distinct(), "sha", "left_anti").select(*commits.columns)


def last_commit(commits: DataFrame, workspace: str) -> DataFrame:
    """The document that marks how far a log was read: the latest commit by date, then sha; none of an empty log."""
    latest = commits.groupBy().agg(F.max(F.struct("date", "sha"))["sha"].alias("content")).filter("content IS NOT NULL")
    return latest.select(F.lit(workspace).alias("workspace_hash"), F.sha2("content", 256).alias("content_hash"), F.lit("Last Harvested Commit").alias("title"), "content", F.lit(LAST_COMMIT).alias("source_path"), F.lit(COMMITS).alias("collection"), F.array(F.lit("git"), F.lit("meta")).alias("tags"))


# --- an older store ---


def older_documents(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Documents of a database of the first version, as rows to upsert; those without content are skipped. Tags are a JSON list or parted by commas."""
    rows = sqlite_table(spark, path, "documents", "source_path string, title string, content string, tags string, collection string").filter("content <> ''")
    listed = F.when(F.startswith(F.ltrim("tags"), F.lit("[")), F.from_json("tags", "array<string>")).otherwise(F.transform(F.split("tags", ","), lambda t: F.trim(t)))
    tags = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda t: t != "")
    return rows.select(F.lit(workspace).alias("workspace_hash"), F.sha2("content", 256).alias("content_hash"), "title", "content", "source_path", F.coalesce(F.nullif("collection", F.lit("")), F.lit(IMPORTED)).alias("collection"), tags.alias("tags"))


# --- summaries as Markdown files ---


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits, anything else one dash; of 80 characters at most."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(dashed, F.lit(SLUG)), "-$", ""), F.lit("")), F.lit(UNTITLED))


def summary_path(name: str, workspace: str, date: str, source: str, title: str) -> Column:
    """<workspace>/<date>--<source>-<title>.md from columns; a workspace without a name goes by its hash."""
    folder = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.concat(F.lit(UNNAMED), F.left(workspace, F.lit(12)))).otherwise(slug(F.trim(name)))
    return F.concat(folder, F.lit("/"), F.date_format(date, "yyyy-MM-dd"), F.lit("--"), slug(F.col(source)), F.lit("-"), slug(F.col(title)), F.lit(".md"))


def write_summaries(summaries: DataFrame, folder: str) -> None:
    """Writes session_id, path, markdown below ``folder``, which all executors share.

    A file appears as a whole (written beside, then renamed), so a task may be run again. Where a path is taken by other
    contents, by a file or by the session with the least id of these rows, the name gets eight digits of its session's hash.
    """
    share_code(summaries.sparkSession)
    rows = summaries.withColumn("digest", F.sha2("markdown", 256))
    first = rows.groupBy("path").agg(F.min(F.struct("session_id", "digest"))["digest"].alias("first"))
    named = rows.join(first, "path").select("path", "markdown", (F.col("digest") == F.col("first")).alias("own"), F.left(F.sha2("session_id", 256), F.lit(8)).alias("mark"))

    def write(part: Iterator[Row]) -> None:
        for row in part:
            goal, body = Path(folder) / row.path, row.markdown.encode()
            if not (goal.read_bytes() == body if goal.exists() else row.own):
                goal = goal.with_name(f"{goal.stem}_{row.mark}{goal.suffix}")
            goal.parent.mkdir(parents=True, exist_ok=True)
            beside = goal.with_name(f"{goal.name}.{os.getpid()}.tmp")
            beside.write_bytes(body)
            beside.replace(goal)

    named.filter("markdown IS NOT NULL").foreachPartition(write)


# --- retrieval sets ---
_ENTRY = "query string, relevant_doc_ids array<string>, relevant_source_paths array<string>, source_doc_id string, source_title string"


def write_retrieval_set(entries: DataFrame, path: str, workspace: str, version: str = "v1") -> None:
    """One JSON object (version, scale, workspace_hash, entries by query) in the folder ``path``; a retrieval set has a size that its maker gives."""
    fields = [F.col(f.split()[0]) for f in _ENTRY.split(", ") if f.split()[0] in entries.columns]
    whole = entries.groupBy().agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entries"))
    out = whole.select(F.to_json(F.struct(F.lit(version).alias("version"), F.size("entries").alias("scale"), F.lit(workspace).alias("workspace_hash"), "entries")).alias("value"))
    out.write.mode("overwrite").text(path)


def read_retrieval_set(spark: SparkSession, path: str) -> DataFrame:
    """version, workspace_hash and the columns of an entry, a row for each."""
    rows = spark.read.schema(f"version string, scale int, workspace_hash string, entries array<struct<{_ENTRY.replace(' string', ': string').replace(' array', ': array')}>>").option("multiLine", True).json(path)
    return rows.select("version", "workspace_hash", F.inline("entries"))
