"""Further sources and sinks: files of a tree, sessions as JSON lines, commit logs, append-only telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.text import is_bot
from tessera.sources.admission import admitted

# Extensions of binary files.
BINARY = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tar", "7z", "exe", "dll", "so", "dylib", "class", "jar", "wasm", "woff", "woff2", "ttf", "mp3", "mp4", "mov", "sqlite", "db", "bin")


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] = (), most_bytes: int = 1 << 20, ignores: DataFrame | None = None) -> DataFrame:
    """path, size, mtime, content, hash of the text files below ``root`` that are admitted; large, binary and non-UTF-8 files go.

    Names are tried (see ``admission``) before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    below = F.regexp_replace("path", "^file:/+", "/")
    files = files.filter(~ext.isin(*BINARY) & (F.col("length") <= most_bytes)).withColumn("relative", F.substring(below, len(root.rstrip("/").removeprefix("file:")) + 2, 1 << 20))
    text = F.col("content").cast("string")
    kept = admitted(files, extensions, exclude, ignores).filter(F.is_valid_utf8(text))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), text.alias("content"), F.sha2("content", 256).alias("hash"))


SESSION_LINE = T.StructType().add("sessionId", "string").add("type", "string").add("timestamp", "string").add("message", T.StructType().add("role", "string").add("content", "string"))


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text of JSON-lines sessions; lines that are no JSON or have no type are skipped.

    Turns follow the time of a line, then its text. Content may be a string or a list of parts, of which text counts.
    """
    raw = spark.read.text(path).select(F.from_json("value", SESSION_LINE).alias("r")).filter("r.type is not null").select("r.*")
    parts = F.from_json("message.content", "array<struct<type:string,text:string>>")
    text = F.when(F.startswith("message.content", F.lit("[")), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(F.col("message.content"))
    rows = raw.select(F.col("sessionId").alias("conv_id"), "timestamp", F.coalesce("message.role", F.lit("unknown")).alias("role"), text.alias("text")).filter("trim(text) <> ''")
    from pyspark.sql import Window

    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("timestamp", "text")).cast("long") - 1)


def commit_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha, author, email, date, subject, body of a log whose records are parted by \\x1e and fields by \\x1f, without bots."""
    records = lines.select(F.explode(F.split(column, "\x1e")).alias("r")).filter("trim(r) <> ''")
    fields = F.split(F.ltrim("r"), "\x1f")
    names = ("sha", "author", "email", "date", "subject", "body")
    rows = records.select(*(F.trim(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)))
    return rows.filter(F.rlike("sha", F.lit("^[0-9a-f]{7,40}$")) & ~is_bot(F.col("author"), F.col("email")))


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Appends, by day, so that retention drops whole folders."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def unharvested(sessions: DataFrame, summaries: DataFrame, now: str, source: str, quiet_minutes: int = 10) -> DataFrame:
    """Sessions that are not active any more and have no summary document yet (summary://source/id)."""
    quiet = sessions.filter(F.col("updated_at") < F.expr(f"timestamp_ntz'{now}' - make_dt_interval(0, 0, {int(quiet_minutes)})"))
    done = summaries.select("source_path").distinct()
    return quiet.withColumn("source_path", F.concat(F.lit(f"summary://{source}/"), F.col("id").cast("string"))).join(done, "source_path", "left_anti")
