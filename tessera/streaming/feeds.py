"""Structured Streaming forms of the engine's feeds: telemetry windows, incremental ingest, the embedding queue."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import shared_folder


def follow(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A parquet table as a stream of its files; the schema is that of the files which are there."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    # The glob makes a table that is a single file a listing of one.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, event_type, n and total of each tumbling window; the watermark bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """user_id, start, end, n of each run of events without a gap.

    The watermark bounds the state, and rows behind it are dropped in every output mode; with ``late`` None there is none,
    so all events count whatever their order.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark, as the queue's in-flight check does."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fan_out(events: DataFrame, types: list[str] | None = None, workspace: str | None = None) -> DataFrame:
    """The events that a subscriber asked for."""
    if types:
        events = events.filter(F.col("event_type").isin(*types))
    return events.filter(F.col("workspace_hash") == workspace) if workspace else events


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns the result.

    Executors write each batch to the folder they share and the driver holds no rows; with "complete" a batch replaces
    the one before. The stream's state lies there too, as any executor may need it, and goes when the stream has ended.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    batches: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(at := f"{place}/v={batch_id}")
        if mode == "complete":
            _delete(spark, *(b for b in batches if b != at))
            batches.clear()
        if at not in batches:
            batches.append(at)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
        _delete(spark, f"{place}/state")
    return spark.read.schema(stream.schema).parquet(*batches) if batches else spark.createDataFrame([], stream.schema)


def _delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ingest(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], key: str = "id", order: list[str] = (), trigger: dict | None = None):
    """Keeps a parquet table of the latest row for each key: each batch is merged and written as a new version.

    Of a batch's rows with one key the last by ``order`` counts, of equal ones the last by all columns, so a batch that
    runs again gives the same rows; versions are folders by batch id, so it writes the same folder. A batch rewrites the
    table, as a file format without merges has to; a large table is fed in few batches, or partition by partition with a
    ``merge`` that reads its own part. ``trigger``: as of writeStream.trigger, all that is there now without it
    (processingTime="2 seconds" waits for changes to settle).
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        last = f"{path}/v={batch_id - 1}"
        old = spark.read.parquet(last) if batch_id > 0 else None
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order, F.xxhash64(*batch.columns))).alias("r")).select("r.*")
        merge(old, latest).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow_files(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """The text files below a directory as a stream: path, size, mtime, content; new and changed files come as they are written."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    text = F.col("content").cast("string")
    return raw.filter(F.is_valid_utf8(text)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), text.alias("content"))


def due(jobs: DataFrame, now: str) -> DataFrame:
    """The periodic jobs (name, every_seconds, last_run) whose time has come; one that never ran is due."""
    at = F.expr(f"timestamp_ntz'{now}'")
    return jobs.filter(F.col("last_run").isNull() | (F.unix_timestamp(at) - F.unix_timestamp(F.col("last_run").cast("timestamp_ntz")) >= F.col("every_seconds")))


def embed_pending(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], batch: int = 50, retries: int = 3, now: str | None = None, wait_seconds: float = 1.0) -> DataFrame:
    """One turn of the embedding queue: the oldest pending chunks, embedded by ``embed`` (id, content -> id, ok).

    Successes become embedded; others count an attempt and become embed_failed after ``retries``, or at once where ``ok``
    is null (a text that the model will never take). With ``now`` and a column tried_at a chunk waits wait_seconds after
    its first attempt, twice as long after each further one. ``chunks`` has id, content, embed_status, attempts,
    created_at. ``batch`` is the feature's: a turn takes so many.
    """
    ready = chunks.filter("embed_status = 'pending'")
    if now is not None:
        waited = F.unix_timestamp(F.expr(f"timestamp_ntz'{now}'")) - F.unix_timestamp(F.col("tried_at").cast("timestamp_ntz"))
        ready = ready.filter(F.col("tried_at").isNull() | (waited >= wait_seconds * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0)))))
    turn = ready.orderBy("created_at", "id").limit(batch)
    done = embed(turn.select("id", "content")).select("id", F.struct(F.col("ok")).alias("__r"))
    told, ok = F.col("__r").isNotNull(), F.col("__r.ok")
    tried = F.col("attempts") + F.when(told & ~F.coalesce(ok, F.lit(False)), 1).otherwise(0)
    state = F.when(told & F.coalesce(ok, F.lit(False)), "embedded").when(told & (ok.isNull() | (tried >= retries)), "embed_failed").otherwise(F.col("embed_status"))
    changed = {"embed_status": state, "attempts": tried} | ({"tried_at": F.when(told, F.expr(f"timestamp_ntz'{now}'")).otherwise(F.col("tried_at"))} if now is not None else {})
    return chunks.join(done, "id", "left").withColumns(changed).drop("__r")
