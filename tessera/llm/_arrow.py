"""Arrow plumbing that the Python operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that a Python step works on at once; it bounds the numpy arrays of a worker.
SLICE_BYTES = 1 << 20


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it (a cluster uses --py-files or an image)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of spark.checkpoint.dir, which all executors share; the lineage ends there.

    Only a session on one machine (local master) without that setting, as in tests, gets a folder of its own; a cluster
    without it is an error, as its executors would not share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``most`` bytes (or a single larger row): first row, row after the last, bytes, offsets."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of ``counts[i]`` values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def append_columns(df: DataFrame, added: T.StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]], reads: list[str]) -> DataFrame:
    """``df`` with the columns ``added``, which ``compute`` makes from the columns ``reads`` of each Arrow batch.

    A column of ``df`` with the name of an added one is replaced, as withColumn does.
    """
    share_code(df.sparkSession)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *added.fields])
    keep = [f.name for f in kept]
    n = len(keep)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.select(list(range(n, n + len(reads)))).rename_columns(reads))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*keep, *(f.name for f in added)])

    return df.select(*(df[f"`{c}`"] for c in keep), *(df[f"`{c}`"].alias(f"__in{i}") for i, c in enumerate(reads))).mapInArrow(step, schema)
