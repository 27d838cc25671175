"""Threshold-scaled sketches of documents (FracMinHash over shingles of five words).

A sketch keeps every distinct shingle hash below a fixed share of the hash range, and no other. So sketches of parts
merge into exactly the sketch of the whole, and they estimate containment between documents of very different length:
the share of A's kept hashes that B keeps too. A short text may keep no hash at all. A fingerprint therefore begins with
a hash of the text's normalised words in their order, which tells equal texts apart from those whose sketches are
equal; the sketch follows.

Words are lower case without ASCII punctuation at their ends; a text of one to four words is one shingle. Defined
results: null, empty and wordless texts have the empty fingerprint; fingerprints that are equal are alike (1), an empty
sketch is unlike any other (0), and the containment of an empty sketch is unknown (null); equal texts have equal
fingerprints; rows with equal ids are taken in an order of their texts' hashes; rows without an id come last; ids may lie
anywhere; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import SLICE_BYTES, append_columns, share_code, slices, text_buffers
from tessera.llm._groups import id_ranges, with_range
from tessera.llm._words import mix, normalised_words, shingles

#: One in so many shingle hashes is kept.
SCALE = 4
WIDTH = 5
#: Ranges of ids, at most; their number bounds the table of range ends, which is broadcast.
MOST_RANGES = 1 << 16


def _kept(words: np.ndarray, rows: np.ndarray, scale: int) -> list[np.ndarray]:
    hashes, at = shingles(words, rows, WIDTH)
    low = hashes < np.uint64(2**64 // scale)
    return [np.unique(hashes[a:b][low[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(texts: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """The kept hashes of each text, in ascending order."""
    return [s for first, last, _, _ in slices(*text_buffers(texts)) for s in _kept(*normalised_words(texts.slice(first, last - first)), scale)]


def fingerprints(texts: pa.Array, scale: int = SCALE) -> list[tuple[int, np.ndarray]]:
    """Identity (a hash of the words in their order; 0 without words) and sketch of each text."""
    out: list[tuple[int, np.ndarray]] = []
    for first, last, _, _ in slices(*text_buffers(texts)):
        words, rows = normalised_words(texts.slice(first, last - first))
        place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place.astype(np.uint64), 31), 32))])
        out += zip((run[rows[1:]] - run[rows[:-1]]).tolist(), _kept(words, rows, scale), strict=True)
    return out


def merge(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The sketch of the union."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 0 if a sketch is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal fingerprints, else the resemblance of the sketches."""
    return 1.0 if a[0] == b[0] else resemblance(a[1], b[1])


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of a's shingles that b has; None if a's sketch is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else None


def to_text(identity: int, sketch: np.ndarray) -> str:
    """16 hexadecimal digits for the identity and for each hash; no digits without words."""
    return f"{identity:016x}" + sketch.astype(">u8").tobytes().hex() if identity or len(sketch) else ""


def from_text(text: str) -> tuple[int, np.ndarray]:
    values = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
    return (int(values[0]), values[1:]) if len(values) else (0, values)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """``df`` with the fingerprint of each text."""
    from pyspark.sql import types as T

    return append_columns(df, T.StructType([T.StructField(out, T.StringType())]), lambda b: [pa.array([to_text(*f) for f in fingerprints(b.column(0), scale)], pa.string())], [text])


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of a range of ids follow each other, ids descending; last comes the first row of the range below (border).

    After the lowest range comes the highest, so the first row follows the last. Texts are shuffled once. Rows of one id
    are in the order of a hash of their texts, by which an id with very many rows, or none at all, is cut into ranges.
    """
    hashed = df.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranged = with_range(hashed, "doc_id", F.col("hash"), id_ranges(df, "doc_id", "text", SLICE_BYTES, MOST_RANGES))
    # The salt is compared as an unsigned number.
    ranged = ranged.withColumn("hash", F.col("hash").bitwiseXOR(F.lit(-(2**63))))
    ends = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("top"))
    order = Window.orderBy("range")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", "top", F.coalesce(F.lead("range").over(order), F.first("range").over(whole)).alias("above"))
    ends = F.broadcast(ends.select(F.col("range").alias("own"), "top", "above"))  # about MOST_RANGES rows at most
    marked = ranged.join(ends, (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("hash") == F.col("top.hash")), "left")
    places = F.array(F.struct(F.col("range"), F.lit(0).alias("border")), F.struct(F.col("above").alias("range"), F.lit(1).alias("border")))
    rows = marked.select("doc_id", "hash", "text", F.explode(F.when(F.col("own").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("place"))
    rows = rows.select("doc_id", "hash", "text", "place.range", "place.border")
    return rows.repartition("range").sortWithinPartitions("range", "border", F.col("doc_id").desc_nulls_last(), F.desc("hash"), "text").drop("hash")


def compare_with_next(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each document against its edited text and against the next document, in descending order of ids.

    The edited text has its last floor(n / 3) code points replaced by the first as many of the next document's (or all).
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness); in_edited, in_next
    (estimated containment in the edited text and in the next document).
    """
    share_code(df.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, fingerprint) of a row whose next is still to come
        for batch in batches:
            for part in _portions(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                own = fingerprints(pa.array(texts, pa.large_string()), scale)
                pairs = []
                for key, border, doc, text, sketch in zip(part.column("range").to_pylist(), part.column("border").to_pylist(), part.column("doc_id").to_pylist(), texts, own, strict=True):
                    if last is not None and last[0] == key:
                        pairs.append((last[1], last[2], last[3], text, sketch))
                        last = None
                    if not border:
                        last = (key, doc, text, sketch)
                if pairs:
                    yield _compared(pairs, scale)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"
    return _in_order(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(step, schema)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = text_buffers(batch.column("text"))
    for first, last, _, _ in slices(data, offsets, SLICE_BYTES):
        yield batch.slice(first, last - first)


def _compared(pairs: list[tuple], scale: int) -> pa.RecordBatch:
    edited = [text[: len(text) - len(text) // 3] + following[: len(text) // 3] for _, text, _, following, _ in pairs]
    changed = fingerprints(pa.array(edited, pa.large_string()), scale)
    columns = (
        ("doc_id", pa.int64(), [p[0] for p in pairs]),
        ("n_chars", pa.int64(), [len(p[1]) for p in pairs]),
        ("edited_sha256", pa.string(), [hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        ("fingerprint", pa.string(), [to_text(*p[2]) for p in pairs]),
        ("edited_fingerprint", pa.string(), [to_text(*f) for f in changed]),
        ("near_edited", pa.float64(), [likeness(p[2], f) for p, f in zip(pairs, changed, strict=True)]),
        ("near_next", pa.float64(), [likeness(p[2], p[4]) for p in pairs]),
        ("in_edited", pa.float64(), [containment(p[2][1], f[1]) for p, f in zip(pairs, changed, strict=True)]),
        ("in_next", pa.float64(), [containment(p[2][1], p[4][1]) for p in pairs]),
    )
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[c for c, _, _ in columns])
