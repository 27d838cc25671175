"""Removal of word windows that an earlier document already has, found through difference-cover anchors.

The method: positions of a text modulo 7 lie in the difference cover {0, 1, 3} for anchors of 7 words. For any two
positions i and j there is a shift below 7 that brings both into the cover, so two equal windows of 13 words share an
equal anchor that lies wholly in both. Anchors that two documents share mark the windows around them; only those
windows are hashed in full (128 bits) and compared, which extends every anchor to exactly the 13-word matches.

Texts are shuffled once, as ranges of document ids with RANGE_BYTES of text each; a single id's rows, and rows without
an id, are spread over several ranges if they are more. A range sends each distinct hash once, so a passage that a third
of all documents hold is one entry a range; what comes back is one bit for each hash sent. Nothing is emitted by pairs.
Ranges grow with the square root of the corpus, so that what a range sends to a part of the hash space stays larger than
its row.

Defined results: null and empty texts have no words; texts below 13 words lose nothing; of documents with equal ids
none is smaller, so repeated rows keep what only they share; rows without an id come after all others and do not
count as smaller for each other; ids may lie anywhere; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import share_code, text_buffers
from tessera.llm._groups import id_ranges, order_of, with_range
from tessera.llm._words import find_words, hash_spans, mix

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a range of ids in a corpus of up to ROOT_BYTES, and the most that it grows to; the texts of one range are in a worker's memory at a time.
RANGE_BYTES, MOST_RANGE_BYTES, ROOT_BYTES = 1 << 20, 1 << 25, 1 << 35
#: Bytes of text for one part of the hash space, 64 parts at least.
PART_BYTES = 1 << 26
NO_ID = np.int64(2**63 - 1)


def _rolled(words: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of the ``width`` words from each position of ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = total * np.uint64(base) + words[at + k]
    return mix(total, base & 0xFF)


class _Range:
    """The words of one range of documents, and its anchors and windows in the order in which they are sent."""

    def __init__(self, table: pa.Table, parts: int):
        self.parts = parts
        ids = table.column("doc_id").combine_chunks()
        known = ids.fill_null(int(NO_ID)).to_numpy()
        order = np.argsort(known, kind="stable")
        self.ids = known[order]
        self.nulls = np.asarray(ids.is_null())[order]
        self.data, self.offsets = text_buffers(table.column("text").take(pa.array(order)))
        self.starts, self.ends, self.rows = find_words(self.data, self.offsets)
        self.counts = np.diff(self.rows)
        self.words = hash_spans(self.data, self.starts, self.ends)
        self.row_of = np.repeat(np.arange(len(self.ids)), self.counts)
        within = np.arange(len(self.words)) - np.repeat(self.rows[:-1], self.counts)
        left = np.repeat(self.counts, self.counts) - within
        enough = np.repeat(self.counts >= WINDOW, self.counts)
        self.begins_window = left >= WINDOW
        self.anchors = np.flatnonzero(np.isin(within % PERIOD, COVER) & (left >= ANCHOR) & enough)
        keys = _rolled(self.words, self.anchors, ANCHOR, 0x2545F4914F6CDD1D)
        self.anchor_keys, back = np.unique(keys, return_inverse=True)
        self.anchor_back = back
        ids_of = self.ids[self.row_of[self.anchors]]
        low = np.full(len(self.anchor_keys), NO_ID)
        high = np.full(len(self.anchor_keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, ids_of)
        np.maximum.at(high, back, ids_of)
        self.anchor_shared = low != high

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys >> np.uint64(64 - self.parts.bit_length() + 1) if self.parts > 1 else np.zeros(len(keys), np.uint64), np.arange(self.parts + 1).astype(np.uint64))

    def blobs(self, keys: np.ndarray, more: np.ndarray | None = None):
        cut = self.part_of(keys)
        for p in np.flatnonzero(np.diff(cut)):
            a, b = cut[p], cut[p + 1]
            yield int(p), keys[a:b].astype("<u8").tobytes() + (b"" if more is None else more[a:b].astype("<u8").tobytes())

    def bits(self, keys: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """The bit that came back for each key; parts without any are left out."""
        cut = self.part_of(keys)
        out = np.zeros(len(keys), bool)
        for p, packed in answers.items():
            a, b = cut[p], cut[p + 1]
            out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        return out

    def mark(self, answers: dict[int, bytes]) -> None:
        """Windows that hold an anchor of two documents, and their distinct 128-bit hashes."""
        hit = self.anchors[(self.bits(self.anchor_keys, answers) | self.anchor_shared)[self.anchor_back]]
        n = len(self.words)
        change = np.zeros(n + 1, np.int32)
        begin = self.rows[self.row_of[hit]]
        np.add.at(change, np.maximum(hit - (WINDOW - ANCHOR), begin), 1)
        np.add.at(change, hit + 1, -1)
        self.windows = np.flatnonzero((np.cumsum(change[:-1]) > 0) & self.begins_window)
        one = _rolled(self.words, self.windows, WINDOW, 0x9E3779B97F4A7C15)
        two = _rolled(self.words, self.windows, WINDOW, 0xD1342543DE82EF95)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = np.ones(len(order), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.window_keys, self.window_more = one[first], two[first]
        self.window_back = np.empty(len(order), np.int64)
        self.window_back[order] = np.cumsum(first) - 1

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which words go: the bits say whether an earlier range has a window, ids decide within this one."""
        owner = self.ids[self.row_of[self.windows]]
        low = np.full(len(self.window_keys), NO_ID)
        np.minimum.at(low, self.window_back, owner)
        gone = self.windows[self.bits(self.window_keys, answers)[self.window_back] | (low[self.window_back] < owner)]
        change = np.zeros(len(self.words) + WINDOW, np.int32)
        change[gone] += 1
        np.add.at(change, gone + WINDOW, -1)
        return np.cumsum(change)[: len(self.words)] > 0

    def result(self, gone: np.ndarray) -> pa.Table:
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), self.rows[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        n_removed[self.counts == 0] = 0
        raw, kept = self.data.tobytes(), []
        for k, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            words = raw[a:b].split()
            if n_removed[k]:
                words = compress(words, (~gone[self.rows[k] : self.rows[k + 1]]).tolist())
            kept.append(b" ".join(words))
        ids = pa.array(self.ids, pa.int64(), mask=self.nulls)
        return pa.table({"doc_id": ids, "n_words": pa.array(self.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})


def _answers(table: pa.Table, step: int) -> dict[int, bytes]:
    return {p: bits for s, p, bits in zip(*(table.column(c).to_pylist() for c in ("step", "part", "bits")), strict=True) if s == step}


SENT = "part int, step int, range long, blob binary"
BACK = "range long, step int, part int, bits binary"


def _sort_out(table: pa.Table) -> pa.Table:
    """For one part of the hash space: which hashes several ranges sent (step 1), or an earlier range sent too (step 2)."""
    out = []
    part = table.column("part")[0].as_py()
    steps = table.column("step").to_numpy()
    ranges = table.column("range").to_numpy()
    blobs = table.column("blob")
    for step, lanes in ((1, 1), (2, 2)):
        at = np.flatnonzero(steps == step)
        if not len(at):
            continue
        own = [np.frombuffer(blobs[i].as_buffer(), "<u8") for i in at.tolist()]
        sizes = np.array([len(x) // lanes for x in own])
        keys = np.concatenate([x[:n] for x, n in zip(own, sizes, strict=True)])
        source = np.repeat(ranges[at], sizes)
        if lanes == 2:
            more = np.concatenate([x[n:] for x, n in zip(own, sizes, strict=True)])
            source = order_of(source)
            order = np.lexsort((source, more, keys))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
            later = source[order] > source[order][fresh][np.cumsum(fresh) - 1]
        else:
            order = np.argsort(keys, kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = keys[order][1:] != keys[order][:-1]
        told = np.empty(len(order), bool)
        told[order] = later if step == 2 else ~(fresh & np.append(fresh[1:], True))
        end = np.cumsum(sizes)
        for i, a, b in zip(at.tolist(), end - sizes, end, strict=True):
            if told[a:b].any():
                out.append((int(ranges[i]), step, part, np.packbits(told[a:b]).tobytes()))
    for i in np.flatnonzero(steps == 0).tolist():  # bits of step 1 that a range sends on to itself
        out += [(int(ranges[i]), 1, p, bits) for p, bits in _unpack(blobs[i].as_py())]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["range", "step", "part", "bits"])


def _pack(answers: dict[int, bytes]) -> bytes:
    return b"".join(p.to_bytes(4, "little") + len(x).to_bytes(4, "little") + x for p, x in answers.items())


def _unpack(packed: bytes):
    at = 0
    while at < len(packed):
        p, n = (int.from_bytes(packed[at + k : at + k + 4], "little") for k in (0, 4))
        yield p, packed[at + 8 : at + 8 + n]
        at += 8 + n


def _rows(sent: list[tuple]) -> pa.Table:
    columns = list(zip(*sent, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "step", "range", "blob"])


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, UTF-8, joined by single spaces, as binary) for each row of ``df``."""
    share_code(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = id_ranges(docs, "doc_id", "text", int(min(MOST_RANGE_BYTES, RANGE_BYTES * max(1.0, size / ROOT_BYTES) ** 0.5)))
    parts = min(1 << 20, max(64, 1 << (size // PART_BYTES).bit_length()))
    # Equal rows of one id may be many, but those of one input partition are not.
    ranged = with_range(docs, "doc_id", F.xxhash64("text", F.spark_partition_id()), ranges)

    def send_anchors(table: pa.Table) -> pa.Table:
        own, key = _Range(table, parts), table.column("range")[0].as_py()
        return _rows([(p, 1, key, blob) for p, blob in own.blobs(own.anchor_keys)])

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        own, key, answers = _Range(table, parts), table.column("range")[0].as_py(), _answers(back, 1)
        own.mark(answers)
        sent = [(p, 2, key, blob) for p, blob in own.blobs(own.window_keys, own.window_more)]
        return _rows([*sent, (key % parts, 0, key, _pack(answers))] if answers else sent)

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        own = _Range(table, parts)
        own.mark(_answers(back, 1))
        return own.result(own.removed(_answers(back, 2)))

    texts = ranged.groupBy("range")
    one = texts.applyInArrow(send_anchors, SENT).groupBy("part").applyInArrow(_sort_out, BACK)
    two = texts.cogroup(one.groupBy("range")).applyInArrow(send_windows, SENT).groupBy("part").applyInArrow(_sort_out, BACK)
    return texts.cogroup(two.groupBy("range")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same result from a table of all windows; for tests."""
    words = {d: (t or "").encode().split() for d, t in rows}
    least: dict[tuple, int] = {}
    for d in sorted(words):
        for k in range(len(words[d]) - WINDOW + 1):
            least.setdefault(tuple(words[d][k : k + WINDOW]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if least[tuple(w[k : k + WINDOW])] < d:
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
