"""Words, their hashes and hashes of word windows, by numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm._arrow import text_buffers

U = np.uint64
#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII punctuation, which normalised words lose at both ends.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 positions in them where the rows begin."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64), seed + 1)
    at, rest, live = starts, length, None
    while len(at):
        lane = lanes[at] & _MASK[np.minimum(rest, 8)]
        if live is None:
            out = mix(out ^ (lane * _A))
        else:
            out[live] = mix(out[live] ^ (lane * _A))
        more = rest > 8
        live = np.flatnonzero(more) if live is None else live[more]
        at, rest = at[more] + 8, rest[more] - 8
    return out


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of ``a`` are those of the span of ``b`` beside it, eight bytes a step."""
    lanes = []
    for data in (a, b):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        lanes.append(np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)))
    length = a_ends - a_starts
    same = length == b_ends - b_starts
    live = np.flatnonzero(same & (length > 0))
    step = 0
    while len(live):
        rest = length[live] - step
        differ = (lanes[0][a_starts[live] + step] ^ lanes[1][b_starts[live] + step]) & _MASK[np.minimum(rest, 8)]
        same[live[differ != 0]] = False
        live = live[(differ == 0) & (rest > 8)]
        step += 8
    return same


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` consecutive words of one row: (word position of each window, hash)."""
    n = len(words)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)
    at = np.flatnonzero(left >= width)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    base = U((0x2545F4914F6CDD1D + 2 * seed * 0x9E3779B97F4A7C15) % 2**64 | 1)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * base + words[k : n - width + 1 + k]
    return at, mix(total[at], seed + 7)


def normalised_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without ASCII punctuation at their ends (words of punctuation alone go), and row positions."""
    data, offsets = text_buffers(pc.utf8_lower(texts.cast(pa.large_string()) if len(texts) else texts))
    starts, ends, rows = trimmed(data, *find_words(data, offsets))
    return hash_spans(data, starts, ends), rows


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words without ASCII punctuation at both ends; words that lose all go."""
    punct = PUNCTUATION[data] if len(data) else np.zeros(0, bool)
    solid = np.flatnonzero(~punct & ~SPACE[data]) if len(data) else np.zeros(0, np.int64)
    if not len(solid):
        return starts[:0], ends[:0], np.zeros_like(rows)
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    keep = last >= first
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return solid[first[keep]], solid[last[keep]] + 1, before[rows]


def shingles(words: np.ndarray, rows: np.ndarray, width: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of all rows, and the positions where rows begin; a row of 1 to ``width`` - 1 words has one of all its words."""
    at, hashes = window_hashes(words, rows, width, seed)
    counts = np.diff(rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            own[has] = own[has] * _A + words[rows[short[has]] + k]
        own = mix(own ^ counts[short].astype(np.uint64), seed + 11)
        at = np.concatenate([at, rows[short]])
        hashes = np.concatenate([hashes, own])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    return hashes, np.searchsorted(at, rows)
