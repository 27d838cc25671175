"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by numpy over flat arrays.

Features come from the whole text alone; labels, language, source and id are never inputs. Trees are grown level by
level on binned features with logistic loss. The forest is a handful of flat arrays, and all rows walk all trees one
level at a time.

Learning uses at most TRAIN_ROWS labelled rows, those with the least hash of their id; scoring covers every row.

Defined results: null and empty texts have all statistics 0 and a score like any other; without labelled rows every
score is the prior 0.5; labels without a value, or of ids that no document has, are ignored; repeated rows score
equally; an empty table gives an empty table; a column that has the name of an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._arrow import append_columns, slices, text_buffers
from tessera.llm._words import PUNCTUATION, find_words, hash_spans

#: Labelled rows that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Score from which a document is predicted to be good.
CUT = 0.3

FEATURES = (
    "characters", "words", "lines", "upper", "digits", "punctuation", "other_symbols", "word_mean", "word_longest",
    "distinct_words", "top_word", "repeated_next", "symbol_ends", "symbol_words", "upper_words", "digit_words", "line_mean",
    "short_words", "bang", "pipe", "hash", "star", "dollar", "percent", "ampersand", "repeated_lines", "non_ascii",
)


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``rows``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    starts, ends, rows = find_words(data, offsets)
    size = (ends - starts).astype(np.float64)
    counts = np.diff(rows)
    n_words = np.maximum(counts, 1)
    n_bytes = np.maximum(np.diff(offsets), 1)
    lead = (data & 0xC0) != 0x80
    characters = _per_row(lead, offsets)
    n_chars = np.maximum(characters, 1)
    share = lambda mask: _per_row(mask, offsets) / n_chars
    is_upper = (data >= 0x41) & (data <= 0x5A)
    is_lower = (data >= 0x61) & (data <= 0x7A)
    is_digit = (data >= 0x30) & (data <= 0x39)
    punct = PUNCTUATION[data] if len(data) else np.zeros(0, bool)
    plain = np.isin(data, np.frombuffer(b".,;:'\"()?-", np.uint8))
    within = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
    in_punct, in_upper, in_lower, in_digit = within(punct), within(is_upper), within(is_lower), within(is_digit)
    symbol = punct & ~plain
    ends_symbol = symbol[ends - 1] if len(ends) else np.zeros(0, bool)
    per_word = lambda mask: _per_row(mask, rows) / n_words
    keys = hash_spans(data, starts, ends)
    row_of = np.repeat(np.arange(n), counts)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        order = np.lexsort((keys, row_of))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (row_of[order][1:] != row_of[order][:-1])
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(order)))
        np.add.at(distinct, row_of[order][at], 1)
        np.maximum.at(top, row_of[order][at], times)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (row_of[1:] == row_of[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, row_of, size)
    breaks = data == 0x0A
    lines = _per_row(breaks, offsets) + (n_bytes > 0)
    # Lines by their hash: the bytes between breaks.
    edge = breaks.copy()
    line_starts = np.union1d(np.flatnonzero(edge) + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_keys, line_row = hash_spans(data, line_starts, line_ends), np.searchsorted(offsets, line_starts, "right") - 1
    unlike = np.zeros(n)
    if len(line_keys):
        order = np.lexsort((line_keys, line_row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (line_keys[order][1:] != line_keys[order][:-1]) | (line_row[order][1:] != line_row[order][:-1])
        np.add.at(unlike, line_row[order][fresh], 1)
    total_lines = np.bincount(line_row, minlength=n).astype(np.float64) if len(line_row) else np.zeros(n)
    one = {name: share(data == ord(c)) for name, c in (("bang", "!"), ("pipe", "|"), ("hash", "#"), ("star", "*"), ("dollar", "$"), ("percent", "%"), ("ampersand", "&"))}
    table = {
        "characters": np.log1p(characters), "words": np.log1p(counts), "lines": np.log1p(lines), "upper": share(is_upper), "digits": share(is_digit),
        "punctuation": share(punct), "other_symbols": share(symbol), "word_mean": _per_row(size, rows) / n_words, "word_longest": np.log1p(longest),
        "distinct_words": distinct / n_words, "top_word": top / n_words, "repeated_next": per_word(again), "symbol_ends": per_word(ends_symbol),
        "symbol_words": per_word(in_punct == size), "upper_words": per_word((in_upper > 0) & (in_lower == 0)), "digit_words": per_word(in_digit > 0),
        "line_mean": np.log1p(characters / np.maximum(lines, 1)), "short_words": per_word(size <= 3),
        "repeated_lines": 1 - unlike / np.maximum(total_lines, 1), "non_ascii": 1 - _per_row(data < 0x80, offsets) / n_bytes, **one,
    }
    empty = np.diff(offsets) == 0
    out = np.column_stack([table[f] for f in FEATURES])
    out[empty] = 0
    return out


@dataclass
class Forest:
    """Trees as flat arrays: an inner node has a feature, a threshold and the place of its left child (the right one follows); a leaf has feature -1 and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for all rows; every step takes all rows of all trees down one level."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, self.left[at] + (x[rows, f] > self.threshold[at]))
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boosts ``trees`` trees on logistic loss. A split needs ``least`` rows on either side."""
    if not len(y):
        return Forest(np.full(1, -1), np.zeros(1), np.zeros(1, np.int64), np.zeros(1), np.zeros(0, np.int64), 0.0)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    k = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    feature, threshold, left, value, roots = [], [], [], [], []
    raw = np.full(len(y), base)
    flat = binned + np.arange(k) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = p - y, p * (1 - p)
        roots.append(len(feature))
        at = np.full(len(y), len(feature))
        nodes = [len(feature)]
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        for level in range(depth + 1):
            following = []
            for node in nodes:
                own = np.flatnonzero(at == node)
                g, h = slope[own].sum(), bend[own].sum()
                value[node] = float(-rate * g / (h + ridge))
                if level == depth or len(own) < 2 * least:
                    continue
                places = flat[own].ravel()
                hist = [np.bincount(places, np.repeat(w, k), minlength=k * bins).reshape(k, bins).cumsum(axis=1) for w in (slope[own], bend[own], np.ones(len(own)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(nl < least) | (len(own) - nl < least)] = -1
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[node], threshold[node], left[node] = int(j), float(cuts[j][b]), len(feature)
                at[own] = len(feature) + (binned[own, j] > b)
                following += [len(feature), len(feature) + 1]
                for _ in range(2):
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            nodes = following
        raw += np.array(value)[at]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), base)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Forest:
    """A forest from the labelled rows that are not held out, at most ``most`` of them."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).select("doc_id", F.col("quality").cast("double").alias("__quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "__quality").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__quality")  # ``most`` rows of two numbers

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [statistics(d, o) for _, _, d, o in slices(*text_buffers(batch.column(0)))]
        x = np.concatenate(made) if made else np.zeros((0, len(FEATURES)))
        return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]

    got = append_columns(rows, T.StructType([T.StructField("__x", T.ArrayType(T.DoubleType()))]), compute, ["text"]).select("__x", "__quality").toArrow()
    x = np.array(got.column("__x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("__quality").to_numpy()
    order = np.lexsort((*x.T, y))  # the same forest in whatever order the rows came
    return fit(x[order], y[order])


def score(df: DataFrame, forest: Forest, text: str = "text", cut: float = CUT) -> DataFrame:
    """``df`` with score and predicted (1 if the score reaches ``cut``)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [forest.scores(statistics(d, o)) for _, _, d, o in slices(*text_buffers(batch.column(0)))]
        found = np.concatenate(made) if made else np.zeros(0)
        return [pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32), pa.int32())]

    return append_columns(df, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), compute, [text])
