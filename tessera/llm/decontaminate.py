"""Benchmark decontamination: passages of the corpus query a BM25 index of test items through block-max WAND.

Index: an item is cut into units of at most UNIT words. A term's weight in a unit is its BM25 weight divided by the
unit's weight as a whole, so a unit that a passage holds entirely scores 1 and one threshold serves all. Units form
blocks; the index keeps each term's greatest weight in each block.

Query: every text is cut into passages of 2 * UNIT words that overlap by half, so each occurrence of a unit lies wholly
in one. Passages whose terms' greatest weights stay below the threshold end there; sums of block maxima then name the
blocks that can reach it; within these the postings are walked with WAND pivots. All units at or above the threshold
are retrieved. The retrieved pairs are verified: shares of the five-word shingles of the question, and of the answer,
that the passages hold; a side of one to four words must occur as a whole.

An item's answer is its last third unless the items have columns question and answer; a question or answer of one to
four words counts as held where these words stand next to each other. The index is built from parts of bounded size, one
search for each, so it need not fit in memory as a whole; document frequencies, the number of units and their mean
length are taken over all items first, so scores do not depend on the number of parts.

Defined results: null, empty and wordless texts match nothing, likewise items without words; equal items each match;
items that share an id are tried each by itself, and the best of them gives the row; items without an id are ignored;
repeated rows of documents match each, documents without an id too; an empty table on either side gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import checkpointed, share_code, slices, text_buffers
from tessera.llm._words import normalised_words, window_hashes

UNIT = 64
BLOCK = 4
#: Share of a unit's weight that a passage must hold to be retrieved.
THRESHOLD = 0.5
#: Share of the question's and of the answer's shingles that must be found.
OVERLAP = 0.5
WIDTH = 5
K1, B = 1.2, 0.75
#: Bytes of items in one index; beyond it the items are searched in several blocks.
INDEX_BYTES = 16 << 20
#: Entries of a dense table of block maxima that one step adds up.
DENSE = 1 << 22


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(words, np.array([0, len(words)]), width)[1] if len(words) >= width else np.zeros(0, np.uint64)


def _side(text: str | None) -> tuple[int, np.ndarray]:
    """Width and hashes of the windows of a question or answer: WIDTH words, or all of them if there are fewer."""
    words, _ = normalised_words(pa.array([text or ""]))
    width = min(WIDTH, max(1, len(words)))
    return width, np.unique(_windows(words, width))


#: Number of units, mean words of a unit, and the number of units that hold each term.
Statistics = tuple[int, float, dict[int, int]]


def item_units(question: str | None, answer: str | None) -> list[np.ndarray]:
    """The words of an item in units of at most UNIT."""
    words, _ = normalised_words(pa.array([f"{question or ''} {answer or ''}"]))
    return np.array_split(words, -(-len(words) // UNIT)) if len(words) else []


def statistics(units: list[np.ndarray]) -> Statistics:
    return len(units), sum(map(len, units)) / max(len(units), 1), Counter(t for words in units for t in np.unique(words).tolist())


class Index:
    """Inverted index of units, with block maxima."""

    def __init__(self, items: list[tuple[int, str, str]], corpus: Statistics | None = None):
        """``items``: (item_id, question, answer); an id may occur several times. ``corpus``: statistics over all items, if these are a part."""
        units: list[tuple[int, np.ndarray]] = []
        self.ids: list[int] = []
        self.sides: list[tuple[tuple[int, np.ndarray], ...]] = []
        for number, (item, question, answer) in enumerate(items):
            self.ids.append(item)
            self.sides.append((_side(question), _side(answer)))
            units += [(number, part) for part in item_units(question, answer)]
        self.item = np.array([i for i, _ in units], np.int64)
        bags = [Counter(w.tolist()) for _, w in units]
        n, mean, df = corpus or statistics([w for _, w in units])
        self.terms = np.array(sorted({t for bag in bags for t in bag}), np.uint64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in place]
        for u, (bag, (_, words)) in enumerate(zip(bags, units, strict=True)):
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in bag.items()}
            whole = sum(weight.values())
            for t, w in weight.items():
                self.postings[place[t]].append((u, float(w / whole)))
        self.greatest = np.array([max(w for _, w in p) for p in self.postings], np.float32)
        self.blocks = -(-len(units) // BLOCK)
        of_block: list[tuple[np.ndarray, np.ndarray]] = []
        for p in self.postings:
            best: dict[int, float] = defaultdict(float)
            for u, w in p:
                best[u // BLOCK] = max(best[u // BLOCK], w)
            of_block.append((np.fromiter(best, np.int64, len(best)), np.fromiter(best.values(), np.float64, len(best))))
        self.of_block = of_block

    def block_maxima(self, low: int, high: int) -> np.ndarray:
        """Greatest weight of each term in the blocks from ``low`` to ``high``."""
        out = np.zeros((len(self.terms), high - low), np.float32)
        for t, (blocks, best) in enumerate(self.of_block):
            inside = (blocks >= low) & (blocks < high)
            out[t, blocks[inside] - low] = best[inside]
        return out

    def walk(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Units of a block that reach the threshold for a query of these terms, by WAND over the block's postings."""
        cursors = []
        for t in terms.tolist():
            own = [(u, w) for u, w in self.postings[t] if u // BLOCK == block]
            if own:
                cursors.append([own, 0, max(w for _, w in own)])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= threshold - 1e-6:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][1]][0] == pivot:
                total = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == pivot)
                if total >= threshold - 1e-6:
                    found.append((pivot, total))
                for c in cursors:
                    if c[0][c[1]][0] == pivot:
                        c[1] += 1
            else:
                for c in cursors:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found


class Searcher:
    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        step = max(1, DENSE // max(1, len(index.terms)))
        self.tables = [(low, index.block_maxima(low, min(low + step, index.blocks))) for low in range(0, index.blocks, step)]

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the verified matches."""
        index = self.index
        words, rows = normalised_words(texts)
        if not len(words) or not len(index.terms):
            return []
        term = np.searchsorted(index.terms, words)
        term[term == len(index.terms)] = 0
        at = np.flatnonzero(index.terms[term] == words)
        term = term[at]
        counts = np.diff(rows)
        # Passages start at each multiple of UNIT; the last one of a text ends with it.
        passages = np.maximum(1, -(-counts // UNIT) - 1)
        first = np.concatenate([[0], np.cumsum(passages)])
        row = np.searchsorted(rows, at, "right") - 1
        half = (at - rows[row]) // UNIT
        last = np.minimum(half, passages[row] - 1)
        prior = half - 1
        two = (prior >= 0) & (prior < passages[row]) & (prior != last)
        key = np.concatenate([first[row] + last, (first[row] + prior)[two]]) * len(index.terms) + np.concatenate([term, term[two]])
        key = np.unique(key)
        passage, term = key // len(index.terms), key % len(index.terms)
        begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
        if not len(begin):
            return []
        # A passage's greatest possible score over all units.
        able = np.add.reduceat(index.greatest[term], begin) >= self.threshold - 1e-5
        keep = np.repeat(able, np.diff(np.append(begin, len(passage))))
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return []
        begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        end = np.append(begin[1:], len(passage))
        scores: dict[tuple[int, int], float] = defaultdict(float)
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for low, table in self.tables:
            step = max(1, DENSE // table.shape[1])
            a = 0
            while a < len(begin):
                b = max(a + 1, int(np.searchsorted(end, begin[a] + step, "right")))
                sums = np.add.reduceat(table[term[begin[a] : end[b - 1]]], begin[a:b] - begin[a], axis=0)
                for p, block in zip(*np.nonzero(sums >= self.threshold - 1e-4), strict=True):
                    own = slice(begin[a + p], end[a + p])
                    number = int(passage[begin[a + p]])
                    r = int(np.searchsorted(first, number, "right")) - 1
                    for unit, total in index.walk(term[own], low + int(block), self.threshold):
                        pair = (r, int(index.item[unit]))
                        scores[pair] = max(scores[pair], total)
                        where[pair].add(number - int(first[r]))
                a = b
        return list(self._verify(words, rows, counts, scores, where))

    def _verify(self, words, rows, counts, scores, where) -> Iterator[tuple[int, int, float, float, float]]:
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for (r, item), total in scores.items():
            shares = []
            for width, side in self.index.sides[item]:
                for k in where[r, item]:
                    if (r, k, width) not in held:
                        held[r, k, width] = _windows(words[rows[r] + k * UNIT : rows[r] + min((k + 2) * UNIT, int(counts[r]))], width)
                have = np.concatenate([held[r, k, width] for k in where[r, item]])
                shares.append(float(np.isin(side, have).mean()) if len(side) else 1.0)
            if min(shares) >= self.overlap:
                pair = (r, self.index.ids[item])
                best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (total, shares[0], shares[1]))
        for (r, item), found in best.items():
            yield r, item, *found


def item_sides(items: DataFrame) -> DataFrame:
    """item_id, question, answer: from columns of these names, or from text with its last third as the answer."""
    names = {c.lower() for c in items.columns}
    if {"question", "answer"} <= names:
        return items.select(F.col("item_id").cast("long").alias("item_id"), "question", "answer")
    words = F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")
    cut = F.greatest(F.lit(0), F.size(words) - F.greatest(F.lit(WIDTH), F.floor(F.size(words) / 3)).cast("int"))
    return items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.array_join(F.slice(words, F.lit(1), cut), " ").alias("question"),
        F.array_join(F.slice(words, cut + 1, F.size(words)), " ").alias("answer"),
    )


def _parts(items: DataFrame) -> Iterator[tuple[list[tuple[int, str, str]], Statistics]]:
    """The items in parts of INDEX_BYTES (give or take the hash's spread), each with the statistics of all items for its terms."""
    share_code(items.sparkSession)
    sides = checkpointed(item_sides(items).filter("item_id is not null").distinct())
    size = sides.agg(F.sum(F.octet_length(F.concat_ws(" ", "question", "answer")))).first()[0] or 0
    parts = max(1, -(-int(size) // INDEX_BYTES))
    sides = sides.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, term, units that hold it and words; the row without a term sums all units of the batch and their words."""
        for batch in batches:
            out: list[tuple[int, int | None, int, int]] = []
            for part, question, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = item_units(question, answer)
                out.append((part, None, len(units), sum(map(len, units))))
                out += [(part, int(np.uint64(t).view(np.int64)), n, 0) for t, n in statistics(units)[2].items()]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "term", "units", "words"])

    counted = checkpointed(sides.select("part", "question", "answer").mapInArrow(count, "part int, term long, units long, words long").groupBy("part", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words")))
    n, words = counted.filter("term is null").agg(F.coalesce(F.sum("units"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    frequency = counted.filter("term is not null").groupBy("term").agg(F.sum("units").alias("df"))
    for part in range(parts):
        own = sides.filter(F.col("part") == part).orderBy("item_id", "question", "answer").select("item_id", "question", "answer").collect()
        terms = counted.filter((F.col("part") == part) & F.col("term").isNotNull()).select("term").join(frequency, "term").collect()
        yield [tuple(r) for r in own], (n, words / max(n, 1), {t & (2**64 - 1): df for t, df in terms})


def _searching(spark: SparkSession, part: tuple, threshold: float, overlap: float):
    """A function that makes the searcher of a part of the items, in a worker."""
    shared = spark.sparkContext.broadcast(part)  # INDEX_BYTES of items, and the frequencies of their terms
    return lambda: Searcher(Index(*shared.value), threshold, overlap)


def contaminated(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and test item that it holds."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for part in _parts(items):

        def step(batches: Iterator[pa.RecordBatch], make=_searching(df.sparkSession, part, threshold, overlap)) -> Iterator[pa.RecordBatch]:
            searcher = make()
            for batch in batches:
                texts, ids = batch.column("text"), batch.column("doc_id")
                for a, b, _, _ in slices(*text_buffers(texts)):
                    rows = searcher.search(texts.slice(a, b - a))
                    if rows:
                        r, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(r)), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = docs.mapInArrow(step, schema)
        found = hits if found is None else found.union(hits)
    return found


def without_leaks(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no test item, each judged by itself (whatever its id), with all columns; no shuffle."""
    kept, place = df, df.columns.index(text)
    for part in _parts(items):

        def step(batches: Iterator[pa.RecordBatch], make=_searching(df.sparkSession, part, threshold, overlap)) -> Iterator[pa.RecordBatch]:
            searcher = make()
            for batch in batches:
                texts = batch.column(place)
                stay = np.ones(batch.num_rows, bool)
                for a, b, _, _ in slices(*text_buffers(texts)):
                    stay[[a + row[0] for row in searcher.search(texts.slice(a, b - a))]] = False
                yield batch.filter(pa.array(stay))

        kept = kept.mapInArrow(step, df.schema)
    return kept


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[int, str, str]], overlap: float = OVERLAP) -> set[tuple[int, int]]:
    """Pairs whose overlaps in the document as a whole reach ``overlap``, from strings alone; for tests."""
    import string

    def words(text: str | None) -> list[str]:
        found = (w.strip(string.punctuation) for w in re.split("[ \t-\r]+", (text or "").lower()))
        return [w for w in found if w]

    def runs(own: list[str], width: int) -> set[tuple[str, ...]]:
        return {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}

    out = set()
    texts = {d: words(t) for d, t in rows}
    for item, question, answer in items:
        sides = [words(s) for s in (question, answer)]
        goals = [(min(WIDTH, len(s)), runs(s, min(WIDTH, len(s)))) for s in sides if s]
        if goals:
            out |= {(d, item) for d, own in texts.items() if all(len(goal & runs(own, width)) >= overlap * len(goal) for width, goal in goals)}
    return out
