"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Signatures: a shingle that occurs c times owns the weight range [0, c), which is discretised at 0, 1, 2, 4, 8, ...
Each range between two marks has a Poisson process whose rate is the range's width; each point has a time, a component
and a height in its range. A document's component takes the earliest point that falls to it at a height below c. Two
documents have the same point with a probability equal to their weighted Jaccard similarity, and a document costs only
the points before all its components are filled, however heavy its shingles are.

Bands of ROWS components send documents to buckets. In each bucket all members are held against one leader (by exact
multiset overlap of the texts), the leader being another one in each band. Buckets whose members then still lie in
several classes are looked at again: small ones by all pairs of their classes, larger ones by leaders within finer
buckets (two bands at a time). Larger ones that hold several classes even then are compared in full, block against
block, all members of different classes; such a block emits at most a link a member. So every pair that shares a bucket
is compared or is in one class already, and work grows with members times those of other classes. Classes are the
connected components of the verified links. Texts with the same normalised words are one node, so exact copies make no
pairs.

Words are lower case without ASCII punctuation at their ends; a text of one to four words is one shingle. Defined
results: null, empty and wordless texts are copies of one another; of a class the least id stays; rows with equal ids
fall into one class; rows without an id have no class (class_id null) and stay; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import checkpointed, list_array, share_code, slices, text_buffers
from tessera.llm._words import mix, normalised_words, shingles

SIMILARITY = 0.8
WIDTH = 5
#: At a similarity of 0.8 a pair misses all 25 bands of 5 with a probability of 5e-5.
BANDS, ROWS = 25, 5
#: Buckets of up to so many texts are compared class by class in full.
SMALL_BUCKET = 32
#: Finer buckets join a band with each of the next so many.
FINER = 3
#: Partners of one text that are compared in one place.
SALTED = 1000
#: Bytes of the texts of a block of a larger bucket (a text counts as 1 kB at least).
BLOCK_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bags(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each row."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return row[at], hashes[at], np.diff(np.append(at, len(row)))


def signatures(hashes: np.ndarray, rows: np.ndarray, components: int = BANDS * ROWS) -> np.ndarray:
    """The id of the earliest point of each component, for each row; rows without shingles get zeros."""
    n = len(rows) - 1
    row, key, count = bags(hashes, rows)
    # A process for each range of weights: level 0 is [0, 1), level j is [2^(j-1), 2^j).
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    base = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(base)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1).astype(np.float64)
    row, top = row[base], (count[base] - low) / rate  # heights below top count
    seed = mix(key[base] ^ (level.astype(np.uint64) * _GOLD), 3)
    weight = np.zeros(n)
    np.add.at(weight, row, np.minimum(top, 1) * rate)
    found = np.zeros((n, components), np.uint64)
    open_rows = np.flatnonzero(weight > 0)
    until = components * (np.log(components) + 4) / np.maximum(weight, 1)
    while len(open_rows):
        live = np.zeros(n, bool)
        live[open_rows] = True
        use = np.flatnonzero(live[row])
        times = np.full(n * components, np.inf)
        ids = np.zeros(n * components, np.uint64)
        for who, time, bits in _points(seed[use], rate[use], until[row[use]]):
            own = use[who]
            height = _unit(mix(bits, 5))
            fits = height <= top[own]
            own, time, bits = own[fits], time[fits], bits[fits]
            slot = row[own] * components + (mix(bits, 6) % np.uint64(components)).astype(np.int64)
            np.minimum.at(times, slot, time)
            wins = time == times[slot]
            ids[slot[wins]] = bits[wins]
        full = np.isfinite(times.reshape(n, components)).all(axis=1)
        done = open_rows[full[open_rows]]
        found[done] = ids.reshape(n, components)[done]
        open_rows = open_rows[~full[open_rows]]
        until[open_rows] *= 2
    return found


def _points(seed: np.ndarray, rate: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All points of each process up to its time ``until``: (process, time, random bits), in blocks."""
    many = np.flatnonzero(rate * until > 16)
    few = np.flatnonzero(rate * until <= 16)
    time, k = np.zeros(len(few)), 0
    while len(few):
        bits = mix(seed[few] + np.uint64(k * int(_GOLD) % 2**64), 4)
        time = time - np.log(_unit(mix(bits, 7))) / rate[few]
        inside = time <= until[few]
        few, time, bits, k = few[inside], time[inside], bits[inside], k + 1
        yield few, time, bits
    done = np.zeros(len(many))
    k = 0
    while len(many):
        # Processes with many points draw a block of 64 at once.
        bits = mix(seed[many][:, None] + (np.arange(k, k + 64, dtype=np.uint64) * _GOLD)[None, :], 4)
        times = done[:, None] - np.cumsum(np.log(_unit(mix(bits, 7))), axis=1) / rate[many][:, None]
        inside = times <= until[many][:, None]
        yield np.broadcast_to(many[:, None], inside.shape)[inside], times[inside], bits[inside]
        more = inside[:, -1]
        many, done, k = many[more], times[more, -1], k + 64


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each row and band."""
    parts = found.reshape(len(found), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total ^ parts[:, :, k], 8)
    return total


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, two halves of a hash of the normalised words, and the band keys."""
    share_code(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, last, _, _ in slices(*text_buffers(texts)):
                words, rows = normalised_words(texts.slice(first, last - first))
                place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
                halves = []
                for seed in (21, 22):
                    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place.astype(np.uint64), seed), seed))])
                    halves.append((run[rows[1:]] - run[rows[:-1]]).view(np.int64))
                hashes, at = shingles(words, rows, WIDTH)
                some = np.diff(at) > 0
                keys = band_keys(signatures(hashes, at)).view(np.int64)[some]
                bands = list_array(keys.ravel(), some * BANDS, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(halves[0]), pa.array(halves[1]), bands], names=["doc_id", "h1", "h2", "bands"])

    return docs.mapInArrow(step, "doc_id long, h1 long, h2 long, bands array<long>")


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags given as sorted distinct hashes and counts."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 1.0


def _bag_list(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, rows = shingles(*normalised_words(texts), WIDTH)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b, members) whose texts overlap enough, as multisets of shingles.

    A text b may have any number of partners, ``members`` for one bucket at most: its pairs are salted by a, SALTED to a
    salt and bucket, and b's text goes once to each salt.
    """
    share_code(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _ in slices(*text_buffers(batch.column("text_a"))):
                part = batch.slice(first, last - first)
                other = part.column("b").to_pylist()
                one = {b: k for k, b in reversed(list(enumerate(other)))}  # a leader's text is read once a batch
                where = list(one.values())
                bags_b = dict(zip(one, _bag_list(part.column("text_b").take(pa.array(where))), strict=True))
                near = [bag_similarity(x, bags_b[b]) >= similarity for x, b in zip(_bag_list(part.column("text_a")), other, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(near))

    texts = docs.select("doc_id", "text")
    salts = F.floor(F.col("members") / SALTED) + 1
    leading = pairs.groupBy("b").agg(F.max("members").alias("members"))
    sides = leading.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    sides = sides.select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "text_b")
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    with_a = salted.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(sides, ["b", "salt"])
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(step, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id that each linked id (a, b) reaches."""
    from tessera.operators.graph import components as connected  # here, as workers that import this module need none of it

    return connected(links)


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    """Distinct pairs a (rep) and b (``other``), with the most members of a bucket in which they met."""
    return rows.groupBy(F.col("rep").alias("a"), F.col(other).alias("b")).agg(F.max("members").alias("members"))


def _led(buckets: DataFrame, key: str) -> DataFrame:
    """``buckets`` (key, rep) of two members at least, with a leader: the least rep after a flip of bits by the key, so another one in each band.

    The rows of the join are two numbers; AQE splits a key that a large share of all rows have.
    """
    lead = buckets.groupBy(key).agg(F.min(F.col("rep").bitwiseXOR(F.col(key))).alias("least"), F.count("*").alias("members")).filter("members > 1")
    return buckets.join(lead.select(key, "members", F.col("least").bitwiseXOR(F.col(key)).alias("leader")), key)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, the copies of one shingle numbered, so that the overlap of multisets is that of sets; row positions."""
    row, key, count = bags(*shingles(*normalised_words(texts), WIDTH))
    base = np.repeat(np.arange(len(row)), count)
    copy = np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.searchsorted(row[base], np.arange(len(texts) + 1))
    return mix(key[base] ^ (copy.astype(np.uint64) * _GOLD), 9), rows


def block_links(left: np.ndarray, class_of: np.ndarray, texts: pa.Array, similarity: float) -> list[tuple[int, int]]:
    """Rows (i, j) that link all classes among these texts that have a similar pair; ``left`` rows meet the others, or all meet all if none are others."""
    tokens, rows = _tokens(texts)
    known, tokens = np.unique(tokens, return_inverse=True)
    size = np.diff(rows)
    root = np.unique(class_of, return_inverse=True)[1]
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(two):
        two = one
    elif len(one) > len(two):
        one, two = two, one
    parts = [tokens[rows[j] : rows[j + 1]] for j in two.tolist()]
    flat = np.concatenate(parts)
    begin = np.concatenate([[0], np.cumsum(size[two])])
    held, out = np.zeros(len(known), bool), []
    for i in one.tolist():
        able = np.flatnonzero((root[two] != root[i]) & (np.minimum(size[two], size[i]) >= similarity * np.maximum(size[two], size[i]) - 1e-9))
        if not len(able):
            continue
        own = tokens[rows[i] : rows[i + 1]]
        held[own] = True
        if 2 * len(able) > len(two):
            run = np.concatenate([[0], np.cumsum(held[flat])])
            common = (run[begin[1:]] - run[begin[:-1]])[able]
        else:
            run = np.concatenate([[0], np.cumsum(held[np.concatenate([parts[k] for k in able.tolist()])])])
            at = np.concatenate([[0], np.cumsum(size[two[able]])])
            common = run[at[1:]] - run[at[:-1]]
        held[own] = False
        total = size[i] + size[two[able]] - common
        for j in two[able[common / total >= similarity]].tolist():
            if root[i] != root[j]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _exhausted(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the classes of each bucket of ``members`` (key, rep, class), all pairs of different classes compared in blocks."""
    share_code(docs.sparkSession)
    sized = members.join(docs.select(F.col("doc_id").alias("rep"), F.greatest(F.octet_length("text"), F.lit(1024)).cast("long").alias("bytes")).groupBy("rep").agg(F.sum("bytes").alias("bytes")), "rep")
    before = Window.partitionBy("key").orderBy("class", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = checkpointed(sized.select("key", "rep", "class", F.floor(F.sum("bytes").over(before) / BLOCK_BYTES).alias("block")))
    blocks = sized.groupBy("key", "block").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    others = blocks.select("key", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = blocks.join(others, "key").filter("block <= block2 and least(low, low2) < greatest(high, high2)")
    sides = met.select("key", F.explode(F.array_distinct(F.array("block", "block2"))).alias("own"), F.col("block").alias("i"), F.col("block2").alias("j"))
    dealt = sides.join(sized.withColumnRenamed("block", "own"), ["key", "own"])
    dealt = dealt.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("key", "i", "j", "own", "rep", "class", "text")

    def step(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        left = np.asarray(group.column("own")) == np.asarray(group.column("i"))
        reps = np.asarray(group.column("rep"))
        found = block_links(left, np.asarray(group.column("class")), group.column("text"), similarity)
        a, b = reps[[i for i, _ in found]], reps[[j for _, j in found]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(step, "a long, b long").distinct()


def _widened(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, root) after further links (a, b), which join whole classes, so they are drawn between their least ids."""
    side = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    drawn = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    drawn = drawn.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y").select(*_ordered("x", "y"))
    joined = components(drawn)
    upper = joined.select(F.col("id").alias("root"), F.col("root").alias("top"))
    lower = roots.join(upper, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return lower.union(joined.join(roots.select("id"), "id", "left_anti").select("id", "root"))


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of those buckets (key, rep, ...) that hold several classes, with their class."""
    classed = buckets.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("root", "rep")).drop("root")
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    return checkpointed(classed.join(mixed, "key"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, copy_of (least id with the same normalised words), class_id (least id of the class), keep (whether it is that one)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes = checkpointed(_nodes(docs))
    reps = nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    reps = checkpointed(reps.filter("rep is not null"))
    buckets = _led(reps.select("rep", F.posexplode("bands").alias("band", "key")), "key")
    buckets = checkpointed(buckets.select("key", "band", "rep", "leader", "members"))
    first = checkpointed(_pairs(buckets.filter("rep <> leader"), "leader"))
    links = checkpointed(verified(first, docs, similarity))
    roots = components(links)

    # Buckets that still hold several classes.
    again = _mixed(buckets.select("key", "band", "rep", "members"), roots)
    small = again.filter(F.col("members") <= SMALL_BUCKET).select("key", "rep", "class")
    other = small.select("key", F.col("rep").alias("rep2"), F.col("class").alias("class2"))
    within = small.join(other, "key").filter("class < class2").select("rep", "rep2", F.lit(1).cast("long").alias("members"))
    large = again.filter(F.col("members") > SMALL_BUCKET).join(reps.select("rep", "bands"), "rep")
    steps = F.array(*(F.xxhash64("key", F.expr(f"bands[(band + {d}) % {BANDS}]")) for d in range(1, FINER + 1)))
    finer = large.select("rep", "class", F.explode(steps).alias("key"))
    leading = roots.select(F.col("id").alias("leader"), F.col("root").alias("leader_root"))
    finer = _led(finer.select("key", "rep", "class"), "key").join(leading, "leader", "left").filter(F.col("class") != F.coalesce("leader_root", "leader"))
    second = _pairs(within.union(finer.select("rep", "leader", "members")), "rep2").join(first, ["a", "b"], "left_anti")
    roots = checkpointed(_widened(roots, verified(checkpointed(second), docs, similarity)))

    # Larger buckets that hold several classes even then.
    rest = _mixed(again.filter(F.col("members") > SMALL_BUCKET).select("key", "rep"), roots)
    if not rest.isEmpty():
        roots = _widened(roots, checkpointed(_exhausted(rest, docs, similarity)))

    named = reps.select("h1", "h2", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "rep", F.coalesce("root", "rep").alias("class_id"))
    told = nodes.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    known = F.col("doc_id").isNotNull()
    return told.select(
        "doc_id",
        F.when(known, F.col("rep")).alias("copy_of"),
        F.when(known, F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("keep"),
    )


def brute_force(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> dict[int, int]:
    """doc_id: class_id, from all pairs; for tests."""
    bag = dict(zip([d for d, _ in rows], _bag_list(pa.array([t or "" for _, t in rows])), strict=True))
    parent = {d: d for d in bag}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(bag)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            na, nb = int(bag[a][1].sum()), int(bag[b][1].sum())
            if min(na, nb) >= similarity * max(na, nb) and bag_similarity(bag[a], bag[b]) >= similarity:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in bag}
