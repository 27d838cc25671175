"""Operators against brute force, and each one's results for nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontaminate, fingerprints, licenses, near_dedup, pii, quality, substring_dedup, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def _texts():
    r = random.Random(4)
    base = _words(r, 120)
    passage = _words(r, 30)
    rows = [(i, _words(r, r.randint(1, 200))) for i in range(20)]
    rows += [(100, base), (101, base), (102, base.replace(base.split()[60], "changed", 1)), (103, f"{_words(r, 40)} {passage} {_words(r, 9)}"), (104, f"{passage}\n{_words(r, 50)}")]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "x" * 150_000), (204, "a b " * 20_000), (205, "Éñ 🙂 'tis don't  naïve x"), (206, "one two"), (207, "one two"), (208, "!!! ???")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Repeated ids and clashing names besides the texts."""
    full = [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + ", n_tokens int, ids string, pii string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _tiktoken():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, rows, empty):
    theirs = _tiktoken()
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs), text="again").collect()
    assert all(r.again == (r.text or "") for r in back)
    assert bpe.round_trip(empty).count() == 0 and bpe.encode(empty).count() == 0


def test_bpe_on_random_strings():
    r = random.Random(2)
    theirs, own = _tiktoken(), bpe.codec(bpe.default_path())
    parts = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "\xa0", "1", "²", "é", "中", "🙂", "!", "_", "<|endoftext|>", "abc", "́", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    data, offsets = bpe.text_buffers(pa.array(texts))
    ids, counts = own.encode(data, offsets)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == theirs.encode_ordinary(t)


def test_bpe_of_matches_with_equal_hashes(monkeypatch):
    """Were all hashes equal, ids would still be right, in one batch and against what is known."""
    theirs, known = _tiktoken(), bpe.vocabulary(bpe.default_path())
    monkeypatch.setattr(bpe, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    own = bpe.Codec(known)
    for text in ("one two three", "four five one", ""):
        ids, _ = own.encode(*bpe.text_buffers(pa.array([text])))
        assert ids.tolist() == theirs.encode_ordinary(text)
    for bad in (-1, len(known[0])):
        with pytest.raises(ValueError):
            own.decode(np.array([5, bad]))


def test_bpe_offsets_and_split_characters(spark):
    df = spark.createDataFrame([(1, "naïve 🙂 x"), (2, None)], "doc_id long, text string")
    row = bpe.encode(df, spans="spans").orderBy("doc_id").collect()[0]
    text = row.text
    pieces = [text[s.start : s.end] for s in row.spans]
    assert pieces[0][0] == "n" and row.spans[-1].end == len(text)
    assert "".join(dict.fromkeys((s.start, s.end) for s in row.spans) and [text[a:b] for a, b in dict.fromkeys((s.start, s.end) for s in row.spans)]) == text
    assert "".join(bpe.decode_stream([[i] for i in row.ids])) == text


def test_token_counts(spark, docs, rows, empty):
    own = bpe.codec(bpe.default_path())
    sizes = sorted(int(own.count(*bpe.text_buffers(pa.array([t or ""])))[0]) for _, t in rows)
    report = token_counts.limits(token_counts.histogram(docs)).collect()
    assert sum(r.docs for r in report) == len(rows)
    for r in report:
        within = [s for s in sizes if s <= r.n_tokens]
        assert (r.docs_within, r.tokens_within, r.docs_over, r.tokens_over) == (len(within), sum(within), len(sizes) - len(within), sum(sizes) - sum(within))
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    table = spark.createDataFrame(report)
    assert token_counts.quantiles(table, [0.0, 0.5, 1.0]).orderBy("share").collect()[1].n_tokens == sizes[(len(sizes) - 1) // 2 if len(sizes) % 2 else len(sizes) // 2 - 1]
    for r in token_counts.at_limits(table, [0, 3, 100, 10**6]).collect():
        assert r.truncated_total == sum(min(s, r["limit"]) for s in sizes)
    assert token_counts.limits(token_counts.histogram(empty)).count() == 0


def test_substring_dedup(docs, rows, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.deduplicate(docs)).collect()}
    assert got == substring_dedup.brute_force(rows)
    assert got[101][1] == 120 and got[104][1] == 30 and got[100][1] == 0
    assert substring_dedup.deduplicate(empty).count() == 0


def test_substring_dedup_equals_its_sql(spark, rows, tmp_path):
    import duckdb

    from tessera.llm import queries

    odd = [(i, None if t is None else t.replace("🙂", "\u00a0\u2003z")) for i, t in rows]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in queries.op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.oracle_sql()["op5_substring_dedup"]).fetchall())


def test_substring_dedup_of_many_short_repeats(spark):
    r = random.Random(9)
    passages = [_words(r, 14) for _ in range(6)]
    rows = [(i, " ".join(r.choice(passages) if r.random() < 0.5 else _words(r, 5) for _ in range(r.randint(0, 12)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.digest(substring_dedup.deduplicate(df)).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_substring_dedup_repeated_and_missing_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.deduplicate(spark.createDataFrame([(1, t), (1, t), (None, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 20), (0, 20), (1, 0), (1, 0)]


def _sketch_by_strings(text):
    """The kept hashes from sets of five-word strings; a string of five words has one shingle, whose hash is looked up by itself."""
    words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in (text or "").lower().split()]
    words = [w for w in words if w]
    own = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} - {""}
    hashes = fingerprints.shingles(*fingerprints.normalised_words(pa.array(sorted(own), pa.string())), 5)[0] if own else []
    return {int(h) for h in hashes if int(h) < 2**64 // fingerprints.SCALE}


def test_fingerprints(spark, docs, rows, empty):
    order = sorted(rows, key=lambda x: -x[0])
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(_sketch_by_strings, (t, edited, following))
        assert set(map(int, fingerprints.from_text(got[i].fingerprint)[1])) == a and set(map(int, fingerprints.from_text(got[i].edited_fingerprint)[1])) == b
        same = t.lower().split() == edited.lower().split() or not (a | b) and got[i].fingerprint == got[i].edited_fingerprint
        assert got[i].near_edited == pytest.approx(1.0 if same else len(a & b) / max(1, len(a | b)))
        assert got[i].in_next == (pytest.approx(len(a & c) / len(a)) if a else None)
    assert got[100].fingerprint == got[101].fingerprint and got[101].near_next == 1.0
    assert got[201].fingerprint == "" and got[202].near_next == 1.0 and got[201].in_next is None
    assert fingerprints.compare_with_next(empty).count() == 0
    assert fingerprints.fingerprint(docs, out="ids").filter("doc_id = 206").first().ids == got[206].fingerprint


def test_fingerprints_merge_and_containment():
    r = random.Random(1)
    whole = _words(r, 4000)
    part = " ".join(whole.split()[:400])
    a, b = fingerprints.sketches(pa.array([whole, part]))
    assert fingerprints.containment(b, a) == 1.0
    assert abs(fingerprints.containment(a, b) - 0.1) < 0.04
    halves = fingerprints.sketches(pa.array([" ".join(whole.split()[:2004]), " ".join(whole.split()[2000:])]))
    assert np.array_equal(fingerprints.merge(halves), a)
    first = fingerprints.fingerprints(pa.array([whole]))[0]
    back = fingerprints.from_text(fingerprints.to_text(*first))
    assert back[0] == first[0] and np.array_equal(back[1], a)


def test_fingerprints_of_short_texts_within_long_ones():
    """A text that a longer one holds is contained in it as a whole, or its containment is unknown."""
    r = random.Random(2)
    for _ in range(300):
        long = _words(r, 400).split()
        at = r.randrange(390)
        a, b = fingerprints.sketches(pa.array([" ".join(long[at : at + 7]), " ".join(long)]))
        assert fingerprints.containment(a, b) in (None, 1.0)
    one, two = fingerprints.fingerprints(pa.array(["a b c", "d e f"]), 2**40)
    assert len(one[1]) == len(two[1]) == 0 and fingerprints.likeness(one, two) == 0 and fingerprints.likeness(one, one) == 1


def test_fingerprints_order_over_ranges(spark):
    rows = [(i * 7919 % 100_003, f"w{i} " * (i % 9)) for i in range(5000)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    for k, (i, t) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["outlier", "missing", "one"])
def test_ranges_of_uneven_ids(spark, monkeypatch, kind):
    """One id far from all others, no ids at all, or one id for all: ranges stay small and results are those of brute force."""
    from tessera.llm import _groups

    r = random.Random(15)
    passage = _words(r, 20)
    texts = [f"{_words(r, 30)} {passage} {_words(r, r.randint(1, 60))}" for _ in range(400)]
    ids = {"outlier": [*range(1, 400), 2**62], "missing": [None] * 400, "one": [7] * 400}[kind]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    ranges = _groups.id_ranges(df, "doc_id", "text", 10_000)
    sizes = [x["count"] for x in _groups.with_range(df, "doc_id", F.xxhash64("text"), ranges).groupBy("range").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 100 and len(sizes) > 5
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 10_000)
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", 10_000)
    got = substring_dedup.digest(substring_dedup.deduplicate(df)).collect()
    if kind == "outlier":
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == substring_dedup.brute_force(list(zip(ids, texts, strict=True)))
    else:
        assert len(got) == 400 and not any(x.n_removed for x in got)
    made = fingerprints.compare_with_next(df).collect()
    assert len(made) == 400
    if kind == "outlier":
        at = dict(zip(ids, texts, strict=True))
        order = sorted(ids, reverse=True)
        want = {i: (at[i][: len(at[i]) - len(at[i]) // 3] + at[order[(k + 1) % 400]][: len(at[i]) // 3]) for k, i in enumerate(order)}
        assert {x.doc_id: x.edited_sha256 for x in made} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    else:
        # Each row follows another one: the next ones' sketches are all of the rows', once each.
        assert len({x.edited_sha256 for x in made}) == 400
    mixed = spark.createDataFrame([(5, passage), (None, passage), (None, texts[0]), (3, "a b"), (9, passage)], "doc_id long, text string")
    gone = sorted((x.doc_id or 0, x.n_removed) for x in substring_dedup.deduplicate(mixed).collect())
    assert gone == [(0, 20), (0, 20), (3, 0), (5, 0), (9, 20)]


def test_near_duplicates(spark, docs, rows, empty):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = near_dedup.brute_force(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert got[102].class_id == 100 and got[101].copy_of == 100 and not got[101].keep and got[100].keep
    assert {got[i].class_id for i in (200, 201, 202, 208)} == {200}
    assert near_dedup.near_duplicates(empty).count() == 0
    twice = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.keep) for r in twice) == [(0, 0, True), (3, 3, True), (3, 3, True)]


def test_near_duplicates_of_large_groups(spark):
    """Groups of near copies that share buckets: all pairs that are similar enough end in one class."""
    r = random.Random(6)
    rows, n = [], 0
    for size in (2, 5, 60):
        base = _words(r, 150).split()
        for _ in range(size):
            own = base[:]
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = _words(r, 1)
            rows.append((n, " ".join(own)))
            n += 1
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_dedup.brute_force(rows)


def test_near_duplicates_around_a_hub(spark):
    """2,000 copies that are similar to one text, but not to each other, are one class with it, whatever leads a bucket."""
    r = random.Random(12)
    base = _words(r, 204).split()
    rows = [(5000, " ".join(base))]
    for i in range(2000):
        own = base[:]
        for k in range(4):
            own[50 * k + r.randrange(6, 44)] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    bag = near_dedup._bag_list(pa.array([t for _, t in rows]))
    assert min(near_dedup.bag_similarity(bag[0], b) for b in bag[1:]) >= 0.8
    apart = [near_dedup.bag_similarity(bag[r.randrange(1, 2001)], bag[r.randrange(1, 2001)]) < 0.8 for _ in range(500)]
    assert sum(apart) > 400
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2001 and {x.class_id for x in got} == {0}
    some = rows[:150]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == near_dedup.brute_force(some)


def test_near_duplicates_of_many_versions(spark, monkeypatch):
    """A page that changes a little from version to version is one class, though its first and last versions share nothing; so are salted leaders."""
    from tessera.operators import graph

    r = random.Random(14)
    text, rows = _words(r, 200).split(), []
    for k in range(120):
        rows.append((k, " ".join(text)))
        for place in range(5):
            text[(5 * k + place) % 200] = f"new{k}x{place}"
    monkeypatch.setattr(near_dedup, "SALTED", 2)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.class_id for x in got} == {0} and sum(x.keep for x in got) == 1
    rounds, drawn = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda d: rounds.append(1) or drawn(d))
    links = spark.createDataFrame([(k, k + 1) for k in range(512)], "a long, b long")
    assert {x.root for x in near_dedup.components(links).collect()} == {0} and len(rounds) <= 16


def test_near_duplicates_block_links():
    """Blocks link the same classes as all pairs, within one block and between two."""
    r = random.Random(13)
    texts = []
    for _ in range(12):
        base = _words(r, 60).split() + ["r"] * r.randint(0, 9)
        for _ in range(5):
            own = base[:]
            own[r.randrange(40)] = _words(r, 1)
            texts.append(" ".join(own[r.randint(0, 4) :]))
    want = near_dedup.brute_force(list(enumerate(texts)))
    bag = near_dedup._bag_list(pa.array(texts))
    for left in (np.ones(60, bool), np.arange(60) % 3 == 0):
        found = near_dedup.block_links(left, np.arange(60), pa.array(texts), 0.8)
        assert all(near_dedup.bag_similarity(bag[i], bag[j]) >= 0.8 for i, j in found)
        assert len(found) == len({tuple(sorted(p)) for p in found})
        if left.all():
            assert len(found) == 60 - len(set(want.values()))
        else:
            assert all(left[i] != left[j] for i, j in found) and {want[i] == want[j] for i, j in found} == {True}


def test_bagminhash_is_unbiased():
    one = " ".join(f"w{i}" for i in range(150)) + " r" * 40
    two = " ".join(f"w{i}" for i in range(30, 160)) + " r" * 15
    texts = pa.array([one, two])
    found = near_dedup.signatures(*near_dedup.shingles(*near_dedup.normalised_words(texts), 5), 4000)
    true = near_dedup.bag_similarity(*near_dedup._bag_list(texts))
    assert abs((found[0] == found[1]).mean() - true) < 0.03


def test_decontamination(spark, docs, empty):
    r = random.Random(8)
    items = [(k, _words(r, 40)) for k in range(30)] + [(30, None), (31, ""), (32, "tiny item")]
    leaks = [(1000 + k, f"{_words(r, r.randint(0, 300))} {items[k][1].upper()}, {_words(r, r.randint(0, 300))}") for k in range(12)]
    half = [(2000, " ".join(items[20][1].split()[:15])), (2001, f"{_words(r, 900)} {items[21][1]}"), (2002, items[22][1]), (2002, items[22][1]), (2003, "tiny item")]
    rows = _texts() + leaks + half
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame([(k, t, "x", 0.5) for k, t in items], "item_id long, text string, answer string, score double")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, table).collect()}
    sides = [tuple(x) for x in decontaminate.item_sides(table).collect()]
    assert got == decontaminate.brute_force(rows, sides)
    assert {(1000 + k, k) for k in range(12)} | {(2001, 21), (2002, 22), (2003, 32)} <= got and not any(d == 2000 for d, _ in got)
    assert decontaminate.contaminated(empty, table).count() == 0 and decontaminate.contaminated(df, table.limit(0)).count() == 0


def test_decontamination_of_short_sides(spark):
    """Questions and answers of one to four words, and items of 6 to 9 words, inside long texts."""
    r = random.Random(21)
    answers = ["Paris", "42", "B", "the red house", "one two three four"]
    items = [(k, _words(r, 20), a) for k, a in enumerate(answers)] + [(9, "who knows", "nobody knows that at all then")]
    rows = [(k, f"{_words(r, 300)} {q} {a.upper()}. {_words(r, 200)}") for k, q, a in items]
    rows += [(50, f"{_words(r, 300)} {items[0][1]} London {_words(r, 200)}"), (51, f"{_words(r, 90)} Paris {_words(r, 90)}"), (52, f"{_words(r, 99)} {items[4][1]} four three two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, table).collect()}
    assert got == {(k, k) for k in (0, 1, 2, 3, 4, 9)} == decontaminate.brute_force(rows, items)
    short = [(n, " ".join(f"word{n}x{k}" for k in range(n))) for n in range(1, 11)]
    rows = [(n, f"{_words(r, 250)} {t}; {_words(r, 150)}") for n, t in short]
    table = spark.createDataFrame(short, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert got == {(n, n) for n in range(1, 11)}


def test_decontamination_of_parts_and_equal_ids(spark, monkeypatch):
    """Parts of 1 kB give the rows and scores of one index; items that share an id are each found; brute force agrees on random items."""
    r = random.Random(31)
    items = [(k % 50, _words(r, r.randint(1, 90)), _words(r, r.randint(1, 12))) for k in range(60)]
    rows = [(k, f"{_words(r, r.randint(0, 300))} {q} {a}, {_words(r, r.randint(0, 200))}") for k, (_, q, a) in enumerate(items)] + [(100, None), (None, f"{items[3][1]} {items[3][2]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    whole = {(x.doc_id, x.item_id): round(x.score, 9) for x in decontaminate.contaminated(df, table).collect()}
    assert {(k, i) for k, (i, _, _) in enumerate(items)} <= set(whole) and (None, 3) in whole
    assert set(whole) == decontaminate.brute_force(rows, items)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1 << 10)
    assert len(list(decontaminate._parts(table))) > 5
    assert {(x.doc_id, x.item_id): round(x.score, 9) for x in decontaminate.contaminated(df, table).collect()} == whole
    assert [x.doc_id for x in decontaminate.without_leaks(df, table).collect()] == [100]
    assert decontaminate.without_leaks(df, table.limit(0)).count() == len(rows)


def test_decontamination_walk_equals_full_scores():
    r = random.Random(3)
    index = decontaminate.Index([(k, _words(r, 30), _words(r, 10)) for k in range(40)])
    terms = np.arange(len(index.terms))
    for _ in range(200):
        own = np.array(sorted(r.sample(terms.tolist(), 120)))
        full: dict[int, float] = {}
        for t in own.tolist():
            for u, w in index.postings[t]:
                full[u] = full.get(u, 0) + w
        for block in range(index.blocks):
            found = dict(index.walk(own, block, 0.12))
            assert found == pytest.approx({u: s for u, s in full.items() if u // decontaminate.BLOCK == block and s >= 0.12 - 1e-6})


def test_pii_base_spans(spark, docs, rows, empty):
    r = random.Random(3)
    parts = ["a", "b.", "@", "x@y.z", "1", "22", "255", "256", ".", "+", "-", " ", "(", "4111111111111111", "+1 (555) 555-1234", "é", "🙂", "\n", "%", "_", 'token = "', "34cf1be9225426587b06121cb35ab512e5a1beb5"]
    made = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(3000)]
    made += [(5000, None), (5001, "1 " * 30_000), (5002, "a.b@c.d_e@f.g " * 500), (5003, "x" * 100_000), (5003, "x@y.z")]
    got = pii.digest(pii.find(spark.createDataFrame(made, "doc_id long, text string").repartition(4))).collect()
    want = [(i, ",".join(":".join(map(str, s)) for s in pii.brute_force(t))) for i, t in made]
    assert sorted((x.doc_id, x.base_sha256) for x in got) == sorted((i, hashlib.sha256(w.encode()).hexdigest()) for i, w in want)
    assert all(any(i == x.doc_id and x.spans.startswith(w) for i, w in want) for x in got[:200])
    assert pii.find(docs).count() == len(rows) and pii.find(empty).count() == 0


def test_pii_further_spans_and_redaction(spark):
    text = 'é mail a.b@c.org or 10.0.0.1; token = "34cf1be9225426587b06121cb35ab512e5a1beb5" and thequickbrownfoxjumpsoverthelazydog'
    df = spark.createDataFrame([(1, text, "old"), (2, None, None)], "doc_id long, text string, pii string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in found[1].pii] == [("email", "a.b@c.org"), ("ip", "10.0.0.1"), ("secret", "34cf1be9225426587b06121cb35ab512e5a1beb5")]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == 'é mail [EMAIL] or [IP]; token = "[SECRET]" and thequickbrownfoxjumpsoverthelazydog' and clean[2] is None


def test_pii_features_agree(spark):
    """The expressions that score candidates see what the examples were described by, and the trees give the same scores."""
    text, after = 'the api key: "0123abcd0123abcd0123abcd', '" years'
    start = text.index("0123")
    span = F.struct(F.lit(text[start:]).alias("value"), F.lit(text[:start]).alias("before"), F.lit(after).alias("after"))
    forest = pii.model()[0]
    row = spark.range(1).select(pii._features("secret", span).alias("x")).select("x", pii._score(forest, F.col("x")).alias("s")).first()
    want = pii._feature_row("secret", text[:start], text[start:], after)
    assert row.x == pytest.approx(want) and 1 / (1 + np.exp(-row.s)) == pytest.approx(forest.scores(np.array([want]))[0])


def _added_spans(text):
    """The further spans, by Python's regular expressions, the forest itself and a look at all pairs."""
    import re

    forest, curves = pii.model()
    base = [(a, b) for _, a, b in pii.brute_force(text)]
    chosen = []
    for kind, pattern in pii.MORE.values():
        found = list(re.finditer(pattern, text))
        for n, m in enumerate(found):
            after = text[m.end() : found[n + 1].start() if n + 1 < len(found) else None]
            p = forest.scores(np.array([pii._feature_row(kind, text[: m.start()], m[0], after[: pii.AFTER])]))
            a, b, cut = curves[kind]
            if 1 / (1 + np.exp(-(a * pii._logit(p)[0] + b))) >= cut:
                chosen.append((m.start(), m.end(), kind))
    every = sorted({(a, -b, -1) for a, b in base} | {(a, -b, pii.MORE_KINDS.index(k)) for a, b, k in chosen})
    out = []
    for n, (a, b, k) in enumerate(every):
        if k >= 0 and not any(x <= a and -y >= -b for x, y, _ in every[:n]):
            out.append((k, a, -b))
    return [(pii.MORE_KINDS[k], a, b) for k, a, b in sorted(out)]


def test_pii_added_spans_equal_brute_force(spark):
    r = random.Random(33)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    parts = [
        lambda: _words(r, r.randint(1, 5)), lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: d(r.randint(1, 40)), lambda: f"token = \"{d(20)}abcdef{d(600)}\"",
        lambda: "api key: " + "".join(r.choice("ABCdef0123456789") for _ in range(32)), lambda: "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl", lambda: "joe (at) web dot org", lambda: "a@b.org", lambda: "10.1.2.3", lambda: "+1 (555) 555-1234",
        lambda: f"account {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(9)} km", lambda: "é🙂", lambda: "\n", lambda: "https://x.org/" + "/".join(_words(r, 1) for _ in range(6)),
    ]
    made = [(i, r.choice(["", " "]).join(r.choice(parts)() for _ in range(r.randint(0, 14)))) for i in range(800)]
    made.append((900, " ".join(f"{d(3)}-{d(3)}-{d(4)}" for _ in range(3000))))
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.pii if s.kind in pii.MORE_KINDS] for x in pii.find(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()}
    assert len(got[900]) == 3000 and sum(map(len, got.values())) > 3500
    for i, t in made[:-1]:
        assert got[i] == _added_spans(t), t


def test_pii_recall_from_texts(spark):
    """Numbers and keys in running text, of any length, next to each other too."""
    texts = {
        "call me: (555) 123-4567 or (555) 123-4568": 2, "my ssn is 123-45-6789, ok": 1, "card no. 1234 5678 9012 3456 expires": 1,
        'api_key = "' + "Zx81kQ0pLw" * 90 + "q7" + '"': 1, "the years 1990-1995 and 20 items cost 3.50": 0, "a path /usr/share/common/licences/of/many/words": 0, "----------------------------------------": 0,
    }
    df = spark.createDataFrame(list(texts.items()), "text string, want int")
    assert {r.text: len(r.pii) for r in pii.find(df).collect()} == texts
    # A run of numbers may be one span or several; nothing of it stays.
    row = "phones 555-123-4567 555-987-6543 555-222-3333"
    assert not any(c.isdigit() for c in pii.redact(spark.createDataFrame([(row,)], "text string")).first().text)


def test_pii_of_long_dense_texts(spark):
    """A megabyte of addresses: every one is found and redacted, in seconds, not minutes."""
    import time

    n = 50_000
    df = spark.createDataFrame([(1, "ab.cd@example.org 555-123-4567, " * (n // 2))], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.digest(pii.find(df)).first()
    assert row.n_email == n // 2 and row.spans.count("number") == n // 2
    assert pii.redact(df).first().text == "[EMAIL] [NUMBER], " * (n // 2)
    assert time.perf_counter() - began < 90


def test_pii_held_out_accuracy():
    """On examples that neither trees nor curves saw."""
    forest, curves = pii.model()
    x, y = pii.examples(3000, 99)
    a, b, cut = np.array([curves[k] for k in pii.MORE_KINDS])[x[:, 0].astype(int)].T
    p = 1 / (1 + np.exp(-(a * pii._logit(forest.scores(x)) + b)))
    said = p >= cut
    assert y[said].mean() > 0.95 and said[y == 1].mean() > 0.9
    assert abs(p.mean() - y.mean()) < 0.03


def test_licenses(spark, docs, empty):
    r = random.Random(5)
    long_one = {"long": _words(r, 300)}
    templates = licenses.default_templates() | long_one | {"short": "just three words", "none": "", "null": None}
    cut = long_one["long"].split()
    rows = _texts() + [(1000 + k, f"{_words(r, 30)}\n{t} {_words(r, 30)}") for k, t in enumerate(licenses.default_templates().values())]
    rows += [(2000, "RELEASED under the MIT license"), (2001, f"{_words(r, 99)} {' '.join(cut)}"), (2002, " ".join(cut[:150] + ["new"] + cut[150:])), (2003, " ".join(cut[:100])), (2004, "just three words"), (2005, "MIT " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.license) for x in licenses.scan(df, templates).collect()}
    assert got == licenses.brute_force(rows, templates)
    assert {(2000, "MIT"), (2001, "long"), (2002, "long"), (2004, "short")} <= got and (2003, "long") not in got
    assert {(1000 + k, name) for k, name in enumerate(licenses.default_templates())} <= got
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_licenses_in_texts_full_of_notices():
    import time

    scanner = licenses.Scanner(sorted(licenses.default_templates().items()))
    scanner.scan(pa.array(["Released under the MIT License."]))
    many = pa.array(["Released under the MIT License. " * 200])
    began = time.perf_counter()
    found = scanner.scan(many)
    assert time.perf_counter() - began < 0.5 and [(x[1], x[5]) for x in found] == [("MIT", 200)]


def test_quality(spark, empty):
    r = random.Random(7)
    good = [(i, _words(r, r.randint(20, 90)).capitalize() + ".") for i in range(300)]
    bad = [(300 + i, " ".join(w + r.choice(["###", "$$$", "!!"]) for w in _words(r, 40).split()).upper()) for i in range(100)]
    rows = good + bad + [(900, None), (901, ""), (902, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 0.1) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(400)] + [(10**6, 1), (3, None)], "doc_id long, quality int")
    forest = quality.train(df, labels)
    got = {x.doc_id: x for x in quality.score(df, forest).collect()}
    held = [x.doc_id for x in df.filter(quality.held_out()).select("doc_id").collect() if x.doc_id < 400]
    assert sum(got[i].predicted == (1 if i < 300 else 0) for i in held) >= 0.98 * len(held)
    assert got[900].score == got[901].score and all(0 <= x.score <= 1 for x in got.values())
    assert quality.score(empty, forest).count() == 0
    none = quality.score(df, quality.train(df, labels.limit(0))).select("score").distinct().collect()
    assert [x.score for x in none] == [0.5]


def test_quality_statistics_equal_brute_force():
    """Each statistic from strings, over odd texts and invented ones."""
    import math
    import string
    from collections import Counter

    def own(text):
        if not text:
            return [0.0] * len(quality.FEATURES)
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        lines = text.split("\n")
        n, k = max(1, len(text)), max(1, len(words))
        share = lambda chars: sum(c in chars for c in text) / n
        symbols = set(string.punctuation) - set(".,;:'\"()?-")
        size = lambda w: len(w.encode())
        upper, lower = set(string.ascii_uppercase), set(string.ascii_lowercase)
        # A break at the end begins no further line here.
        kept = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        made = {
            "characters": math.log1p(len(text)), "words": math.log1p(len(words)), "lines": math.log1p(text.count("\n") + 1), "upper": share(upper), "digits": share(string.digits),
            "punctuation": share(string.punctuation), "other_symbols": share(symbols), "word_mean": sum(map(size, words)) / k, "word_longest": math.log1p(max(map(size, words), default=0)),
            "distinct_words": len(set(words)) / k, "top_word": max(Counter(words).values(), default=0) / k, "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
            "symbol_ends": sum(w[-1] in symbols for w in words) / k, "symbol_words": sum(set(w) <= set(string.punctuation) for w in words) / k,
            "upper_words": sum(bool(set(w) & upper) and not set(w) & lower for w in words) / k, "digit_words": sum(bool(set(w) & set(string.digits)) for w in words) / k,
            "line_mean": math.log1p(len(text) / (text.count("\n") + 1)), "short_words": sum(size(w) <= 3 for w in words) / k, "repeated_lines": 1 - len(set(kept)) / max(1, len(kept)),
            "non_ascii": sum(size(c) for c in text if ord(c) > 127) / size(text), **{name: share(c) for name, c in (("bang", "!"), ("pipe", "|"), ("hash", "#"), ("star", "*"), ("dollar", "$"), ("percent", "%"), ("ampersand", "&"))},
        }
        return [made[f] for f in quality.FEATURES]

    r = random.Random(41)
    texts = [t for _, t in _texts()] + ["".join(r.choice(["A", "b", "é", " ", "\n", "#", "!", ".", "7", "ab ab ", "X9 ", "x\n"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    got = quality.statistics(*bpe.text_buffers(pa.array(texts, pa.string())))
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(own(t)), t


def test_quality_forest_walk_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    forest = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=7)

    def value(node, row):
        f = forest.feature[node]
        return forest.value[node] if f < 0 else value(forest.left[node] + (row[f] > forest.threshold[node]), row)

    want = [1 / (1 + np.exp(-(forest.base + sum(value(t, row) for t in forest.roots)))) for row in x]
    assert np.allclose(forest.scores(x), want)


PAGE = '<html lang="EN"><head><title>A &amp; B</title><script>var a="<p>no</p>";</script></head><body><!-- <a href="/x"> --><p>One <b>two</b></p><div>a&lt;b <a class="q>r" href=\'/l?x=1&amp;y=2\'>link</a><br>end</body></html>'


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h.org/d/", PAGE, "x"), (2, None, None, None), (3, "http://h.org/", "<p>" + "w " * 50_000, None), (3, "http://h.org/", "<p>" + "w " * 50_000, None)], "page_id long, url string, html string, block string")
    answers = warc.responses(pages)
    made = warc.derive(answers)
    rows = made.collect()
    assert len(rows) == 8 and made.filter("page_id = 3").select("record_id").distinct().count() == 2
    source = {r.page_id: r for r in answers.collect()}
    for r in rows:
        assert r.refers_to == source[r.page_id].record_id and r.payload_digest == source[r.page_id].payload_digest and r.http_headers == source[r.page_id].http_headers
        assert r.content_length == len(r.block) and r.block_digest == warc.digest(r.block)
    by = {(r.page_id, r.record_type): r.block.decode() for r in rows}
    assert by[1, "conversion"] == "One two\na<b link\nend"
    assert "outlink: http://h.org/l?x=1&y=2 L a/@href" in by[1, "metadata"] and "/x L" not in by[1, "metadata"] and "title: A & B" in by[1, "metadata"] and "language: en" in by[1, "metadata"]
    assert by[2, "conversion"] == ""
    warc.write(answers.union(made), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert back.count() == 12
    assert sorted((r.record_id, bytes(r.block)) for r in warc.derive(back).collect()) == sorted((r.record_id, bytes(r.block)) for r in rows)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_scan_equals_the_standard_parser():
    """Random pages against text, title and links that the standard library's parser finds."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.links, self.title, self.silent = [], [], None, []

        def handle_starttag(self, tag, attrs):
            self.out.append("\0" if tag in warc.BLOCKS and not self.silent else "")
            if tag == "a" and "href" in dict(attrs) and not set(self.silent) & warc.RAW:
                self.links.append(dict(attrs)["href"].strip())
            if tag in warc.SILENT | {"title"}:
                self.silent += [tag] if tag != "title" else []
                self.in_title = tag == "title"

        def handle_endtag(self, tag):
            self.out.append("\0" if tag in warc.BLOCKS and not self.silent else "")
            self.in_title = False
            if tag in self.silent:
                self.silent.remove(tag)

        def add(self, text):
            if getattr(self, "in_title", False):
                self.title = (self.title or "") + text
            if not self.silent:
                self.out.append(text)

        handle_data = add

        def handle_entityref(self, name):
            self.add(f"&{name};")

        def handle_charref(self, name):
            self.add(f"&#{name};")

    import html

    r = random.Random(16)
    for _ in range(300):
        page = "<html lang=en><head><title>T &amp; x</title><script>var a = '<p>no</p>'</script></head><body>"
        for _ in range(r.randint(0, 40)):
            page += r.choice(["<p>", "</p>", "<b>", "</b>", "<br/>", "word ", "&lt;x ", "1 < 2 ", "<a href='/u?a=1&amp;b=2' class=x>l</a>", '<A title="a>b" HREF="v">', "</a>", "<!-- <a href=q> -->", "<div class='q'>", "</div>", "<svg><a href='s'>t</a></svg>", "<style>p > a {}</style>", "é 🙂 ", "\n"])
        parser = Plain()
        parser.feed(page + "</body></html>")
        parser.close()
        lines = (" ".join(html.unescape(x).split()) for x in "".join(parser.out).split("\0"))
        title, language, links, text = warc.scan(page + "</body></html>")
        assert (title, language, links, text) == ("T & x", "en", parser.links, "\n".join(x for x in lines if x))


def test_warc_scan_of_broken_pages_is_linear():
    import time

    for unit in ("<a ", '<a "', "<a '\"", "<svg>", "<svg></head>", "<!-- ", "<title>", "<script", "</script   ", "<a href=x ", "&", "<" * 3):
        began = time.perf_counter()
        warc.scan(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 3, unit
    assert warc.scan("a <b c") [3] == "a <b c" and warc.scan('x <a title="y <b>z</b>')[3] == 'x <a title="y z'


def test_warc_bodies_and_files(spark, tmp_path):
    """Character sets and codings; bytes survive reading and writing; members; blocks that hold the mark of a record; broken records."""
    import gzip

    page = "<p>caf\u00e9 \u20ac"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html"
    plain = page.encode("cp1252")
    packed = gzip.compress(page.encode())
    bodies = [head + b"; charset=ISO-8859-1\r\n\r\n" + plain, head + b"\r\n\r\n<meta charset='windows-1252'>" + plain, head + b"\r\n\r\n" + "\ufeff".encode() + page.encode(), head + b"\r\n\r\n" + page.encode("utf-16"), head + b"; charset=none\r\n\r\n" + page.encode()]
    bodies += [head + b"\r\nContent-Encoding: gzip\r\n\r\n" + packed, head + b"\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n" + page.encode()[:4] + b"\r\n" + f"{len(page.encode()) - 4:x}\r\n".encode() + page.encode()[4:] + b"\r\n0\r\n\r\n"]
    assert {warc.scan(warc.body_text(b)[1])[3] for b in bodies} == {"caf\u00e9 \u20ac"}
    assert warc.body_text(b"")[1] == "" and warc.body_text(head + b"\r\n\r\n\xff")[1] == "\ufffd"
    blocks = [*bodies, b"x\r\n\r\nWARC/1.0\r\nWARC-Type: no\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"", bytes(range(256)) * 70_000]
    rows = [(None, "response", f"<{k}>", None, None, None, f"http://h/{k}", "2024-01-01T00:00:00Z", "application/http", len(b), warc.digest(b), None, None, b) for k, b in enumerate(blocks)]
    warc.write(spark.createDataFrame(rows, warc.RECORD).coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*.warc.gz"))
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") == len(blocks) and file.read_bytes().count(b"\x1f\x8b\x08") >= len(blocks)
    assert {r.record_id: bytes(r.block) for r in warc.read(spark, str(tmp_path / "w")).collect()} == {f"<{k}>": b for k, b in enumerate(blocks)}
    (tmp_path / "raw").mkdir()
    record = lambda k, n, b: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {n}\r\n\r\n".encode() + b + b"\r\n\r\n"
    (tmp_path / "raw/a.warc").write_bytes(record(1, 2, b"\xe9\xff") + b"WARC/1.0\r\nnonsense\r\n\r\n\r\n\r\n" + record(2, 1, b"z") + record(3, 99, b"cut"))
    assert {(r.record_id, bytes(r.block)) for r in warc.read(spark, str(tmp_path / "raw")).collect()} == {("<1>", b"\xe9\xff"), ("<2>", b"z")}


def test_pipeline_stages_take_effect(spark, tmp_path):
    """Each stage on odd rows, then the whole: brute force tells which documents stay."""
    r = random.Random(2)
    good = [(i, f"{_words(r, r.randint(30, 90))}, {_words(r, 9)}{r.choice(['.', '. A-b.', ': ', ' (x) '])}".capitalize()) for i in range(60)]
    item = _words(r, 40)
    rows = good + [(60, good[5][1]), (61, f"{_words(r, 50)}, {item}.".capitalize()), (62, f"{_words(r, 50)}, mail a@b.org.".capitalize()), (63, " ".join(w + "###" for w in _words(r, 60).split())), (64, None), (65, "")]
    rows += [(70 + i, " ".join(w + "$$$" for w in _words(r, 60).split())) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in [*range(60), *range(70, 100)]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    stay = set(range(60)) | {62}
    assert stay <= set(got) and not {60, 61, 63, *range(70, 100)} & set(got)
    own = bpe.codec(bpe.default_path())
    for x in got.values():
        assert x.n_chars == len(x.text or "") and own.decode(np.array(x.ids, np.int64)).tobytes().decode() == (x.text or "")
    assert "[EMAIL]" in got[62].text
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows without an id, repeated rows, ids with several texts, null texts and further columns, stage by stage."""
    r = random.Random(5)
    item = _words(r, 40)
    leak, plain = f"{_words(r, 50)} {item}", _words(r, 60)
    rows = [(None, leak), (None, plain), (None, plain), (1, leak), (1, _words(r, 70)), (2, plain), (2, plain), (3, plain), (4, None), (5, ""), (6, "mail a@b.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA + ", ids string, score int, pii int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {name: sorted((x.doc_id or 0, x.text or "") for x in stage(spark, docs, str(tmp_path)).collect()) for name, stage in corpus_pipeline.STAGES}
    every = sorted((i or 0, t or "") for i, t in rows)
    assert got["quality classifier"] == every and got["byte-level BPE"] == every
    assert got["benchmark decontamination"] == sorted((i, t) for i, t in every if t != leak)
    assert got["MinHash near-dedup"] == sorted((i, t) for i, t in every if i not in (3, 5))
    assert got["PII"] == sorted((i, t.replace("a@b.org", "[EMAIL]")) for i, t in every)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS), name
