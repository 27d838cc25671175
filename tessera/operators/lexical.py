"""Lexical search over chunks: stemmed web-style queries, titles that weigh more, cover-density rank, optional filters.

A chunk's words are its document's title followed by its content. The JVM finds the words that may have one of the
query's stems (a stem shares its beginning with its words) with their places; only these go to Python, where the stems
decide. Rows without such words never leave the scan. Statistics of the corpus play no part in the rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.english import lexeme
from tessera.functions.queries import relaxed_terms
from tessera.operators.merging import page, where, within

WORD = r"[\p{L}\p{N}]+"
# Weights of title and content words.
TITLE, CONTENT = 1.0, 0.4
#: A query of more words than this that finds nothing is relaxed to any of its words.
RELAXED_FROM = 2
Phrase = tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class LexicalQuery:
    """Every group needs one of its phrases; none of ``excluded`` may occur. A phrase is stems with their distances from its beginning."""

    groups: tuple[tuple[Phrase, ...], ...]
    excluded: tuple[Phrase, ...]

    @property
    def stems(self) -> list[str]:
        return sorted({s for g in (*self.groups, self.excluded) for phrase in g for _, s in phrase})

    @property
    def sought(self) -> frozenset[str]:
        return frozenset(s for g in self.groups for phrase in g for _, s in phrase)


def _phrase(text: str) -> Phrase:
    found = [(k, lexeme(w)) for k, w in enumerate(re.findall(r"[^\W_]+", text))]
    kept = [(k, s) for k, s in found if s]
    return tuple((k - kept[0][0], s) for k, s in kept)


def web_query(text: str) -> LexicalQuery:
    """Words are joined by AND, "or" joins neighbours, quotes make phrases, a leading - excludes; stop words count only for distances."""
    groups: list[list[Phrase]] = []
    excluded: list[Phrase] = []
    joined = False
    for minus, quoted, word in re.findall(r"(-?)(?:\"([^\"]*)\"|([^\s\"]+))", text):
        if not quoted and word.lower() == "or" and not minus:
            joined = bool(groups)
            continue
        phrase = _phrase(quoted or word)
        if not phrase:
            continue
        if minus:
            excluded.append(phrase)
        elif joined:
            groups[-1].append(phrase)
        else:
            groups.append([phrase])
        joined = False
    return LexicalQuery(tuple(map(tuple, groups)), tuple(excluded))


def any_query(terms: list[str]) -> LexicalQuery:
    """Any of the terms."""
    phrases = tuple(dict.fromkeys(p for t in terms if (p := _phrase(t))))
    return LexicalQuery((phrases,) if phrases else (), ())


def prefix_of(stem: str) -> str:
    """What all words of a stem begin with: endings change the last two letters of a stem at most."""
    return stem[: max(1, len(stem) - 2)] if len(stem) > 2 else stem


def _ends(places: dict[str, set[int]], phrase: Phrase) -> bool:
    first = phrase[0][1]
    return any(all(at + d in places.get(s, ()) for d, s in phrase[1:]) for at in places.get(first, ()))


def matches(places: dict[str, set[int]], query: LexicalQuery) -> bool:
    return bool(query.groups) and all(any(_ends(places, p) for p in g) for g in query.groups) and not any(_ends(places, p) for p in query.excluded)


def cover_density(entries: list[tuple[int, str, float]], query: LexicalQuery) -> float:
    """The sum over minimal covers (spans that satisfy the query) of the harmonic mean of their weights over 1 + their other words.

    ``entries``: place, stem, weight of the sought words, in order of place.
    """
    if len(query.groups) == 1 and all(len(p) == 1 for p in query.groups[0]):
        return sum(w for _, _, w in entries)  # each entry is a cover by itself

    def satisfied(part: list[tuple[int, str, float]]) -> bool:
        places: dict[str, set[int]] = {}
        for at, s, _ in part:
            places.setdefault(s, set()).add(at)
        return all(any(_ends(places, p) for p in g) for g in query.groups)

    single = all(len(p) == 1 for g in query.groups for p in g)
    of_stem: dict[str, list[int]] = {}
    for n, g in enumerate(query.groups):
        for p in g:
            of_stem.setdefault(p[0][1], []).append(n)
    total, begin = 0.0, 0
    while begin < len(entries):
        end, low = begin, None
        last: dict[int, int] = {}  # of each group its latest entry
        while end < len(entries) and low is None:
            if single:
                last |= dict.fromkeys(of_stem[entries[end][1]], end)
                low = min(last.values()) if len(last) == len(query.groups) else None
            elif satisfied(entries[begin : end + 1]):
                low = max(k for k in range(begin, end + 1) if satisfied(entries[k : end + 1]))
            end += 1
        if low is None:
            break
        cover = entries[low:end]
        noise = max(cover[-1][0] - cover[0][0] - (len(cover) - 1), 0)
        total += len(cover) / sum(1 / w for _, _, w in cover) / (1 + noise)
        begin = low + 1
    return total


def filtered(chunks: DataFrame, docs: DataFrame, workspace: str | None = None, tags: list[str] | None = None, collection: str | None = None, chunk_type: str | None = None,
             updated: tuple = (None, None), created: tuple = (None, None)) -> DataFrame:
    """id, document_id, content, title of the chunks that pass the filters given; each filter is planned on its table's scan."""
    rows = within(within(where(docs, workspace_hash=workspace, collection=collection), "updated_at", *updated), "created_at", *created)
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    own = where(chunks, workspace_hash=workspace, chunk_type=chunk_type).select("id", "document_id", "content")
    return own.join(rows.select(F.col("id").alias("document_id"), "title"), "document_id")


def search(rows: DataFrame, query: LexicalQuery, limit: int | None = None) -> DataFrame:
    """id, score of the rows (id, title, content) that match, best first."""
    stems = query.stems
    beginnings = sorted({prefix_of(s) for s in stems})
    # A word that begins with one of a group's beginnings is needed for every group.
    needed = [sorted({prefix_of(p[0][1]) for p in g}) for g in query.groups]
    begins = lambda these: "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, these)) + ")"
    text = F.concat_ws("\n", "title", "content")
    kept = rows
    for these in needed or [["\x00"]]:
        kept = kept.filter(F.rlike(text, F.lit(begins(these))))
    words = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    # A generator keeps the arrays from being made again for each use.
    made = kept.select("id", F.explode(F.array(F.struct(words("title").alias("t"), words("content").alias("c")))).alias("w"))
    hit = F.lit("^(?:" + "|".join(map(re.escape, beginnings)) + ")")
    spots = lambda c, base: F.filter(F.transform(c, lambda w, i: F.struct((i + base).alias("at"), w.alias("word"))), lambda p: F.rlike(p["word"], hit))
    at = F.concat(spots(F.col("w.t"), F.lit(0)), spots(F.col("w.c"), F.size("w.t")))
    found = made.select("id", F.size("w.t").alias("n"), at.alias("p")).select("id", "n", F.col("p.at").alias("at"), F.col("p.word").alias("word"))
    sought, every = query.sought, frozenset(stems)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for k, (n, ats, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                entries = [(a, s, TITLE if a < n else CONTENT) for a, w in zip(ats, own, strict=True) if (s := lexeme(w)) in every]
                places: dict[str, set[int]] = {}
                for a, s, _ in entries:
                    places.setdefault(s, set()).add(a)
                if matches(places, query):
                    ids.append(k)
                    scores.append(cover_density([e for e in entries if e[1] in sought], query))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return page(found.mapInArrow(step, f"id {kind}, score double"), [F.desc("score"), "id"], limit)


def relaxed(rows: DataFrame, text: str, limit: int) -> tuple[DataFrame, bool]:
    """(the best rows for a query, whether it was relaxed): a query of more than RELAXED_FROM words that finds nothing asks for any of its words."""
    best = search(rows, web_query(text), limit)
    if len(text.split()) <= RELAXED_FROM:
        return best, False
    found = best.collect()  # ``limit`` rows at most
    if found:
        return rows.sparkSession.createDataFrame(found, best.schema), False
    return search(rows, any_query(relaxed_terms(text)), limit), True
