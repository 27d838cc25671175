"""Text steps of ingest: chunks, entities, links, tickets, tags, memories, sessions. JVM-side except the chunker and strip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns that tell what a text is about, in the order of their tags.
TAG_PATTERNS = {
    "bug-fix": r"\b(?:fix|bug|patch|resolve|hotfix|regression|broken|crash)\b",
    "feature": r"\b(?:feat|feature|implement|add|create|new|introduce)\b",
    "refactor": r"\b(?:refactor|restructure|reorganize|clean.?up|simplif\w*)\b",
    "docs": r"\b(?:docs?|documentation|readme|comment)\b",
    "chore": r"\b(?:chore|bump|upgrade|dependency|ci|cd|config|infra)\b",
}
# Shapes of ticket names, and prefixes of that shape which name encodings, hashes and protocols.
TICKET_PATTERNS = (r"\b[A-Z][A-Z0-9]+-\d+\b", r"#\d+")
NO_TICKETS = ("UTF", "UTF8", "UTF16", "SHA", "MD5", "ISO", "RFC", "TLS", "SSL", "HTTP", "HTTPS", "CVE", "BASE64", "IPV4", "IPV6", "X86", "ARM64")
LINK = r"(?<!\\)\[\[([^\[\]\n]{1,200})\]\]"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Tags that say where a document comes from, not what it is about.
FORM_TAGS = ("opencode", "session", "claude", "summary")
BOTS = ("[bot]", "dependabot", "renovate", "github-actions")


def ascii_words(pattern: str) -> str:
    r"""The pattern with a leading \b and a trailing \b at ASCII words only; Java's own \b also counts other letters.

    Both stand next to word characters, so each is one look to a side.
    """
    return re.sub(r"\\b$", "(?![A-Za-z0-9_])", re.sub(r"^\\b", "(?<![A-Za-z0-9_])", pattern))


def semantic_tags(title: Column, content: Column) -> Column:
    low = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    return F.array_compact(F.array(*(F.when(F.rlike(low, F.lit(ascii_words(p))), F.lit(tag)) for tag, p in TAG_PATTERNS.items())))


def tickets(content: Column) -> Column:
    """Sorted distinct ticket names, upper case; well-known names of other things are left out."""
    found = F.concat(*(F.regexp_extract_all(content, F.lit(ascii_words(p)), F.lit(0)) for p in TICKET_PATTERNS))
    upper = F.transform(found, F.upper)
    return F.array_sort(F.array_distinct(F.filter(upper, lambda t: ~F.split_part(t, F.lit("-"), F.lit(1)).isin(*NO_TICKETS) | ~F.contains(t, F.lit("-")))))


def ticket_tags(content: Column, inherited: Column | None = None) -> Column:
    own = F.transform(tickets(content), lambda t: F.concat(F.lit("ticket:"), t))
    return own if inherited is None else F.array_sort(F.array_union(own, F.filter(F.coalesce(inherited, F.array().cast("array<string>")), lambda t: t.startswith("ticket:"))))


def retagged(docs: DataFrame, collection: str = "sessions") -> DataFrame:
    """The documents, those of a collection that have no ticket tag yet with the tags of the tickets in their contents."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    due = (F.col("collection") == collection) & ~F.exists(tags, lambda t: t.startswith("ticket:"))
    own = ticket_tags(F.coalesce("content", F.lit("")))
    return docs.withColumn("tags", F.when(due & (F.size(own) > 0), F.array_union(tags, own)).otherwise(F.col("tags")))


def categorised(docs: DataFrame, suggest: Callable[[DataFrame], DataFrame], confidence: float = 0.6) -> DataFrame:
    """The documents with the tags that a model suggests for those which have only tags of form.

    ``suggest`` turns documents into rows (id, tags, confidence); suggestions below ``confidence`` and tags of form are
    left out. Documents without a suggestion stay as they are.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    plain = docs.filter(~F.exists(tags, lambda t: ~t.isin(*FORM_TAGS)))
    made = suggest(plain).filter(F.col("confidence") >= confidence).groupBy("id").agg(F.flatten(F.collect_list("tags")).alias("__new"))
    new = F.filter("__new", lambda t: t.isNotNull() & ~t.isin(*FORM_TAGS))
    return docs.join(made, "id", "left").withColumn("tags", F.when(F.size(new) > 0, F.array_sort(F.array_union(tags, new))).otherwise(F.col("tags"))).select(*docs.columns)


def entities(content: Column, least: int = 3, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case identifiers and the parts of camelCase ones, of ``least`` characters at least."""
    whole = F.filter(F.regexp_extract_all(content, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.rlike(t, F.lit(r"\p{L}")))
    parts = F.flatten(F.transform(whole, lambda t: F.when(F.rlike(t, F.lit(r".\p{Lu}")), F.split(t, r"(?<=.)(?=\p{Lu})")).otherwise(F.array().cast("array<string>"))))
    low = F.transform(F.concat(whole, parts), F.lower)
    return F.array_distinct(F.filter(low, lambda t: (F.length(t) >= least) & ~t.isin(*stop_words, "")))


def entity_kind(token: Column) -> Column:
    """By the first character: a type if it is upper case, else a function."""
    return F.when(F.rlike(token, F.lit(r"^\p{Lu}")), "type").otherwise("function")


def wikilinks(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` by link: target, position in the list of its row, whether it is an id."""
    links = df.select("*", F.posexplode(F.regexp_extract_all(content, F.lit(LINK), F.lit(1))).alias("place", "target"))
    return links.withColumn("target", F.trim("target")).withColumn("is_id", F.rlike("target", F.lit(UUID)))


#: Candidates of a link that are named; their number is exact.
NAMED = 20


def resolve_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Each link with the least id of a document that has its target as id or, whatever the case, as title; how many do, and the first NAMED of them."""
    titles = docs.select(F.lower("title").alias("__key"), "id").union(docs.select(F.col("id").cast("string"), "id")).distinct()
    place = F.row_number().over(Window.partitionBy("__key").orderBy("id"))
    first = titles.withColumn("__r", place).filter(F.col("__r") <= NAMED).groupBy("__key").agg(F.min("id").alias("target_id"), F.sort_array(F.collect_list("id")).alias("candidates"))
    named = first.join(titles.groupBy("__key").agg(F.count("*").alias("matches")), "__key")
    return links.join(named, F.lower("target") == F.col("__key"), "left").drop("__key")


def memories(df: DataFrame, content: str = "content") -> DataFrame:
    """id, kind, memory, title, memory_id: decisions and lessons, from lines and then from sections under such headings."""
    text = F.coalesce(F.col(content), F.lit(""))
    found = []
    for order, (kind, line, head) in enumerate((("decision", "DECISION|Decision", "decisions?"), ("lesson", "LESSON|Lesson", r"lessons?\s*(?:learned)?"))):
        lines = F.regexp_extract_all(text, F.lit(rf"(?im)^(?:{line}):\s*(.+)"), F.lit(1))
        sections = F.regexp_extract_all(text, F.lit(rf"(?im)^#{{1,3}}[ \t]*(?:key[ \t]+)?{head}[ \t]*$\n((?:(?!^#{{1,3}} ).*\n?)*)"), F.lit(1))
        found.append((order, kind, lines))
        found.append((order + 2, kind, sections))
    rows = F.flatten(F.array(*(F.transform(values, _memory(kind, order)) for order, kind, values in found)))
    made = df.select("id", F.explode(rows).alias("m")).select("id", "m.*").withColumn("memory", F.regexp_replace("memory", r"^\s+|\s+$", "")).filter("memory <> ''")
    first = made.groupBy("id", "kind", "memory").agg(F.min("order").alias("order"))
    head = F.split_part("memory", F.lit("\n"), F.lit(1))
    title = F.when(F.length(head) > 80, F.concat(F.left(head, F.lit(77)), F.lit("..."))).otherwise(head)
    return first.select("id", "kind", "memory", title.alias("title"), F.left(F.sha2(F.concat_ws(":", "kind", "memory"), 256), F.lit(16)).alias("memory_id"))


def _memory(kind: str, order: int):
    return lambda v: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), v.alias("memory"))


def sessions(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turns, markdown: each conversation as headed messages in their order; rows without text or role have defaults."""
    part = F.concat(F.lit("## "), F.coalesce(role, F.lit("unknown")), F.lit("\n\n"), F.coalesce(text, F.lit("")))
    rows = messages.select(key, F.struct(F.col(turn).alias("turn"), part.alias("part")).alias("m"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return grouped.select(key, F.size("ms").cast("long").alias("turns"), F.array_join(F.transform("ms", lambda m: m["part"]), "\n\n").alias("markdown"))


def strip_session(text: Column) -> Column:
    """Long base64 runs, fenced blocks of more than 20 lines and system sections become short placeholders or go."""
    out = F.regexp_replace(text, r"[A-Za-z0-9+/]{100,}={0,2}", "[base64 data]")
    out = F.regexp_replace(out, r"(?m)^```[^\n]*\n(?:(?!```)[^\n]*\n){21,}+```[ \t]*$", "[code block]")
    out = F.regexp_replace(out, r"(?m)^# system\b[^\n]*\n(?:(?!# )[^\n]*\n?)*+", "")
    return F.regexp_replace(out, r"(?m)^([^\n]*\b[Ee]rror\b[^\n]*)(?:\n\1$)+", "$1 (repeated)")


# How good a place is to break before a line, and the sizes of chunks in bytes.
BREAKS = ((r"# ", 100), (r"## ", 90), (r"### ", 80), (r"#{4,6} ", 70), (r"(?:---+|\*\*\*+|___+)\s*$", 60), (r"\s*$", 50), (r"\s*(?:[-*+]|\d+\.)\s", 40))
TARGET, REACH, OVERLAP, LEAST = 2600, 400, 600, 200


def split_text(text: str, target: int = TARGET, reach: int = REACH, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """(index, first line, last line, chunk) of about ``target`` bytes, cut before the best line within ``reach`` of it.

    No cut lies in a code fence if there is another place; a chunk begins at a line up to ``overlap`` bytes before the
    cut; a line that is longer than a chunk is cut at blanks or characters; a short rest joins the last chunk.
    """
    lines = text.splitlines(keepends=True)
    if not text.strip():
        return []
    pieces: list[tuple[int, bytes, int, bool]] = []  # line number, bytes, score of a cut before it, in a fence
    fenced = False
    for number, line in enumerate(lines, 1):
        mark = bool(re.match(r"\s*(?:```|~~~)", line))
        score = next((s for p, s in BREAKS if re.match(p, line)), 10)
        raw = line.encode()
        inside = fenced
        fenced ^= mark
        while len(raw) > target + reach:
            cut = max(raw.rfind(b" ", target * 3 // 4, target) + 1, 0) or target
            while cut > 1 and (raw[cut] & 0xC0) == 0x80:
                cut -= 1
            pieces.append((number, raw[:cut], score, inside))
            raw, score = raw[cut:], 10
        pieces.append((number, raw, score, inside))
    ends = [0]
    for p in pieces:
        ends.append(ends[-1] + len(p[1]))
    chunks, first = [], 0
    while first < len(pieces):
        goal = ends[first] + target
        if ends[-1] - ends[first] <= target + least:
            last = len(pieces)
        else:
            near = [k for k in range(first + 1, len(pieces)) if goal - reach <= ends[k] <= goal + reach]
            open_ = [k for k in near if not pieces[k][3]]
            within = [k for k in range(first + 1, len(pieces)) if ends[k] <= goal + reach]
            last = max(open_ or near, key=lambda k: (pieces[k][2], -k), default=within[-1] if within else first + 1)
        chunks.append((first, last))
        if last == len(pieces):
            break
        back = last
        while back - 1 > first and ends[last] - ends[back - 1] <= overlap:
            back -= 1
        first = max(back, first + 1)
    return [(i, pieces[a][0], pieces[b - 1][0], b"".join(p[1] for p in pieces[a:b]).decode()) for i, (a, b) in enumerate(chunks)]


def chunk(df: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """id, chunk_index, start_line, end_line, chunk, chunk_hash of every text, in Arrow batches."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, a, b, c, hashlib.sha256(c.encode()).hexdigest()) for i, t in zip(batch["id"], batch["content"], strict=True) for k, a, b, c in split_text(t or "")]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start_line", "end_line", "chunk", "chunk_hash"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(content).alias("content")).mapInPandas(step, "id long, chunk_index long, start_line long, end_line long, chunk string, chunk_hash string")


# Endings of files that are cut by headings, and of those that are cut by declarations.
HEADED = (".md", ".markdown", ".mdx", ".rst")
DECLARED = (".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".rb", ".vue")
#: Bytes of a declaration from which on it is cut further.
LONG_SYMBOL = 8192


def symbol_pieces(path: str, content: str, starts: list[tuple[int, str]]) -> list[tuple[int, int, int, str, str]]:
    """(index, first line, last line, chunk, name): a chunk for each declaration, from its line up to the next one; what comes before the first has no name."""
    rows = content.splitlines(keepends=True)
    marks = [(1, "")] + sorted(starts) if not starts or min(starts)[0] > 1 else sorted(starts)
    out: list[tuple[int, int, int, str, str]] = []
    for (line, name), (after, _) in zip(marks, [*marks[1:], (len(rows) + 1, "")], strict=True):
        text = "".join(rows[line - 1 : after - 1])
        if not text.strip():
            continue
        parts = split_text(text) if len(text.encode()) > LONG_SYMBOL else [(0, 1, max(1, after - line), text)]
        out += [(len(out) + k, line + a - 1, line + b - 1, c, name) for k, (_, a, b, c) in enumerate(parts)]
    return out


def chunk_files(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """path, chunk_index, start_line, end_line, chunk, chunk_hash, chunk_type, symbol_name of source files (path, content).

    Code is cut before its declarations (``declarations``: path, symbol, line), other files where headings and blank
    lines are; code without declarations like other files. Declarations come to their file's row.
    """
    named = declarations.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "symbol"))).alias("starts"))  # of one file

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, starts in zip(batch["path"], batch["content"], batch["starts"], strict=True):
                marks = [(s["line"], s["symbol"]) for s in starts] if starts is not None else []
                if path.endswith(DECLARED) and marks:
                    rows += [(path, i, a, b, c, hashlib.sha256(c.encode()).hexdigest(), "symbol" if n else "raw", n or None) for i, a, b, c, n in symbol_pieces(path, content or "", marks)]
                else:
                    rows += [(path, i, a, b, c, hashlib.sha256(c.encode()).hexdigest(), "raw", None) for i, a, b, c in split_text(content or "")]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "start_line", "end_line", "chunk", "chunk_hash", "chunk_type", "symbol_name"])

    return files.select("path", "content").join(named, "path", "left").mapInPandas(step, "path string, chunk_index long, start_line long, end_line long, chunk string, chunk_hash string, chunk_type string, symbol_name string")


def embed_text(content: Column, most: int = 3000) -> Column:
    """The first ``most`` bytes, without a character that the cut splits."""
    raw = F.encode(content, "UTF-8")
    splits = F.hex(F.substring(raw, most + 1, 1)).between("80", "BF")
    cut = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    return F.when(F.octet_length(content) <= most, content).when(splits, F.regexp_replace(cut, "\ufffd+$", "")).otherwise(cut)


def is_bot(author: Column, email: Column) -> Column:
    both = F.lower(F.concat_ws(" ", author, email))
    hit = F.lit(False)
    for b in BOTS:
        hit = hit | F.contains(both, F.lit(b))
    return hit


def minified(path: Column, content: Column) -> Column:
    """Files by name, with a line of over 2000 characters, or of over 50 kB with lines of over 400 on average."""
    sizes = F.transform(F.split(content, "\n"), F.length)
    return F.rlike(F.lower(path), F.lit(r"\.min\.(js|css)$|\.bundle\.js$|-min\.js$")) | (F.array_max(sizes) > 2000) | ((F.octet_length(content) > 50_000) & (F.length(content) / F.size(sizes) > 400))


def classify_files(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """path, state: new, changed, unchanged or deleted. If nothing was seen at all, nothing counts as deleted.

    Equal size and time are unchanged without a look at the hash; equal hashes are unchanged too.
    """
    old, new = indexed.alias("o"), seen.alias("n")
    any_seen = seen.agg((F.count("*") > 0).alias("__any"))  # one row
    both = old.join(new, F.col("o.path") == F.col("n.path"), "full_outer")
    same = ((F.col("o.size") == F.col("n.size")) & (F.col("o.mtime") == F.col("n.mtime"))) | (F.col("o.hash") == F.col("n.hash"))
    state = F.when(F.col("o.path").isNull(), "new").when(F.col("n.path").isNull(), F.when(F.col("__any"), "deleted").otherwise("unchanged")).when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return both.crossJoin(F.broadcast(any_seen)).select(F.coalesce("o.path", "n.path").alias("path"), state.alias("state"))


def best_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path, prefix: the longest registered prefix of each path; prefixes are directories."""
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    tried = paths.select("path", F.explode(steps).alias("prefix"))
    hits = tried.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
    return hits.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def merge_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def summary_batches(symbols: DataFrame, size: int = 30, longest: int = 500) -> DataFrame:
    """``symbols`` (workspace_hash, id, content) with batch and tokens: texts of over ``longest`` lines alone, others ``size`` together.

    tokens is the estimate that a request is planned with: 150, and for each symbol 25 and a quarter of its length.
    """
    alone = F.size(F.split("content", "\n")) > longest
    order = Window.partitionBy("workspace_hash", alone).orderBy("id")
    n = F.row_number().over(order).cast("long") - 1
    batch = F.when(alone, F.concat(F.lit("long-"), n.cast("string"))).otherwise(F.concat(F.lit("batch-"), F.floor(n / size).cast("string")))
    rows = symbols.withColumn("batch", batch)
    per = Window.partitionBy("workspace_hash", "batch")
    return rows.withColumn("tokens", 150 + F.sum(25 + F.floor(F.length("content") / 4)).over(per))


def fold_summaries(parts: DataFrame, summarise, batch: int = 10, depth: int = 3) -> DataFrame:
    """key, summary: parts (key, place, text) summarised ``batch`` at a time until one is left, ``depth`` times at most.

    ``summarise`` maps a DataFrame with key, place, text to the same columns, one row each; a model or a plain function.
    """
    level = parts.select("key", "place", "text")
    for _ in range(depth):
        joined = level.groupBy("key", F.floor(F.col("place") / batch).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("ps"))
        level = summarise(joined.select("key", "place", F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("text"))).select("key", "place", "text")
    rest = level.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("ps"))
    return rest.select("key", F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("summary"))
