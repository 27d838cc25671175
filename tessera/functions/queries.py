"""What is done with a query's words, times and cursor before any data is read."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

# Words that carry no search intent, for relaxing a query, for boosting and for entities.
RELAX_STOP_WORDS = frozenset("the a an is are was were what how why when where explain show find trace debug".split())
KEYWORD_STOP_WORDS = frozenset(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need
    dare ought used to of in for on with at by from as into through during before after above below between out off over
    under again further then once here there when where why how all both each few more most other some such no nor not
    only own same so than too very just don now and but or if while about up it its what which who whom this that these
    those i me my we our you your he him his she her they them their""".split()
)
ENTITY_STOP_WORDS = frozenset("the how does work what when is are a an in to for of and or".split())
KEYWORD_TRIM = ".,;:!?\"'()[]{}<>|/\\@#$%^&*~`"
MAX_OFFSET = 10_000


def relaxed_terms(query: str) -> list[str]:
    """The terms of the OR form of a query: stop words gone, only letters, digits and _ kept, lower case."""
    kept = (re.sub(r"[^\w]", "", w.lower()) for w in query.split() if w.lower() not in RELAX_STOP_WORDS)
    return [w for w in kept if w]


def keywords(query: str) -> list[str]:
    found = (w.strip(KEYWORD_TRIM) for w in query.lower().split())
    return list(dict.fromkeys(w for w in found if len(w.encode()) >= 2 and w not in KEYWORD_STOP_WORDS))


def query_entities(query: str, stop_words: frozenset[str] = ENTITY_STOP_WORDS) -> list[str]:
    found = (re.sub(r"^[^\w]+|[^\w]+$", "", w).lower() for w in query.split())
    return list(dict.fromkeys(w for w in found if len(w) >= 2 and w not in stop_words))


@dataclass(frozen=True)
class TextQuery:
    """A web-style query: every group needs one of its phrases (lists of terms); no excluded phrase may occur."""

    groups: tuple[tuple[tuple[str, ...], ...], ...]
    excluded: tuple[tuple[str, ...], ...]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(t for g in self.groups for phrase in g for t in phrase))


def web_query(text: str) -> TextQuery:
    """Words are joined by AND, "or" joins neighbours, quotes make phrases, a leading - excludes."""
    groups: list[list[tuple[str, ...]]] = []
    excluded: list[tuple[str, ...]] = []
    joined = False
    for minus, phrase, word in re.findall(r"(-?)(?:\"([^\"]*)\"|([^\s\"]+))", text):
        if not phrase and word.lower() == "or" and not minus:
            joined = bool(groups)
            continue
        terms = tuple(re.findall(r"\w+", (phrase or word).lower()))
        if not terms:
            continue
        if minus:
            excluded.append(terms)
        elif joined:
            groups[-1].append(terms)
        else:
            groups.append([terms])
        joined = False
    return TextQuery(tuple(map(tuple, groups)), tuple(excluded))


# Seconds of each unit of a relative time.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}
GO_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def parse_time(text: str, now: datetime) -> datetime:
    """RFC 3339, a sum of durations (1h30m), or a number with a unit up to years; durations count back from ``now``."""
    text = text.strip()
    if not text:
        raise ValueError("empty time")
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        return datetime.fromisoformat(text)
    part = r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)"
    if re.fullmatch(rf"[+-]?(?:{part})+", text):
        seconds = sum(float(n) * GO_UNITS[u] for n, u in re.findall(part, text)) * (-1 if text[0] == "-" else 1)
    elif m := re.fullmatch(r"(-?\d+(?:\.\d+)?)(mo|[smhdwy])", text.lower()):
        seconds = float(m[1]) * UNITS[m[2]]
    else:
        raise ValueError(f"not a time: {text!r}")
    if seconds <= 0:
        raise ValueError(f"not a positive duration: {text!r}")
    return now - timedelta(seconds=seconds)


def temporal_intent(query: str, now: datetime) -> tuple[datetime | None, datetime | None] | None:
    """(after, before) that a query's words ask for; the first kind that occurs counts. None without such words."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    low = query.lower()
    if m := re.search(r"\b(?:last|past)\s+(\d+)\s+(day|week|month)s?\b", low):
        n = int(m[1])
        if m[2] != "month":
            return now - timedelta(days=n * (7 if m[2] == "week" else 1)), None
        months = now.year * 12 + now.month - 1 - n
        # A day that the month does not have runs over into the next one.
        return now.replace(year=months // 12, month=months % 12 + 1, day=1) + timedelta(days=now.day - 1), None
    if re.search(r"\bthis\s+week\b", low):
        return midnight - timedelta(days=now.weekday()), None
    if re.search(r"\btoday\b", low):
        return midnight, None
    if re.search(r"\byesterday\b", low):
        return midnight - timedelta(days=1), midnight
    if re.search(r"\b(?:recent|recently)\b", low):
        return now - timedelta(days=7), None
    return None


def filter_key(query: str, tags: list[str], scope: str, collections: list[str], times: list[str]) -> str:
    """16 hexadecimal digits that stand for all filters of a search."""
    parts = [query, *sorted(tags), scope, *sorted(collections), *times]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def encode_cursor(offset: int, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset, "q": key}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, key: str) -> int:
    """The offset; an error if the cursor is of another search or out of range."""
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        offset, own = int(got["o"]), got["q"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e
    if own != key:
        raise ValueError("cursor is of another search")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError("cursor out of range")
    return offset


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=UTC)


def utc_now() -> datetime:
    return datetime.now(UTC)
