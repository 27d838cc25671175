r"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Base spans (always kept), leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (13 to 19
digits that pass Luhn) and phone (+ and 9 to 15 digits). Further generators propose spans that may overlap each other
and the base spans: runs of digits with up to three separators between two of them, single numbers in fixed formats
(also within such a run), long opaque strings, tokens of three dotted parts, written-out e-mail addresses. None of them
has an upper length. Each candidate gets features of its format (lengths, digits, groups, share of hexadecimal digits,
...) and of the text around it (words that announce a number, a secret or an address before it, quotes and units after
it). Boosted trees give a score, which is calibrated for each kind; candidates from the kind's threshold on become spans
of the kinds number, secret and contact, unless they lie wholly in a base span or in another one of these.

The trees are trained when first asked for, from generated examples (``examples``). Scores are calibrated (by a logistic
curve for each kind) on examples kept aside, and a threshold is the least probability (LEAST at least) from which on the others
of these have a precision of PRECISION. All of the work on documents is native: the trees are flat arrays that a few nested
aggregates walk.

Positions are in code points, ends exclusive. Defined results: null and empty texts have no spans; equal texts have
equal spans; very long texts are searched in full, by patterns that do not backtrack over runs, and work grows with the
spans of a text little more than in proportion (lists are built in blocks); an empty table gives an empty table; a
column that has the name of an output column is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import Forest, fit

# The contract's patterns, written so that no run is tried again from within: a match starts where the last one ended
# or where no character of its first run precedes. The matches are the same.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPAQUE = "[A-Za-z0-9_+/=-]"
#: Generators of further candidates: the kind that they propose, and a pattern.
MORE = {
    "run": ("number", r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}+(?![0-9A-Za-z])"),
    "single": ("number", r"(?<![0-9A-Za-z+.])(?:\(?[0-9]{3}\)?[\x20.\-]{0,2}[0-9]{3}[\x20.\-][0-9]{4}|[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])"),
    "opaque": ("secret", rf"(?<!{_OPAQUE}){_OPAQUE}{{20,}}+"),
    "dotted": ("secret", r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}+(?:\.[A-Za-z0-9_-]{5,}+){1,2}"),
    "written": ("contact", rf"(?<!{_LOCAL}){_LOCAL}{{2,}}+[\x20]?[\[(][\x20]?(?i:at)[\x20]?[\])][\x20]?{_HOST}++(?:(?:\.|[\x20]?[\[(][\x20]?(?i:dot)[\x20]?[\])][\x20]?|[\x20](?i:dot)[\x20]){_HOST}++)++"),
}
#: What a text must hold for a generator to find anything: literals of which one occurs, or a digit.
NEEDS = {"email": ("@",), "phone": ("+",), "dotted": ("eyJ",), "written": ("(", "["), "opaque": ()}
MORE_KINDS = ("number", "secret", "contact")
KINDS = (*BASE, *MORE_KINDS)
#: Characters before and after a candidate that count as its context; those after it end at the generator's next candidate.
BEFORE, AFTER = 40, 12
NUMBER_WORDS = ("phone", "tel", "call", "mobile", "fax", "ssn", "passport", "account", "iban", "card", "id no", "number", "contact")
SECRET_WORDS = ("token", "secret", "passw", "api", "key", "auth", "bearer", "credential")
CONTACT_WORDS = ("mail", "write", "contact", "reach")
UNIT = r"^ ?(?:%|[$€£]|(?:km|kg|mm|cm|m|g|ms|s|mb|gb|kb|years?|days?|hours?|times|units?|items?|people|pages?)\b)"
FEATURES = (
    "kind", "length", "digits", "groups", "separators", "hex_share", "upper_share", "lower_share", "distinct", "quoted", "assigned", "number_word", "secret_word", "contact_word", "lead_plus", "cyclic",
    "closed", "unit",
)
#: A threshold is at least LEAST: the examples are easier to tell apart than what texts hold.
PRECISION, LEAST = 0.98, 0.5
TREES, DEPTH = 20, 4
#: Items of a list that one step adds up; a list is put together from such blocks.
BLOCK = 256
#: Characters of a piece of a text that is redacted.
PIECE = 8192


def _scanned(items: Column, init: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """emit(state before it, item) of each item in order, as array<kind>; step(state, item) gives the next state.

    Adding to an array copies it, so results are gathered in blocks: first the state before each block, then each
    block's results.
    """
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast(f"array<{kind}>")

    def gather(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def advance(acc: Column, block: Column) -> Column:
        made = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), gather)
        return F.struct(made["state"].alias("state"), F.concat(acc["out"], F.array(made["out"])).alias("out"))

    begin = F.struct(init.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, begin, advance, lambda acc: F.flatten(acc["out"]))).otherwise(none)


SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _spans(pieces: str) -> Column:
    """array<SPAN> from an array of struct<between, match, after>: the lengths of matches and of the texts between them add up to the positions."""
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def step(state: Column, p: Column) -> Column:
        tail = F.right(F.concat(state["tail"], p["between"], p["match"]), F.lit(BEFORE))
        return F.struct((state["at"] + F.length(p["between"]) + F.length(p["match"])).alias("at"), tail.alias("tail"))

    def emit(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["between"])
        before = F.right(F.concat(state["tail"], p["between"]), F.lit(BEFORE))
        return F.struct(start.alias("start"), (start + F.length(p["match"])).alias("end"), p["match"].alias("value"), before.alias("before"), p["after"].alias("after"))

    return _scanned(F.col(pieces), init, step, emit, SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("|".join(words))).cast("double")


def _share(value: Column, drop: str) -> Column:
    """Share of the characters that ``drop`` does not remove."""
    return F.length(F.regexp_replace(value, drop, "")) / F.length(value)


def _features(kind: str, span: Column) -> Column:
    """array<double> in the order of FEATURES."""
    value, context, after = span["value"], F.lower(span["before"]), span["after"]
    made = {
        "kind": F.lit(float(MORE_KINDS.index(kind))),
        "length": F.length(value),
        "digits": F.length(_digits(value)),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")),
        "separators": F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")),
        "hex_share": _share(value, "[^0-9a-fA-F]"),
        "upper_share": _share(value, "[^A-Z]"),
        "lower_share": _share(value, "[^a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))),
        "quoted": F.rlike(context, F.lit("[\"'`]$")).cast("double"),
        "assigned": F.rlike(context, F.lit("[=:][\\s\"'`]*$")).cast("double"),
        "number_word": _has(context, NUMBER_WORDS),
        "secret_word": _has(context, SECRET_WORDS),
        "contact_word": _has(context, CONTACT_WORDS),
        "lead_plus": F.rlike(context, F.lit("\\+$")).cast("double"),
        "cyclic": F.rlike(value, F.lit("^(.{1,4})\\1{4}")).cast("double"),
        "closed": F.rlike(after, F.lit("^[\"'`]")).cast("double"),
        "unit": F.rlike(F.lower(after), F.lit(UNIT)).cast("double"),
    }
    return F.array(*(made[f].cast("double") for f in FEATURES))


def _feature_row(kind: str, context: str, value: str, after: str = "") -> list[float]:
    """The same features in Python, for the generated examples (and for tests of the expressions)."""
    low = context.lower()[-BEFORE:]
    n = max(1, len(value))
    count = lambda p: sum(1 for c in value if re.match(p, c))
    has = lambda words: float(any(w in low for w in words))
    made = {
        "kind": MORE_KINDS.index(kind), "length": len(value), "digits": count("[0-9]"), "groups": len(re.split("[^0-9A-Za-z]+", value)),
        "separators": len(value) - count("[0-9A-Za-z]"), "hex_share": count("[0-9a-fA-F]") / n, "upper_share": count("[A-Z]") / n, "lower_share": count("[a-z]") / n,
        "distinct": len(set(value)), "quoted": bool(re.search("[\"'`]$", low)), "assigned": bool(re.search("[=:][\\s\"'`]*$", low)),
        "number_word": has(NUMBER_WORDS), "secret_word": has(SECRET_WORDS), "contact_word": has(CONTACT_WORDS), "lead_plus": low.endswith("+"), "cyclic": bool(re.match(r"^(.{1,4})\1{4}", value)),
        "closed": bool(re.match("[\"'`]", after)), "unit": bool(re.match(UNIT, after[:AFTER].lower())),
    }
    return [float(made[f]) for f in FEATURES]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with their contexts, and whether each is personal or secret.

    Personal: local and national phone numbers, identity and account numbers where their format or the words before them
    tell; keys of random hexadecimal, base64 or mixed characters; written-out addresses. Not: years, prices, dates,
    plain long numbers, counters, rulers, file paths, long words and identifiers in running text.
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=10: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(8)) + " "
    announce = lambda words: prose() + r.choice(words) + r.choice([" ", ": ", " is ", "=", " no. "])
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    yes = [
        lambda: ("number", r.choice([prose(), announce(NUMBER_WORDS)]), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: ("number", r.choice([prose(), announce(NUMBER_WORDS)]), f"{digits(3)}{(s := r.choice('-. '))}{digits(3)}{s}{digits(4)}"),
        lambda: ("number", r.choice([prose(), announce(NUMBER_WORDS)]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: ("number", r.choice([prose(), announce(NUMBER_WORDS)]), (s := r.choice("- ")).join(digits(4) for _ in range(4))),
        lambda: ("number", announce(NUMBER_WORDS), digits(r.randint(7, 18))),
        lambda: ("number", announce(NUMBER_WORDS), " ".join(digits(r.randint(2, 4)) for _ in range(r.randint(3, 5)))),
        lambda: ("secret", r.choice([announce(SECRET_WORDS), prose() + r.choice(SECRET_WORDS) + r.choice([' = "', ": '", "=", '="'])]), pick(hexa, r.choice([24, 32, 40, 64]))),
        lambda: ("secret", r.choice([announce(SECRET_WORDS), prose() + r.choice(SECRET_WORDS) + r.choice([' = "', ": '", "=", '="'])]), pick(mixed, r.randint(20, 80))),
        lambda: ("secret", r.choice([announce(SECRET_WORDS), prose() + r.choice(SECRET_WORDS) + ' = "']), r.choice(["sk_live_", "ghp_", "AKIA", "xox-"]) + pick(mixed, r.randint(20, 40))),
        lambda: ("contact", r.choice([prose(), announce(CONTACT_WORDS)]), f"{word()}.{word()} {r.choice(['(at)', '[at]', '( at )'])} {word()}{r.choice(['.', ' dot ', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}"),
    ]
    no = [
        lambda: ("number", prose(), digits(r.randint(7, 25))),
        lambda: ("number", prose(), f"{r.randint(1900, 2100)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        lambda: ("number", prose(), f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2100)}"),
        lambda: ("number", prose(), f"{r.randint(1900, 2100)}-{r.randint(1900, 2100)}"),
        lambda: ("number", prose(), " ".join(str(r.randint(0, 99)) for _ in range(r.randint(5, 12)))),
        lambda: ("number", prose(), ".".join(digits(r.randint(1, 3)) for _ in range(r.randint(5, 8)))),
        lambda: ("secret", prose(), word(20, 60)),
        lambda: ("secret", prose(), word(20, 60).upper()),
        lambda: ("secret", prose(), "/".join(word() for _ in range(r.randint(4, 9)))),
        lambda: ("secret", prose(), "_".join(word() for _ in range(r.randint(4, 9)))),
        lambda: ("secret", prose(), "-".join(word() for _ in range(r.randint(4, 9)))),
        lambda: ("secret", prose(), r.choice("-=_+") * r.randint(20, 90)),
        lambda: ("secret", announce(SECRET_WORDS), r.choice([word(20, 40), "-".join(word() for _ in range(6)), "=" * 30])),
        lambda: ("contact", prose(), f"{word()} (at) {r.randint(1, 9)}.{r.randint(1, 9)}"),
    ]
    rows, truth = [], []
    for _ in range(n):
        good = r.random() < 0.5
        kind, context, value = r.choice(yes if good else no)()
        opened = re.search("[\"'`]$", context)
        counted = kind == "number" and not good and r.random() < 0.3
        after = opened[0] if opened else r.choice([" km", "%", " years", " items", " $"]) if counted else r.choice([" ", ".", ", ", "\n", ")"]) + word()
        rows.append(_feature_row(kind, context, value, after))
        truth.append(float(good))
    return np.array(rows), np.array(truth)


def _curve(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the truth of these scores best (by Newton's steps)."""
    x = np.column_stack([raw, np.ones(len(raw))])
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(bend, x.T @ (p - truth) + 1e-2 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


@cache
def model() -> tuple[Forest, dict[str, tuple[float, float, float]]]:
    """The trees, and for each further kind the slope and offset of its curve and its threshold."""
    forest = fit(*examples(6000, 7), trees=TREES, depth=DEPTH, rate=0.4)
    (x, y), (x2, y2) = examples(3000, 8), examples(3000, 9)
    curves = {}
    for k, kind in enumerate(MORE_KINDS):
        one, two = x[:, 0] == k, x2[:, 0] == k
        a, b = _curve(_logit(forest.scores(x[one])), y[one])
        p = 1 / (1 + np.exp(-(a * _logit(forest.scores(x2[two])) + b)))
        tried = [c for c in np.unique(np.round(p, 3)) if c >= LEAST and (p >= c).any() and y2[two][p >= c].mean() >= PRECISION]
        curves[kind] = (a, b, float(min(tried, default=0.9)))
    return forest, curves


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _numbers(values, kind: str) -> Column:
    """A constant array, written as one literal so that plans stay small."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def _score(forest: Forest, x: Column) -> Column:
    """The raw score of a feature array. A leaf leads to itself, so each tree is walked DEPTH steps."""
    leaf = forest.feature < 0
    feature = _numbers(np.where(leaf, 0, forest.feature).tolist(), "int")
    threshold = _numbers(np.where(leaf, 1e300, forest.threshold).tolist(), "double")
    left = _numbers(np.where(leaf, np.arange(len(leaf)), forest.left).tolist(), "int")
    value = _numbers(forest.value.tolist(), "double")
    levels = _numbers(range(DEPTH), "int")

    def walk(root: Column) -> Column:
        return F.aggregate(levels, root, lambda at, _: F.get(left, at) + (F.get(x, F.get(feature, at)) > F.get(threshold, at)).cast("int"))

    return F.aggregate(_numbers(forest.roots.tolist(), "int"), F.lit(float(forest.base)), lambda total, root: total + F.get(value, walk(root)))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with pii: array<struct<kind, start, end>>, by kind as in KINDS, then by start; the first kinds are the base."""
    forest, curves = model()
    names = [f"`{c}`" for c in df.columns if c.lower() != "pii"]
    patterns = BASE | {g: p for g, (_, p) in MORE.items()}
    t = F.col("__t")

    def able(generator: str) -> Column:
        hit = F.lit(generator == "opaque")
        for literal in NEEDS.get(generator, ()):
            hit = hit | F.contains(t, F.lit(literal))
        return hit if generator in NEEDS else F.col("__digit")

    # One step each for matches, texts between, spans, features and scores: no step repeats another's work.
    step = df.select(*names, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    step = step.select("*", F.rlike(t, F.lit("[0-9]")).alias("__digit"))
    none = F.array().cast("array<string>")
    step = step.select(*names, "__t", *(F.when(able(g), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"__m_{g}") for g, p in patterns.items()))
    step = step.select(*names, *(f"__m_{g}" for g in patterns), *(F.when(F.size(f"__m_{g}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"__b_{g}") for g, p in patterns.items()))

    def pieces(g: str) -> Column:
        matches, between = F.col(f"__m_{g}"), F.col(f"__b_{g}")
        zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("a"), matches.alias("b"), F.slice(between, F.lit(2), F.size(matches)).alias("c"))
        return F.transform(zipped, lambda z: F.struct(z["a"].alias("between"), z["b"].alias("match"), F.left(z["c"], F.lit(AFTER)).alias("after"))).alias(f"__p_{g}")

    step = step.select(*names, *(pieces(g) for g in patterns))
    step = step.select(*names, *(_spans(f"__p_{g}").alias(f"__s_{g}") for g in patterns))

    def accepted(kind: str) -> Column:
        return F.transform(F.filter(F.col(f"__s_{kind}"), lambda s: _accepted(kind, s["value"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def described(g: str, kind: str) -> Column:
        return F.transform(F.col(f"__s_{g}"), lambda s: F.struct(F.lit(MORE_KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(kind, s).alias("x")))

    step = step.select(*names, F.concat(*(accepted(k) for k in BASE)).alias("__base"), F.concat(*(described(g, k) for g, (k, _) in MORE.items())).alias("__x"))
    slope, offset, cut = (_numbers([curves[k][i] for k in MORE_KINDS], "double") for i in range(3))

    def chosen(c: Column) -> Column:
        k = c["kind"]
        return 1 / (1 + F.exp(-(F.get(slope, k) * _score(forest, c["x"]) + F.get(offset, k)))) >= F.get(cut, k)

    step = step.select(*names, "__base", F.filter("__x", chosen).alias("__x"))
    # In order of starts, of equal ones the longest first, the base first: what ends no later than another did is in that one.
    base = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(-1).alias("kind")))
    more = F.transform("__x", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    step = step.select(*names, "__base", F.when(F.size("__x") > 0, F.array_sort(F.concat(base, more))).otherwise(F.array().cast("array<struct<start:int,back:int,kind:int>>")).alias("__all"))
    fresh = _scanned(F.col("__all"), F.lit(-1), lambda until, s: F.greatest(until, -s["back"]), lambda until, s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"), (-s["back"] > until).alias("out")), "struct<kind:int,start:int,end:int,out:boolean>")
    step = step.select(*names, "__base", F.array_sort(F.filter(fresh, lambda s: s["out"] & (s["kind"] >= 0))).alias("__all"))
    kinds = F.split(F.lit(",".join(MORE_KINDS)), ",")
    added = F.transform("__all", lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return step.select(*names, F.concat("__base", added).alias("pii"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(doc_id, *(count(k) for k in BASE), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("pii")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one, named by the first."""
    found = find(df, text)
    names = [f"`{c}`" for c in df.columns if c.lower() != "pii"]
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = found.select(*names, order.alias("__order"))
    # What a span adds to those before it: from the end of these on; only the first of overlapping ones is named.
    cut = _scanned(F.col("__order"), F.lit(0), lambda until, s: F.greatest(until, s["end"]), lambda until, s: F.struct(F.greatest(until, s["start"]).alias("start"), s["end"].alias("end"), F.when(s["start"] >= until, s["kind"]).alias("kind")), "struct<start:int,end:int,kind:string>")
    step = step.select(*names, F.filter(cut, lambda s: s["end"] > s["start"]).alias("__cut"))

    def clean(piece: Column, k: Column) -> Column:
        """A piece of the text without what of the spans lies in it; a span is named where it begins."""
        low = k * PIECE
        inside = F.filter("__cut", lambda s: (s["start"] < low + PIECE) & (s["end"] > low))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def cover(acc: Column, s: Column) -> Column:
            a, b = F.greatest(s["start"] - low, F.lit(0)), F.least(s["end"] - low, F.lit(PIECE))
            name = F.when((s["start"] >= low) & s["kind"].isNotNull(), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.substr(piece, acc["at"] + 1, a - acc["at"]), name)).alias("out"))

        return F.aggregate(inside, begin, cover, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(piece, acc["at"] + 1, F.lit(PIECE))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(own) / PIECE).cast("int")), lambda k: F.substr(own, k * PIECE + 1, F.lit(PIECE)))
    step = step.select("*", F.when(F.size("__cut") > 0, pieces).alias("__pieces"))
    masked = F.when(F.size("__cut") > 0, F.array_join(F.transform("__pieces", clean), "")).otherwise(F.col(f"`{text}`"))
    return step.select(*(masked.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c.lower() != "pii"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the contract's patterns as they are written; for tests."""
    text = text or ""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out
