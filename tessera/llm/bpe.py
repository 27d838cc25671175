"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are cut into the matches of the tokenizer's pattern by numpy over code-point classes. The tokenizers library
encodes each distinct match once for a worker; ids of texts are gathered from that. Matches are looked up by a hash, and
their bytes are compared. Decoding reverses the byte table: every id stands for bytes, a character may be split over
ids, and the bytes are joined before they are read as UTF-8.

The vocabulary is a file of ranks (a token in base64 and its id on each line). The driver reads it, derives the merges
that the library wants from the ranks, and hands both to the workers.

Defined results: a null text is the empty text (no ids, empty bytes); special tokens' strings are ordinary text; rows
are independent, so repeated rows and ties give equal results; very long texts are encoded as a whole; decoding an id
that the vocabulary does not have is an error, decoding null gives the empty text; an empty table gives an empty table;
a column that has the name of an output column is replaced.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm._arrow import append_columns, list_array, slices, text_buffers
from tessera.llm._words import hash_spans, same_spans

LETTER, NUMBER, BLANK = 1, 2, 3
#: Code points with Unicode's White_Space property, which \s matches.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct matches that a worker remembers before it starts anew.
REMEMBERED = 1_000_000


@cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or (0) other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = BLANK
    return table


def find_matches(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    r"""Positions in ``points`` where the matches of the byte-level pattern begin, row by row; they cover all of it.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= first[:-1]
    ends_row = first[1:].copy()
    ends_row[-1] = True
    blank = kind == BLANK
    # The last of several blanks before a word stands alone, or goes with the word if it is a space.
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = blank[:-1] & ~blank[1:]
    last_blank &= ~ends_row
    joins = np.zeros(n, bool)
    joins[1:] = (last_blank & (points == 0x20))[:-1]
    begins = (begins | last_blank) & ~joins
    marks = np.flatnonzero((points == 0x27) & begins)
    if len(marks):
        ahead = np.zeros(n + 3, np.uint32)
        ahead[:n] = points
        limit = rows[np.searchsorted(rows, marks, "right")] - marks
        one, two = ahead[marks + 1], ahead[marks + 2]
        is_one = np.isin(one, [ord(c) for c in "stmd"]) & (limit > 1)
        is_two = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (limit > 2)
        for hit, size in ((is_one, 2), (is_two & ~is_one, 3)):
            at = marks[hit]
            begins[at + 1] = False
            after = at + size
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


#: Tokens by id, and the two ids whose merge is each token that has more than a byte, in the order of ranks.
Vocabulary = tuple[tuple[bytes, ...], tuple[tuple[int, int], ...]]


@cache
def vocabulary(path: str) -> Vocabulary:
    """The tokens of a file of ranks, and their merges: a token's last merge is what the merges of lower ranks leave of it."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    merges = []
    for rank, token in enumerate(pieces):
        if len(token) < 2:
            continue
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1)]
            best, k = min(found)
            if best >= rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            merges.append((ranks[parts[0]], ranks[parts[1]]))
    return tuple(pieces), tuple(merges)


class Codec:
    """One tokenizer's byte table and the ids of the matches that it has met."""

    def __init__(self, known: Vocabulary):
        from tokenizers.models import BPE

        pieces, merges = known
        characters = byte_characters()
        self.forward = str.maketrans({chr(b): c for b, c in enumerate(characters)})
        names = [p.decode("latin-1").translate(self.forward) for p in pieces]
        self.model = BPE({n: i for i, n in enumerate(names) if n}, [(names[a], names[b]) for a, b in merges])
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self._forget()

    def _forget(self) -> None:
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met, self.met_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the matches' bytes, end to end

    def _tokens(self, match: bytes) -> list[int]:
        # A match needs no more cutting: its bytes' characters go to the library's merge model itself.
        return [x.id for x in self.model.tokenize(match.decode("latin-1").translate(self.forward))]

    def _look_up(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each distinct key its place in at and counts; starts and ends are spans of ``data``, one for a key."""
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, keys)
        found = place < len(self.known)
        found[found] = self.known[place[found]] == keys[found]
        missing = np.flatnonzero(~found)
        if len(missing):
            raw = data.tobytes()
            matches = [raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            got = [self._tokens(m) for m in matches]
            self.met = np.concatenate([self.met, np.frombuffer(b"".join(matches), np.uint8)])
            self.met_ends = np.concatenate([self.met_ends, self.met_ends[-1] + np.cumsum([len(m) for m in matches])])
            counts = np.array([len(x) for x in got], np.int64)
            at = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.int32, int(counts.sum()))])
            where = len(self.at) + np.arange(len(missing))
            self.at, self.counts = np.concatenate([self.at, at]), np.concatenate([self.counts, counts])
            known, where = np.concatenate([self.known, keys[missing]]), np.concatenate([self.where, where])
            order = np.argsort(known)
            self.known, self.where = known[order], where[order]
            place = np.searchsorted(self.known, keys)
        return self.where[place]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and how many each row has."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        characters = np.flatnonzero((data & 0xC0) != 0x80)
        begins = characters[find_matches(points, np.searchsorted(characters, offsets))]
        ends = np.append(begins[1:], len(data))
        keys, one, back = np.unique(hash_spans(data, begins, ends), return_index=True, return_inverse=True)
        place = self._look_up(keys, data, begins[one], ends[one])[back]
        at, counts = self.at[place], self.counts[place]
        other = np.flatnonzero(~same_spans(data, begins, ends, self.met, self.met_ends[place], self.met_ends[place + 1]))
        known = self.ids
        if len(other):  # matches whose hash another match has too
            raw = data.tobytes()
            got = [self._tokens(raw[a:b]) for a, b in zip(begins[other].tolist(), ends[other].tolist(), strict=True)]
            counts[other] = [len(x) for x in got]
            at[other] = len(known) + np.cumsum(counts[other]) - counts[other]
            known = np.concatenate([known, np.fromiter((i for x in got for i in x), np.int32)])
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = known[np.repeat(at - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(begins, offsets)])

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.encode(data, offsets)[1]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, end to end; an id that is none is a ValueError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError(f"the vocabulary has no id {int(ids.min() if ids.min() < 0 else ids.max())}")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]

    def character_spans(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the first character of its row that it touches, and the one after the last; split characters count for each part."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        characters = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)
        base = np.repeat(np.concatenate([[0], characters])[offsets[:-1]], counts)
        return characters[ends - lengths] - 1 - base, characters[ends - 1] - base


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: its own where it is printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_CODECS: dict[str, Codec] = {}


def codec(path: str, known: Callable[[], Vocabulary] | None = None) -> Codec:
    """One for a worker; tasks that it runs later find its matches known. ``known`` gives the vocabulary where there is no file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(known() if known else vocabulary(path))
    return _CODECS[path]


def shared_codec(spark: SparkSession, path: str | None) -> Callable[[], Codec]:
    """The codec of the driver's file at ``path``, for workers: they need not have the file."""
    path = path or default_path()
    known = spark.sparkContext.broadcast(vocabulary(path))  # as large as the vocabulary
    return lambda: codec(path, lambda: known.value)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", spans: str | None = None) -> DataFrame:
    """``df`` with the ids of each text as array<int>; with ``spans``, also the characters that each id covers as array<struct<start,end>>."""
    own_codec = shared_codec(df.sparkSession, path)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if spans:
        fields.append(T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own, made = own_codec(), []
        for _, _, data, offsets in slices(*text_buffers(batch.column(0))):
            found, counts = own.encode(data, offsets)
            made.append((found, counts, *(own.character_spans(found, counts, data, offsets) if spans else ())))
        whole = [np.concatenate([x[k] for x in made]) if made else np.zeros(0, np.int32) for k in range(4 if spans else 2)]
        out = [list_array(whole[0], whole[1], pa.int32())]
        if spans:
            pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in whole[2:]], ["start", "end"])
            out.append(pa.ListArray.from_arrays(out[0].offsets, pairs))
        return out

    return append_columns(df, T.StructType(fields), compute, [text])


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of each id array; bytes that are no UTF-8 (ids cut in a character) become U+FFFD. Null ids give the empty text."""
    own_codec = shared_codec(df.sparkSession, path)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own, out = own_codec(), []
        for row in batch.column(0):
            values = row.values
            found = values.to_numpy(zero_copy_only=False) if values is not None and len(values) else np.zeros(0, np.int64)
            out.append(own.decode(found).tobytes().decode(errors="replace"))
        return [pa.array(out, pa.string())]

    return append_columns(df, T.StructType([T.StructField(text, T.StringType())]), compute, [ids])


def decode_stream(parts: Iterable[Iterable[int]], path: str | None = None) -> Iterator[str]:
    """Text of ids that arrive in parts; a character that is split between parts comes with the later one."""
    own, reader = codec(path or default_path()), codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield reader.decode(own.decode(np.fromiter(part, np.int64)).tobytes())
    yield reader.decode(b"", final=True)


def round_trip(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode to)."""
    own_codec = shared_codec(df.sparkSession, path)
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own, numbers, of_ids, of_bytes = own_codec(), [], [], []
        for _, _, data, offsets in slices(*text_buffers(batch.column(0))):
            ids, counts = own.encode(data, offsets)
            ends = np.cumsum(counts)
            packed, back = ids.astype("<u4").tobytes(), own.decode(ids).tobytes()
            cut = np.concatenate([[0], np.cumsum(own.lengths[ids])])
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                numbers.append(b - a)
                of_ids.append(hashlib.sha256(packed[4 * a : 4 * b]).hexdigest())
                of_bytes.append(hashlib.sha256(back[cut[a] : cut[b]]).hexdigest())
        return [pa.array(numbers, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return append_columns(df, fields, compute, [text])
