"""WARC derivatives: responses become linked metadata records and plain-text conversion records.

``responses`` makes response records of stored pages, ``read`` takes them from WARC files, ``derive`` adds for each
response one metadata record (application/warc-fields: title, language, source headers, outlinks) and one conversion
record (text/plain), and ``write`` puts records into gzip WARC files, a gzip member for each record. A derived record
names its response in WARC-Refers-To with its URI and date, keeps the response's HTTP headers and payload digest, and
has a digest of its own block. Record ids follow from content, so a retried task writes the same records.

Blocks are bytes throughout, so what is read is written and digested byte for byte. A body is decoded for its text only:
chunked, gzip and deflate bodies are undone, then the character set is that of a byte order mark, of Content-Type or of
the page's meta element, else UTF-8; bytes that do not fit become U+FFFD. Pages are scanned once from left to right,
in time that grows with their length.

Defined results: a null page is the empty page (an empty conversion record); a null URL leaves the URI out, a null date
likewise; repeated rows give records with equal ids; records that are no responses pass ``derive`` unread; a tag that
never closes is text; broken records in a file are dropped and mark nothing else; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._arrow import share_code

#: Columns of a record.
RECORD = "page_id long, record_type string, record_id string, refers_to string, refers_to_uri string, refers_to_date string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, http_headers string, block binary"
NAMES = [part.split()[0] for part in RECORD.split(", ")]
KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[part.split()[1]] for part in RECORD.split(", ")]
#: The date of records made of pages that come without one.
DATE = "1970-01-01T00:00:00Z"
#: Elements whose content is no markup: it goes up to the end tag. Of these, noscript and svg are read for links.
RAW = frozenset("script style template".split())
#: Elements whose text is no text of the page.
SILENT = RAW | frozenset("head noscript svg".split())
#: Elements that end a line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Records from this size on cannot be a row.
MOST_RECORD = (1 << 31) - 1

_OPEN = re.compile(r"<(?:!--|[/!?]?([A-Za-z][A-Za-z0-9]*))")
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+""")
_HREF = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'"])*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LANGUAGE = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_META = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?([A-Za-z0-9_:.-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(31).join(parts).encode()).digest()[:16], version=4)}>"


def scan(page: str, url: str | None = None) -> tuple[str, str, list[str], str]:
    """Title, language, absolute outlinks in order of appearance, and the visible text.

    Visible: silent elements gone, block elements on lines of their own, blanks folded, entities resolved. The scanner
    goes from tag to tag. Where a tag does not close (the page ends, or a quote stays open), everything that was looked
    at for its end is text and is not looked at again.
    """
    title, language, links = None, "", []
    out: list[str] = []
    silent: Counter[str] = Counter()  # open elements whose text does not count
    at, n = 0, len(page)

    def text_of(begin: int, end: int) -> None:
        if begin < end and not silent.total():
            out.append(page[begin:end])

    while m := _OPEN.search(page, at):
        start, name = m.start(), (m[1] or "").lower()
        text_of(at, start)
        if not name:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        inside = _ATTRIBUTES.match(page, m.end()).end()
        if inside >= n or page[inside] != ">":
            at = min(n, inside + 1)
            text_of(start, at)
            continue
        at = inside + 1
        if page[start + 1] in "!?":
            continue
        if page[start + 1] == "/":
            if silent[name]:
                silent[name] -= 1
        elif name in RAW:
            at = _end_tag(page, name, at)[1]
        elif name == "title":
            end, after = _end_tag(page, name, at)
            title = page[at:end] if title is None and after > end else title
            text_of(at, end)
            at = after
        elif name in SILENT and page[inside - 1] != "/":
            silent[name] += 1
        elif name == "html":
            found = _LANGUAGE.search(page, m.end(), inside)
            language = language or (found[1].lower() if found else "")
        elif name == "a" and (found := _HREF.match(page, m.end(), inside)):
            target = entities.unescape(next(g for g in found.groups() if g is not None)).strip()
            try:
                links.append(urljoin(url or "", target))
            except ValueError:
                links.append(target)
        elif name == "body":
            silent["head"] = 0  # a head whose end tag is missing
        if name in BLOCKS and not silent.total():
            out.append("\x00")
    text_of(at, n)
    lines = (" ".join(entities.unescape(line).split()) for line in "".join(out).split("\x00"))
    return " ".join(entities.unescape(title or "").split()), language, links, "\n".join(line for line in lines if line)


def _end_tag(page: str, name: str, at: int) -> tuple[int, int]:
    """Where the next end tag of an element begins and ends; both the end of the page if there is none."""
    m = _ENDS[name].search(page, at)
    return (m.start(), m.end()) if m else (len(page), len(page))


_ENDS = {name: re.compile(rf"</{name}[^>]*+>", re.I) for name in (*RAW, "title")}


def plain_text(page: str) -> str:
    return scan(page)[3]


def page_facts(page: str, url: str | None) -> tuple[str, str, list[str]]:
    return scan(page, url)[:3]


def body_text(block: bytes) -> tuple[str, str]:
    """The HTTP head of a response and its body as text."""
    raw_head, _, body = block.partition(b"\r\n\r\n")
    head = raw_head.decode("latin-1")
    fields = {k.lower(): v.strip() for k, v in re.findall(r"^([^:\r\n]+):([^\r\n]*)", head, re.M)}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for coding in reversed(re.split(r"[,\s]+", fields.get("content-encoding", "").lower())):
        body = _unpacked(body, coding)
    marks = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
    for mark, charset in marks:
        if body.startswith(mark):
            return head, body[len(mark) :].decode(charset, "replace")
    named = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", fields.get("content-type", ""), re.I)
    meta = None if named else _META.search(body[:1024])
    charset = named[1] if named else meta[1].decode() if meta else "utf-8"
    # Pages that name these mean the wider set of Windows.
    charset = {"iso-8859-1": "windows-1252", "latin-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252"}.get(charset.lower(), charset)
    try:
        return head, body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return head, body.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    """The parts of a chunked body up to the last whole one; a body that is not chunked as it stands."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if at else body


def _unpacked(body: bytes, coding: str) -> bytes:
    """The unpacked body as far as it can be read; a body that is not packed as it stands."""
    if coding not in ("gzip", "x-gzip", "deflate"):
        return body
    for bits in (47, -15) if coding == "deflate" else (47,):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


def _record(page_id, kind, rid, refers, refers_uri, refers_date, uri, date, content_type, payload_digest, headers, block: bytes) -> tuple:
    return (page_id, kind, rid, refers, refers_uri, refers_date, uri, date, content_type, len(block), digest(block), payload_digest, headers, block)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=NAMES)


def _chunks(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def responses(pages: DataFrame, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record for each page, with the HTTP head that such a page had at least."""
    share_code(pages.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                rows = []
                for key, uri, page in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    raw = (page or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n"
                    rid = record_id("response", str(key), uri or "", digest(raw))
                    rows.append(_record(key, "response", rid, None, None, None, uri, date, "application/http; msgtype=response", digest(raw), head, head.encode() + b"\r\n" + raw))
                yield _batch(rows)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(step, RECORD)


def _derived(row: dict) -> Iterator[tuple]:
    head, page = body_text(row["block"] or b"")
    source = (row["record_id"], row["target_uri"], row["warc_date"])
    title, language, links, text = scan(page, row["target_uri"])
    clean = lambda s: re.sub(r"[\r\n]+", " ", s)
    fields = [f"title: {clean(title)}", f"language: {language}", f"payloadDigest: {row['payload_digest'] or ''}"]
    fields += [f"httpHeader: {line}" for line in head.split("\r\n")]
    fields += [f"outlink: {clean(link)} L a/@href" for link in links]
    common = (*source, row["target_uri"], row["warc_date"])
    lines = ("\r\n".join(fields) + "\r\n").encode("utf-8", "replace")
    yield _record(row["page_id"], "metadata", record_id("metadata", row["record_id"] or ""), *common, "application/warc-fields", row["payload_digest"], row["http_headers"], lines)
    yield _record(row["page_id"], "conversion", record_id("conversion", row["record_id"] or ""), *common, "text/plain; charset=utf-8", row["payload_digest"], row["http_headers"], text.encode("utf-8", "replace"))


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response record."""
    share_code(records.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                yield _batch([made for row in part.to_pylist() if row["record_type"] == "response" for made in _derived(row)])

    return records.select(*NAMES).mapInArrow(step, RECORD)


_HEADERS = (
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
    ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
)


_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own. The last byte is 0: the member's size ends in one below 16 MB, else an empty member follows."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    made = gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)
    return made if made.endswith(b"\0") else made + _EMPTY_MEMBER


def write(records: DataFrame, path: str) -> None:
    """Gzip WARC/1.1 files (part-*.warc.gz) at any path that Spark writes to, one for each partition, a member for each record.

    Spark's text writer ends each row with a separator; here that is the byte 0 in which each member ends. The files get
    their ending when all are written.
    """
    share_code(records.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                rows = [_member([(h, row[c]) for h, c in _HEADERS], row["block"] or b"")[:-1] for row in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["member"])

    members = records.select(*(c for _, c in _HEADERS), "block").mapInArrow(step, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    hadoop = records.sparkSession._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(records.sparkSession._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), hadoop.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def _parsed(data: bytes) -> tuple[tuple | None, int]:
    """The record in the bytes after its "WARC/1.", if they are one; else None, and how many bytes it needs (0: never one)."""
    end = data.find(b"\r\n\r\n")
    end = len(data) if end < 0 else end
    fields = dict(re.findall(r"^([^:\r\n]+):[ \t]*([^\r\n]*)", data[:end].decode(errors="replace"), re.M))
    get = {k.lower(): v for k, v in fields.items()}.get
    kind, length = get("warc-type"), get("content-length", "").strip()
    size = int(length) if re.fullmatch("[0-9]{1,10}", length) else MOST_RECORD
    if not kind or size >= MOST_RECORD:
        return None, 0
    block = data[end + 4 : end + 4 + size]
    if len(block) < size:
        return None, end + 4 + size
    head = block.partition(b"\r\n\r\n")[0].decode("latin-1") + "\r\n" if kind == "response" else None
    return (None, kind, get("warc-record-id"), get("warc-refers-to"), get("warc-refers-to-target-uri"), get("warc-refers-to-date"), get("warc-target-uri"), get("warc-date"), get("content-type"), size, get("warc-block-digest"), get("warc-payload-digest"), head, block), 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path`` (page_id is null); .gz files are unpacked as they stream by.

    Spark cuts the files before each "WARC/1." that follows two line ends, so a record is a row and no file is in memory
    as a whole. Where a block itself holds such a place, its length tells, and the pieces are joined again. In files that
    are not packed a cut between two of Spark's splits may fall on such a place; that one record is then dropped.
    """
    share_code(spark)
    mark = b"\r\n\r\nWARC/1."

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        file, held, size, needs = None, [], 0, 0
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    file, held, size, needs = name, [], 0, 0
                    piece = piece.removeprefix(b"WARC/1.")
                held.append(piece)
                size += len(piece) + (len(mark) if len(held) > 1 else 0)
                if size < needs:
                    continue
                found, needs = _parsed(mark.join(held))
                if found:
                    rows.append(found)
                if found or not needs:
                    held, size, needs = [], 0, 0
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    lines = spark.read.option("lineSep", mark.decode()).option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(step, RECORD)
