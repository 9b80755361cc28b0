"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

`responses` makes response records from a table of pages, `read_warc` reads them from files, `derive` turns each
into a metadata record (the source's named fields and HTTP headers, links, title) and a conversion record (plain
text). Both carry WARC-Refers-To with the response's id, WARC-Concurrent-To each other's, the target URI and date
of the source, and digests: the response's payload digest, and each record's own block digest.

Record ids are name-based, so a retried task writes the same bytes. The format asks for a date, and a table of pages has no
fetch times: responses made from one carry the `date` given, by default the epoch, which marks an unknown time. A tag ends at its first `>`. Null
url: no target URI. Null html: an empty payload, whose conversion is empty. Repeated rows give repeated records with
equal ids; an empty table gives none; further columns are not read. A page of any length is scanned whole, in time
proportional to it, and held by one worker a few times over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, table
from gleaner.operators.sizes import spread

VERSION = b"WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public namespace of URLs
#: Date of responses whose fetch time is not known.
DATE = "1970-01-01T00:00:00Z"

_START = re.compile(r"<(?:(!--)|!doctype|(script|style|noscript|template)\b)", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
#: A tag; its group is a block element, whose tags end lines.
_TAG = re.compile(r"<(?:/?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|title|blockquote|pre|head|body)\b|[a-zA-Z/!?])[^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']\S*))""", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: named fields, Content-Length, an empty line, the block and two line ends. Line ends in values become blanks."""
    lines = [VERSION, *(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}".encode() for name, value in fields), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of a stream, plain or in gzip members: fields in order, and the block. ValueError on a broken one."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.decode().strip()}")
            else:
                name, _, value = line.decode().partition(":")
                fields.append((name, value.strip()))
        size = int(field(fields, "Content-Length") or 0)
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield fields, block


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in fields if n.lower() == name.lower()), None)


def visible(source: str) -> str:
    """A page without comments, doctypes, scripts, styles and the like; what is never closed goes to the end.

    One pass: a search that finds nothing is not repeated, for behind it there is nothing to find either.
    """
    out, at, missing = [], 0, set()
    for match in iter(lambda: _START.search(source, at), None):
        out.append(source[at : match.start()])
        if match[1]:
            end = source.find("-->", match.end())
            at = len(source) if end < 0 else end + 3
        elif ">" in missing or (close := source.find(">", match.end())) < 0:  # a tag without an end is text
            missing.add(">")
            out.append(match[0])
            at = match.end()
            continue
        elif match[2]:
            name = match[2].lower()
            last = None if name in missing else _CLOSE[name].search(source, close + 1)
            if last is None:
                missing.add(name)
            at = last.end() if last else len(source)
        else:
            at = close + 1
        out.append(" ")
    return "".join([*out, source[at:]])


def tagged(page: str) -> tuple[str, str]:
    """A page up to its last tag's end, and the rest, which has no tags: where a tag can begin, it also ends."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def title_of(page: str) -> str | None:
    head = tagged(page)[0]
    first = _TITLE.search(head)
    last = _CLOSE["title"].search(page, first.end()) if first else None
    return " ".join(html.unescape(page[first.end() : last.start()]).split()) if last else None


def links_of(page: str) -> list[str]:
    """Targets of the links of a page's visible part, in order."""
    found = (_HREF.search(tag[1]) for tag in _ANCHOR.finditer(tagged(visible(page))[0]))
    return [html.unescape(next(x for x in m.groups() if x is not None)) for m in found if m]


def plain_text(source: str) -> str:
    """Text of a page: no scripts, styles or comments; block elements end lines; runs of blanks become one."""
    head, rest = tagged(visible(source))
    text = _TAG.sub(lambda tag: "\n" if tag[1] else "", head) + rest
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def response_record(key: object, url: str | None, body: str | None, date: str = DATE) -> bytes:
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    uri = [("WARC-Target-URI", url)] if url is not None else []
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), *uri, ("WARC-Date", date), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derivatives(fields: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response; nothing for other types."""
    if (field(fields, "WARC-Type") or "").lower() != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("utf-8", "replace").split("\r\n")
    charset = next((m[1] for h in headers if h.lower().startswith("content-type:") and (m := re.search(r"charset=[\"']?([\w-]+)", h))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, uri, date = field(fields, "WARC-Record-ID") or "", field(fields, "WARC-Target-URI"), field(fields, "WARC-Date") or DATE
    digest = field(fields, "WARC-Payload-Digest") or sha1(payload)
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    title, links = title_of(page), links_of(page)
    said = [f"source-{n}: {v}" for n, v in fields] + [f"http-status: {status}"] + [f"http-header: {h}" for h in headers]
    said += ([f"title: {title}"] if title is not None else []) + [f"outlink: {re.sub(r'[\r\n]+', ' ', x)}" for x in links]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{x}\r\n" for x in said).encode()), "conversion": ("text/plain; charset=utf-8", plain_text(page).encode())}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        media, body = blocks[kind]
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), *([("WARC-Refers-To-Target-URI", uri), ("WARC-Target-URI", uri)] if uri is not None else []), ("WARC-Refers-To-Date", date), ("WARC-Date", date), ("WARC-Concurrent-To", ids[other]), ("WARC-Source-Payload-Digest", digest), ("WARC-Block-Digest", sha1(body)), ("Content-Type", media)]
        out.append({"kind": kind, "record_id": ids[kind], "refers_to": source, "target_uri": uri, "source_digest": digest, "block_digest": sha1(body), "block": body, "record": record(own, body)})
    return out


def responses(pages: DataFrame, key: str = "page_id", date: str = DATE) -> DataFrame:
    """One row per page: the key and `record`, its response record."""
    key_type = pages.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            keys, urls, bodies = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([response_record(*x, date) for x in zip(keys, urls, bodies, strict=True)], pa.binary())], [key, "record"])

    return pages.select(key, "url", "html").mapInArrow(make, f"`{key}` {key_type}, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path: file, and `record`, each again as a plain record. One task reads a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[bytes] = []
                for fields, block in parse(data):
                    held.append(record([f for f in fields if f[0].lower() != "content-length"], block))
                    if sum(map(len, held)) > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held, pa.binary())], ["file", "record"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.binary())], ["file", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, record binary")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows per response record: key, kind, ids and links, digests, `block` and `record`."""
    key_type = records.schema[key].dataType.simpleString()
    names = ["kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "block", "record"]
    kinds = [pa.string()] * 6 + [pa.binary()] * 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "record"):
            rows = [(k, d) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if r for f, b in parse(r) for d in derivatives(f, b)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.column(0).type), *(pa.array([d[n] for _, d in rows], t) for n, t in zip(names, kinds, strict=True))], [key, *names])

    return records.select(key, "record").mapInArrow(make, f"`{key}` {key_type}, " + ", ".join(f"{n} string" for n in names[:6]) + ", block binary, record binary")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(spread(table(spark, sf_dir, "pages"))))
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", F.length("block").cast("long").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"), F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
