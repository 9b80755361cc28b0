"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions only near hits, checksum validation.

`scan_secrets` keeps every input row and works row by row: null text counts as empty and gives no spans, repeated
rows give repeated results, an empty table an empty one. Only the key and the text are read, so further columns
never clash. A text of any length is scanned whole, in time proportional to it. Offsets are code points of the whole text, ends exclusive. Every kind is leftmost and
non-overlapping by itself; spans of different kinds may overlap. `redact_secrets` replaces spans in a column.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import byte_list, small_batches, table
from gleaner.operators.sizes import spread

#: Base kinds come first; the order breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "forge", "card", "pem")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
FORGE = re.compile(rb"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(rb"""card(?:\x20(?:number|no\.?))?["']?\x20*[:=#]?\x20*["']?([0-9](?:[ -]?[0-9]){12,18})(?![0-9])""", re.I)
PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")

# The keywords of each kind, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "card": ("card",),
    "pem": ("-----begin ",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 16
_RUN = b"x" * HEX_LEAST
_HEX_CLASS = bytes(120 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def forge_checksum(body: bytes) -> str:
    """Six base-62 digits of the CRC-32 that forge tokens carry behind their body."""
    n, out = zlib.crc32(body), ""
    while n:
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 12
    if kind == "access":
        return len(match[0]) >= 18
    if kind == "forge":
        return forge_checksum(match[2]).encode() == match[3]
    if kind == "card":
        return luhn(re.sub(rb"[^0-9]", b"", match[1]))
    return True


_AT = {"assign": ASSIGN, "access": ACCESS, "forge": FORGE, "card": CARD, "pem": PEM}


def find_spans(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points of one UTF-8 text, sorted by start and kind."""
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last + 1 - length)
    found = []
    for kind, starts in hits.items():
        free = 0
        for at in sorted(set(starts)):
            if at >= free and (match := _AT[kind].match(data, at)):
                free = match.end()
                if _accepted(kind, match):
                    found.append((at, free, kind))
    classes, at = data.translate(_HEX_CLASS), 0
    while (at := classes.find(_RUN, at)) >= 0:
        end = HEX.match(data, at).end()
        found.append((at, end, "hex"))
        at = end
    if found and not data.isascii():
        place, done, points = {}, 0, 0
        for byte in sorted({x for start, end, _ in found for x in (start, end)}):
            points += len(data[done:byte].decode("utf-8"))
            place[byte], done = points, byte
        found = [(place[start], place[end], kind) for start, end, kind in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and `found`, an array of (kind, start, end)."""
    key_type = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches, text):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(data, automaton)] for data in byte_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [key, "found"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: Column, mask: str = "[{kind}]") -> Column:
    """The text with every secret replaced by a mask naming its kind; overlapping spans give the mask of the first."""

    @F.pandas_udf("string")
    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()

        def one(value: str | None) -> str | None:
            spans = find_spans(value.encode(), automaton) if value else []
            if not spans:
                return value
            out, at = [], 0
            for start, end, kind in spans:
                if start >= at:
                    out += [value[at:start], mask.format(kind=kind)]
                at = max(at, end)
            return "".join([*out, value[at:]])

        for part in texts:
            yield part.map(one, na_action="ignore")

    return redact(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the contract, from `found`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(spread(table(spark, sf_dir, "documents"))))


def brute_force(text: str | None) -> dict:
    """The base kinds by plain scans of the whole text, as one row of the query without its key."""
    data = text or ""
    # The contract folds ASCII letters only.
    plain = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= HEX_LEAST}
    spans = [(m.start(), list(plain).index(kind), kind, m.end()) for kind, pattern in plain.items() for m in re.finditer(pattern, data) if least[kind](m)]
    said = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
    return {f"n_{kind}": sum(x[2] == kind for x in spans) for kind in plain} | {"base_sha256": hashlib.sha256(said.encode()).hexdigest()}
