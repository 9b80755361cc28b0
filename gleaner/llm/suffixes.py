"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or
in the same one. Strings lie within one document's UTF-8 bytes and are judged on the input. A string of `length`
bytes is called a window.

Which windows to look at. The anchor of a window is the first of the places in it whose GRAM-byte hash is least; equal
windows have equal anchors at equal offsets. Groups of documents send the distinct hashes of their anchors to slices
of the hashes; windows whose anchor occurs once anywhere are left alone, all others go through the transforms.

Shards. Neighbouring windows of an anchor are taken together in bands of `step`. The bytes that all windows of a band hold, its
core, become one symbol MARK, named by 128 bits of hash; up to `step` bytes on either side, as far as windows of
this anchor need them, stay as they are, and END follows. So each occurrence of a band is a string of at most
2 * `step` + 2 symbols, and a window of it is `step` + 1 symbols in a row, MARK among them. A shard is the collection of a
group's distinct strings of a slice, each at its first place; its task sorts their suffixes, which gives the shard's transform and the
windows that repeat in the shard. Strings with no window that is new to the shard are taken out of the transform, which leaves a
transform of the others. So a common text costs each shard one string, not one for each copy.

Merge. A slice gets the transforms of all shards, walks them backwards from the ENDs to learn which string a row
is in, and refines an interleave of their rows: each round reads the symbols before the rows in the order of the
interleave and deals the rows to those symbols, stably, so that rows sorted by h symbols become rows sorted by h + 1. Where
two neighbours first differ, their common prefix is known. After `step` + 1 rounds, rows whose common prefix is a whole
window and whose cores have one name are one window: its first occurrence stays, the others are repeats. No suffix is
sorted again.

An anchor with HOT occurrences or more may stand in very many different surroundings: a very common line. Its bands
are of one window each, so that slices share them by what stands around the anchor.

Null text counts as empty; a document shorter than `length` loses nothing; one of any length is judged whole. Rows with
a null id are given back whole. Of rows that repeat an id, the longest text (of equal lengths the least) stands for the id; rows with the same
text share its result, others are given back whole. Further columns are read only if they are to be carried. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.common import counted, flat_bytes, groups_for, pack_sorted, table, trimmed, unpack_sorted, values

LENGTH = 100
GRAM = 50
STEP = 10
#: Occurrences of an anchor from which on each of its windows goes its own way.
HOT = 200_000
#: Bytes worked on at once in anchor search; strings of a shard sorted at once; symbols merged at once.
CHUNK, STRINGS, SYMBOLS = 1_000_000, 15_000, 250_000
#: Shares of a slice that are merged one after the other.
SHARES = 16
#: Text of a group of documents, about: a task holds it with its strings, some twenty times as much at the worst. Groups
#: send a blob to every slice that they have strings for: with larger executors take larger groups.
GROUP_BYTES = 16_000_000
ANCHOR_BITS = 48
END, MARK = 0xFE, 0xFF  # no byte of UTF-8

_U = np.uint64
_draw = np.random.default_rng(20240502)
_BYTE = _draw.integers(1, 2**63, 256, dtype=_U) | _U(1)
_MULT = _draw.integers(1, 2**63, 12, dtype=_U) | _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes at each place where so many follow: powers of two, doubled and joined."""
    power, size, h, found, done = 1, 1, _BYTE[data], None, 0
    level = 0
    while True:
        if gram & size:
            if found is None:
                found, done = h, size
            else:
                n = len(data) - done - size + 1
                found = found[:n] * _MULT[level] + h[done : done + n]
                done += size
        if done == gram:
            return mix(found)
        n = len(h) - size
        if n <= 0:
            return np.zeros(0, _U)
        h = h[:n] * _MULT[level + 1] + h[size:]
        size, power, level = size * 2, power + 1, level + 1


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of documents that lie one behind the other: places, the hashes of their grams, and by how many bytes
    the last and the first of an anchor's windows begin before it."""
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    if len(data) < length:
        return none, np.zeros(0, _U), none, none
    h = gram_hashes(data, gram)
    rank = (h >> _U(33)).astype(np.uint32) + np.uint32(1)
    least = slide(rank, width, np.minimum)  # of the window at each place
    crossing = np.zeros(len(data) + 1, np.int32)
    np.add.at(crossing, np.maximum(bounds[1:-1] - length + 1, 0), 1)
    np.add.at(crossing, bounds[1:-1], -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    edge = np.zeros(width - 1, np.uint32)
    most = slide(np.concatenate([edge, least, edge]), width, np.maximum)  # over the windows around each place
    at = np.flatnonzero(rank == most)
    # Windows in a row with one least rank have one anchor, or several of equal rank, each up to its own place.
    start = np.flatnonzero(np.diff(least, prepend=np.uint32(0) if least[0] else np.uint32(1)))
    last = np.append(start[1:], len(least)) - 1
    value, own = least[start], rank[at]
    run = np.searchsorted(start, at, side="right") - 1
    off = np.flatnonzero(value[run] != own)
    while len(off):  # a smaller rank follows the anchor closely: its windows are in an earlier row
        run[off] -= 1
        off = off[value[run[off]] != own[off]]
    first = np.maximum(start[run], at - width + 1)
    first[1:] = np.maximum(first[1:], np.where(own[1:] == own[:-1], at[:-1] + 1, 0))
    last = np.minimum(last[run], at)
    used = last >= first
    at, first, last = at[used], first[used], last[used]
    return at, h[at], at - last, at - first


def pieces(bounds: np.ndarray, most: int, margin: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Runs of documents of about `most` bytes: first, last + 1, bytes to read and bytes to keep; a longer one comes in overlapping pieces."""
    begin = 0
    while begin < len(bounds) - 1:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1)
        lo, hi = int(bounds[begin]), int(bounds[end])
        for a in range(lo, max(hi, lo + 1), most if end == begin + 1 else hi - lo + 1):
            b = min(hi, a + most) if end == begin + 1 else hi
            yield begin, end, max(lo, a - margin), min(hi, b + margin), a, b
        begin = end


def bands(at: np.ndarray, low: np.ndarray, high: np.ndarray, side: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of the windows that begin `low` to `high` bytes before anchors: places of cores, and by how many bytes the last and the
    first window of each begin before its core. With a step of 0, each window is a band."""
    if not step:
        n = high - low + 1
        before = np.repeat(high, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        none = np.zeros(len(before), np.int64)
        return np.repeat(at, n) - before, none, none
    out = []
    for a in range(0, side, step):
        last = a + step if a + step >= side else a + step - 1
        i, j = np.maximum(low, a) - a, np.minimum(high, last) - a
        some = i <= j
        out.append((at[some] - a, i[some], j[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def strings_of(data: np.ndarray, core: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each band in a row of a matrix, zeros behind them, and how many there are."""
    width = 2 * step + 2
    turn = np.arange(width)
    sizes = high + step - low + 2
    place = turn - high[:, None]  # of MARK: 0
    source = np.where(place < 0, core[:, None] + place, core[:, None] + size + place - 1)
    out = data[np.clip(source, 0, len(data) - 1)]
    out[place == 0] = MARK
    out[turn == sizes[:, None] - 1] = END
    out[turn >= sizes[:, None]] = 0
    return out, sizes


def core_names(data: np.ndarray, core: np.ndarray, size: int) -> np.ndarray:
    """128 bits of hash of the `size` bytes at each place, in rows of two numbers."""
    raw = memoryview(np.ascontiguousarray(data))
    name = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([name(raw[a : a + size]) for a in core.tolist()]), "<u8").reshape(-1, 2)


def stable_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several keys, the first before all. Only rows that are still tied meet the next key:
    a plain sort of one number a row is many times faster than a stable one of several."""
    order = np.argsort(keys[0])
    fresh = np.ones(len(order), bool)
    fresh[1:] = keys[0][order[1:]] != keys[0][order[:-1]]
    for key in (*keys[1:], None):
        tied = ~fresh
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, group = order[at], np.cumsum(fresh[at])
        if key is None:
            second = rows
        else:
            value = key[rows]
            by_value = np.argsort(value)
            steps = np.zeros(len(rows), np.int64)
            steps[1:] = value[by_value[1:]] != value[by_value[:-1]]
            second = np.empty(len(rows), np.int64)
            second[by_value] = np.cumsum(steps)
        both = (group << 32) | second
        by_both = np.argsort(both)
        order[at], both = rows[by_both], both[by_both]
        fresh[at[1:]] = both[1:] != both[:-1]
    return order


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n equal ranges that hashes are in."""
    return (hashes >> _U(33)).astype(np.int64) * n >> 31


def keys_of(rows: np.ndarray, width: int) -> list[np.ndarray]:
    """Numbers in the order of the `width` bytes from each place of each row on, eight bytes in each; rows have room for them."""
    n, room = rows.shape
    return [np.ndarray((n, room - width), ">u8", rows, 8 * k, (room, 1)) for k in range(width // 8)]


def shard_transform(strings: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """The order of a shard's strings; and the shard's rows in the order of the suffixes: string (in that order) and offset of each,
    the symbol before it, and the number of its block, in which rows share their first `depth` symbols.

    Equal suffixes stand in the order of their strings, so that the transform can be walked. The symbol before a
    string is its END.
    """
    n, most = strings.shape
    width = -(-most // 8) * 8
    rows = np.zeros((n, most + width), np.uint8)
    rows[:, :most] = strings
    rank = stable_order([k[:, 0].astype(_U) for k in keys_of(rows, width)])
    rows, sizes = rows[rank], sizes[rank]
    whole = np.arange(most) < sizes[:, None]
    string, offset = np.nonzero(whole)
    keys = [k[whole].astype(_U) for k in keys_of(rows, width)]
    before = np.full((n, most), END, np.uint8)
    before[:, 1:] = rows[:, : most - 1]
    order = stable_order(keys)
    fresh = np.zeros(len(order), bool)
    for k, key in enumerate(keys[: -(-depth // 8)]):
        sorted_key = key[order] >> _U(8 * max(0, 8 * (k + 1) - depth))
        fresh[1:] |= sorted_key[1:] != sorted_key[:-1]
    return rank, string[order].astype(np.int32), offset[order].astype(np.int32), before[whole][order], np.cumsum(fresh, dtype=np.int32)


def walk(symbols: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of transforms that lie one behind the other: the row of the suffix one symbol longer, the string that the
    row is in, counted over all shards, and how many symbols of the string follow the row's first, END included."""
    order = np.argsort(symbols, kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    kind = np.int32 if len(symbols) < 2**31 else np.int64
    longer = np.empty(len(symbols), kind)
    longer[order] = np.arange(len(symbols), dtype=kind)
    row = longer[symbols == END]  # rows of ENDs, in the order of their strings: the rows of whole strings lead to them
    string, after = np.empty(len(symbols), kind), np.empty(len(symbols), np.int16)
    number, far = np.arange(len(row), dtype=kind), 0
    while len(row):
        string[row], after[row] = number, far
        on = symbols[row] != END
        row, number, far = longer[row[on]], number[on], far + 1
    return longer, string, after


def merge_transforms(symbols: np.ndarray, longer: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards in the order of `depth` symbols, and how many symbols each shares with the one before, `depth` at most.

    The interleave begins as the shards one behind the other. Rows of one shard never overtake each other.
    """
    rows = np.arange(len(symbols), dtype=longer.dtype)
    common = np.full(len(rows), depth, np.int16)
    common[:1] = 0
    block = np.zeros(len(rows), np.int32)
    for h in range(depth):
        read = symbols[rows]
        order = np.argsort(read, kind="stable").astype(longer.dtype)
        first, old = read[order], block[order]
        rows = longer[rows[order]]
        fresh = (first[1:] != first[:-1]) | (old[1:] != old[:-1])
        block = np.zeros_like(block)
        np.cumsum(fresh, out=block[1:])
        common[1:][fresh & (common[1:] == depth)] = h
        if len(block) and block[-1] == len(block) - 1:  # all told apart: further symbols change nothing
            break
    return rows, common


def places(names: np.ndarray, docs: np.ndarray, cores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of strings by the names of their cores and where they stand, and the numbers of the names."""
    order = stable_order([names[:, 0], names[:, 1], docs, cores])
    rank, name = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sorted_names = names[order]
    fresh = np.zeros(len(order), bool)
    fresh[1:] = (sorted_names[1:] != sorted_names[:-1]).any(1)
    name[order] = np.cumsum(fresh)
    return rank, name


def repeats(block: np.ndarray, rank: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which windows also start earlier, from their blocks and their strings' ranks and names: windows are equal if their blocks and
    names are. MARK is at one offset in equal windows, so that where their strings stand says which is first."""
    some = np.flatnonzero(np.bincount(block)[block] > 1) if len(block) else np.zeros(0, np.int64)
    span = int(rank.max()) + 1 if len(rank) else 1
    order = some[np.argsort(block[some].astype(np.int64) * span + rank[some])]
    b, n = block[order], name[order]
    out = np.zeros(len(block), bool)
    out[order[1:]] = (b[1:] == b[:-1]) & (n[1:] == n[:-1])
    return out


def shard_of(strings: np.ndarray, sizes: np.ndarray, high: np.ndarray, names: np.ndarray, cores: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """A shard's transform without the strings whose windows all repeat earlier ones of the shard. Strings stand in the order of their cores.

    Gives the repeated windows' begins, then the rows left (their strings, the symbols before them) and the numbers of the strings
    left, in the order of the transform's ENDs.
    """
    depth = step + 1
    rank, string, offset, symbols, block = shard_transform(strings, sizes, depth)
    held = high[rank][string]
    window = np.flatnonzero((offset <= held) & (offset + depth < sizes[rank][string]) & (offset + depth > held))
    of = rank[string[window]]
    by_place, name = places(names, np.zeros(len(names), np.int8), cores)
    again = repeats(block[window], by_place[of], name[of])
    left = np.zeros(len(strings), bool)
    left[of[~again]] = True
    rows = left[rank][string]
    number = np.cumsum(left[rank]) - 1
    gone = window[again]
    return cores[of[again]] - held[gone] + offset[gone], number[string[rows]], symbols[rows], rank[left[rank]]


def merged_repeats(symbols: np.ndarray, shard: np.ndarray, names: np.ndarray, docs: np.ndarray, cores: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings and begins of the windows that also start earlier, from the transforms of shards that lie one behind the other.

    names, docs and cores of the strings: of each shard in the order of its ENDs.
    """
    longer, string, after = walk(symbols, shard)
    marked = np.empty(len(names), np.int16)
    first = np.empty(len(symbols), np.uint8)
    first[longer] = symbols
    marked[string[first == MARK]] = after[first == MARK]
    rank, name = places(names, docs, cores)
    # Rows of some strings alone are transforms too. Cores that no other string has are left out, and cores with one
    # name stay together, so that parts of the strings are merged by themselves.
    parts = max(1, len(symbols) // SYMBOLS)
    part = (names[:, 1] % _U(parts)).astype(np.uint16 if parts < 2**16 else np.int64)
    part = part[string]
    some = np.flatnonzero(np.bincount(name)[name][string] > 1)
    by_part = some[np.argsort(part[some], kind="stable")]
    bound = np.searchsorted(part[by_part], np.arange(parts + 1))
    place = np.empty(len(symbols), longer.dtype)
    place[by_part] = np.arange(len(by_part), dtype=longer.dtype)
    depth, found = step + 1, []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        own = by_part[a:b]
        rows, common = merge_transforms(symbols[own], place[longer[own]] - longer.dtype.type(a), depth)
        rows, block = own[rows], np.cumsum(common < depth, dtype=np.int32)
        of = string[rows]
        end = marked[of]
        before = after[rows] - end  # bytes before the core
        window = np.flatnonzero((before >= 0) & (before <= step) & (end - 1 >= step - before))
        of, before = of[window], before[window]
        again = repeats(block[window], rank[of], name[of])
        found.append((of[again], cores[of[again]] - before[again]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def distinct(strings: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which strings are the first of their kind: equal ones have equal symbols and names of their cores."""
    n, most = strings.shape
    width = -(-most // 8) * 8
    rows = np.zeros((n, width), np.uint8)
    rows[:, :most] = strings
    h = names[:, 0].copy()
    for k, key in enumerate(rows.view(_U).T):
        h = mix(h * _MULT[k] + key)
    order = stable_order([h])
    # Strings that only have the hash in common are told apart by all that they are; at worst equal ones stay twice.
    same = (names[order[1:]] == names[order[:-1]]).all(1) & (rows[order[1:]] == rows[order[:-1]]).all(1)
    out = np.ones(n, bool)
    out[order[1:][same]] = False
    return out


def runs(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end), those that touch or overlap as one."""
    order = np.lexsort((starts, docs))
    d, s, e = docs[order], starts[order], ends[order]
    if not len(d):
        return d, s, e
    fresh = np.concatenate([[True], d[1:] != d[:-1]])
    room = int(e.max()) + 1
    reach = np.maximum.accumulate((np.cumsum(fresh) - 1) * room + e) - (np.cumsum(fresh) - 1) * room  # within the document
    head = np.flatnonzero(fresh | np.concatenate([[True], s[1:] > reach[:-1]]))
    return d[head], s[head], reach[np.append(head[1:], len(d)) - 1]


def cut_part(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Removed bytes, spans and what is left of documents that lie one behind the other; spans may overlap and leave their document."""
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, np.maximum(bounds[doc] + s, bounds[doc]), 1)
    np.add.at(step, np.minimum(bounds[doc] + e, bounds[doc + 1]), -1)
    gone = np.cumsum(step[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    rise[inner] = gone[inner]
    rises = np.concatenate([[0], np.cumsum(rise, dtype=np.int64)])
    left, raw = bounds - total[bounds], data[~gone].tobytes()
    return np.diff(total[bounds]), np.diff(rises[bounds]), [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]


def _spans(g: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Rows (g, kind, blob) of spans, one for each group of documents."""
    if not len(g):
        return []
    order = np.lexsort((starts, docs, g))
    g, docs, starts, ends = g[order], docs[order], starts[order], ends[order]
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return [(int(g[a]), "span", docs[a:b].astype("<i8").tobytes() + starts[a:b].astype("<i4").tobytes() + ends[a:b].astype("<i4").tobytes()) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(g)], strict=True)]


def _read_spans(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 16
    return np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "<i4", n, 8 * n).astype(np.int64), np.frombuffer(blob, "<i4", n, 12 * n).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, blob[at:]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, as_text: bool = False, carry: Sequence[str] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, `kept` (its remaining bytes, or their whole characters
    as text), and a struct `rest` of the columns to be carried, if any."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] * bool(carry))
    rest = ["rest"] * bool(carry)
    rest_type = to_arrow_type(docs.schema["rest"].dataType) if carry else None
    groups = groups_for(spark, docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], group_bytes)
    slices = groups  # of the anchors' hashes, and of the cores' names
    side = length - gram
    blob_kind = "g int, kind string, data binary"
    bounds_of_slices = (np.arange(1, slices, dtype=np.float64) / slices * 2.0**ANCHOR_BITS).astype(_U)

    def blobs(rows: list[tuple], first: str = "g") -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary()))], [first, "kind", "data"])

    def bytes_of(texts: pa.Table, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in rising order, all bytes, bounds, the rows' numbers, and which rows have the text that stands for their id.

        Only one row for each id is given unless every row is asked for.
        """
        ids = texts["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        same = np.ones(len(ids), bool)
        if (ids[order][1:] == ids[order][:-1]).any():
            strings = texts["text"].cast(pa.binary()).to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], -len(strings[i]), strings[i])))
            first = np.searchsorted(ids[order], ids[order])
            same = np.array([strings[i] == strings[order[f]] for i, f in zip(order.tolist(), first.tolist(), strict=True)])
            if not every:
                order = order[first == np.arange(len(first))]
                same = np.ones(len(order), bool)
        data, bounds = flat_bytes(texts["text"].take(pa.array(order)))
        return ids[order], data, bounds, order, same

    def anchors_of(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Shortened hashes and places of the anchors of a group's documents, and by how many bytes their windows begin before them."""
        found = []
        for first, last, lo, hi, keep_lo, keep_hi in pieces(bounds, CHUNK, length + side):
            at, h, low, high = anchors(data[lo:hi], np.clip(bounds[first : last + 1], lo, hi) - lo, length, gram)
            own = (at + lo >= keep_lo) & (at + lo < keep_hi)
            # Anchors have small hashes: mixed again, they spread over all slices.
            found.append([mix(h[own] * _MULT[8]) >> _U(64 - ANCHOR_BITS), at[own] + lo, low[own], high[own]])
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    @trimmed
    def find(texts: pa.Table) -> pa.Table:
        """A group's distinct anchors for the slices, and how often those occur that occur again."""
        _, data, bounds, _, _ = bytes_of(texts)
        keys, n = counted(np.sort(anchors_of(data, bounds)[0]))
        cut, out = np.searchsorted(keys, bounds_of_slices), []
        source = np.array([texts["g"][0].as_py()], "<i4").tobytes()
        for b, (k, m) in enumerate(zip(np.split(keys, cut), np.split(n, cut), strict=True)):
            if len(k):
                often = np.flatnonzero(m > 1)
                out.append((b, "anchor", source + pack_sorted(k) + often.astype("<u4").tobytes() + np.minimum(m[often], 2**32 - 1).astype("<u4").tobytes()))
        return blobs(out, "b")

    @trimmed
    def meet(slice_: pa.Table) -> pa.Table:
        """For each group, a bit for each of its anchors of a slice, in their order: whether it occurs again anywhere; and the numbers of hot ones."""
        b, sources, keys, many = slice_["b"][0].as_py(), [], [], []
        for data in slice_["data"].to_pylist():
            k, rest = unpack_sorted(data[4:])
            n, often = np.ones(len(k), np.int64), np.frombuffer(rest, "<u4")
            n[often[: len(often) // 2]] = often[len(often) // 2 :]
            sources.append(int(np.frombuffer(data, "<i4", 1)[0]))
            keys.append(k)
            many.append(n)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        k = flat[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.empty(len(k), np.int64)
        total[order] = np.repeat(np.add.reduceat(np.concatenate(many)[order], head), np.diff(np.append(head, len(k))))
        out = []
        for g, n in zip(sources, np.split(total, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
            bits, hot = np.packbits(n > 1), np.flatnonzero(n >= HOT)
            out.append((g, "bits", np.array([b, len(n)], "<i4").tobytes() + bits.tobytes() + hot.astype("<u4").tobytes()))
        return blobs(out)

    @trimmed
    def shard(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Transforms of a group's strings for the slices, and spans of what repeats inside the group."""
        if not texts.num_rows:
            return blobs([], "b")
        g = texts["g"][0].as_py()
        ids, data, bounds, _, _ = bytes_of(texts)
        key, at, low, high = anchors_of(data, bounds)
        keys, _ = counted(np.sort(key))
        again, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        starts = np.concatenate([[0], np.searchsorted(keys, bounds_of_slices)])
        for blob in values(asked, "data"):
            b, n = np.frombuffer(blob, "<i4", 2).tolist()
            size = -(-n // 8)
            again[starts[b] : starts[b] + n] = np.unpackbits(np.frombuffer(blob, np.uint8, size, 8), count=n)
            hot[starts[b] + np.frombuffer(blob[8 + size :], "<u4")] = True
        number = np.searchsorted(keys, key)
        source, out, spans = np.array([g], "<i4").tobytes(), [], []
        for own, width in ((again & ~hot, step), (again & hot, 0)):
            chosen = own[number]
            core, i, j = bands(at[chosen], low[chosen], high[chosen], side, width)
            by_core = np.argsort(core, kind="stable")
            core, i, j = core[by_core], i[by_core], j[by_core]
            names = np.concatenate([core_names(data, core[a : a + STRINGS], length - width) for a in range(0, len(core), STRINGS)] or [np.zeros((0, 2), _U)])
            # Ranges of the names are shards by themselves: shares of a slice are in one or two of them.
            ranges = max(1, -(-len(core) // STRINGS))
            part = dealt(names[:, 0], ranges)
            by_part = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by_part], np.arange(ranges + 1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b > a:
                    some = by_part[a:b]
                    strings, sizes = strings_of(data, core[some], i[some], j[some], length - width, width)
                    kinds = distinct(strings, names[some])
                    again = some[~kinds]
                    spans.append((core[again] - j[again], core[again] - i[again] + length))
                    some = some[kinds]
                    begin, string, symbols, left = shard_of(strings[kinds], sizes[kinds], j[some], names[some], core[some], width)
                    spans.append((begin, begin + length))
                    # Rows of a slice's strings alone are its transform.
                    slice_of = dealt(names[some[left], 0], slices * SHARES)
                    order, rows = np.argsort(slice_of, kind="stable"), np.argsort(slice_of[string], kind="stable")
                    left = some[left[order]]
                    edge = np.flatnonzero(np.diff(slice_of[order], prepend=-1))
                    ends, last = np.append(edge[1:], len(order)), np.searchsorted(slice_of[string][rows], slice_of[order[edge]], side="right")
                    doc = np.searchsorted(bounds, core[left], side="right") - 1
                    packed = np.ascontiguousarray(names[left]).view("V16").reshape(-1), ids[doc].astype("<i8"), (core[left] - bounds[doc]).astype("<i4")
                    symbols, parcels = symbols[rows].tobytes(), {}
                    for lo, hi, r_lo, r_hi in zip(edge.tolist(), ends.tolist(), [0, *last[:-1].tolist()], last.tolist(), strict=True):
                        slice_, share = divmod(int(slice_of[order[lo]]), SHARES)
                        parcel = _pack(*(x[lo:hi] for x in packed)) + symbols[r_lo:r_hi]
                        parcels.setdefault(slice_, []).append(np.array([share, len(parcel)], "<u4").tobytes() + parcel)
                    out += [(slice_, "shard" if width else "hot", source + b"".join(x)) for slice_, x in parcels.items()]
        if spans:
            s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
            doc = np.searchsorted(bounds, s, side="right") - 1
            d, s, e = runs(doc, s - bounds[doc], e - bounds[doc])
            out += [((g + n) * 7919 % slices, kind, source + blob) for n, (_, kind, blob) in enumerate(_spans(np.full(len(d), g), ids[d], s, e))]
        return blobs(out, "b")

    @trimmed
    def merge(slice_: pa.Table) -> pa.Table:
        """Spans of what repeats among the shards of a slice; spans pass."""
        rows = []
        kinds, found = slice_["kind"].to_pylist(), slice_["data"].to_pylist()
        rows += [(int(np.frombuffer(data, "<i4", 1)[0]), kind, data[4:]) for kind, data in zip(kinds, found, strict=True) if kind == "span"]
        shares: dict[tuple, list] = {}
        repeated = []
        for kind, data in zip(kinds, found, strict=True):
            g, at = int(np.frombuffer(data, "<i4", 1)[0]), 4
            while kind != "span" and at < len(data):
                share, size = np.frombuffer(data, "<u4", 2, at).tolist()
                shares.setdefault((kind, share), []).append((g, data[at + 8 : at + 8 + size]))
                at += 8 + size
        for kind, share in sorted(shares):
            width, parts, symbols, groups_of = step if kind == "shard" else 0, [], [], []
            for g, parcel in shares.pop((kind, share)):
                columns, rest = _unpack(parcel, "V16", "<i8", "<i4")
                parts.append(columns)
                symbols.append(np.frombuffer(rest, np.uint8))
                groups_of.append(g)
            if parts:
                names, d, core = (np.concatenate(x) for x in zip(*parts, strict=True))
                g = np.repeat(groups_of, [len(x[0]) for x in parts])
                of = np.repeat(np.arange(len(parts), dtype=np.uint16 if len(parts) < 2**16 else np.int64), [len(x) for x in symbols])
                string, begin = merged_repeats(np.concatenate(symbols), of, names.view("<u8").reshape(-1, 2), d, core.astype(np.int64), width)
                doc, s, e = runs(d[string], begin, begin + length)
                known, at = np.unique(d, return_index=True)
                repeated.append((g[at[np.searchsorted(known, doc)]], doc, s, e))
        if repeated:
            rows += _spans(*(np.concatenate(x) for x in zip(*repeated, strict=True)))
        return blobs(rows)

    @trimmed
    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        """What is left of a group's documents."""
        columns: list[list] = [[], [], [], [], []]
        order = np.zeros(0, np.int64)
        if texts.num_rows:
            ids, data, bounds, order, same = bytes_of(texts, every=True)
            parts = [_read_spans(x) for x in values(spans, "data")]
            d, s, e = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
            head = np.searchsorted(ids, d)
            rows = np.searchsorted(ids, d, side="right") - head  # over 1 only where an id repeats
            doc = np.repeat(head, rows) + np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
            s, e = np.repeat(s, rows)[same[doc]], np.repeat(e, rows)[same[doc]]
            doc = doc[same[doc]]
            by_doc = np.argsort(doc, kind="stable")
            doc, s, e = doc[by_doc], s[by_doc], e[by_doc]
            parts = []
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + CHUNK, side="right")) - 1)
                own = slice(*np.searchsorted(doc, [begin, end]))
                parts.append(cut_part(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin], doc[own] - begin, s[own], e[own]))
                begin = end
            columns = [ids, np.diff(bounds), np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), [k.decode("utf-8", "ignore").encode() if as_text else k for x in parts for k in x[2]]]
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        carried = texts["rest"].take(pa.array(order)) if carry and texts.num_rows else pa.array([], rest_type) if carry else None
        return pa.table([*made, carried] if carry else made, ["id", "n_bytes", "n_removed", "n_spans", "kept"] + ["rest"] * bool(carry))

    grouped = docs.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "id", "text", *rest).repartition(groups, "g")
    slice_kind = blob_kind.replace("g int", "b int")
    asked = grouped.groupBy("g").applyInArrow(find, slice_kind).repartition(slices, "b").groupBy("b").applyInArrow(meet, blob_kind)
    shards = grouped.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(shard, slice_kind)
    spans = shards.repartition(slices, "b").groupBy("b").applyInArrow(merge, blob_kind)
    out = grouped.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary" + (f", rest {docs.schema['rest'].dataType.simpleString()}" if carry else ""))
    whole = F.col("text").cast("binary")
    alone = docs.where("id is null").select("id", F.length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), whole.alias("kept"), *rest)
    out = out.unionByName(alone).withColumnRenamed("id", key)
    return out.withColumn("kept", F.col("kept").cast("string")) if as_text else out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and kept bytes of a small table, by a set of all strings."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                gone[at : at + length] = True
            else:
                seen.add(string)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out
