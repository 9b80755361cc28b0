"""FLAC media columns: a lossless writer and a checking reader for 8-bit mono streams.

Streams hold STREAMINFO (with the MD5 of the samples), a SEEKTABLE with a point every SEEK_FRAMES frames, and
frames of 576 samples: constant, verbatim, fixed predictors of order 0 to 4 or a quantised linear predictor of
order LPC_ORDER, residuals Rice-coded in one partition. The reader finds frames by sync code, header CRC-8 and
running number, verifies each frame's CRC-16 and the MD5, decodes Rice residuals and inverts the predictors.
Both work on many frames at once: step i of every frame of a chunk is one array operation.

`encode_payloads` accepts any bytes whose length is a positive multiple of 576; `to_payload` pads a text so (null
counts as empty). A damaged stream raises ValueError. Equal payloads give equal streams. Repeated rows give
repeated results; further columns are not read; an empty table gives an empty result. A text of any length is one
stream, worked on in chunks of frames. Of predictors that cost the same, the simplest is taken.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import byte_list, small_batches, table
from gleaner.operators.sizes import spread

BLOCK = 576
PAD = 255
RATE = 8000
CHUNK = 2048
SEEK_FRAMES = 16
LPC_ORDER = 4
LPC_PRECISION = 12
MOST_RICE = 14
BATCH_BYTES = 1_200_000

CONSTANT, VERBATIM, FIXED, LPC = -2, -1, 0, 5  # kinds; FIXED + order; LPC


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-8 of the first `lengths` bytes of each row."""
    out = np.zeros(len(rows), np.uint8)
    for i in range(int(lengths.max(initial=0))):
        out = np.where(i < lengths, CRC8[out ^ rows[:, i]], out)
    return out


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of stretches of `data`, all at once; the longest come first while they last."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    crc = np.zeros(len(order), np.uint16)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for i, n in enumerate(active.tolist()):
        now = crc[:n]
        crc[:n] = CRC16[(now >> 8) ^ data[begin[:n] + i]] ^ (now << 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code: rows of up to 6 bytes, and how many count."""
    rows, size = np.zeros((len(numbers), 6), np.uint8), np.ones(len(numbers), np.int64)
    for n, limit in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21), (6, 1 << 26)):
        size[numbers >= limit] = n
    one = size == 1
    rows[one, 0] = numbers[one]
    for n in range(2, 7):
        at = np.flatnonzero(size == n)
        if len(at):
            value = numbers[at]
            for j in range(n - 1, 0, -1):
                rows[at, j] = 0x80 | (value & 0x3F)
                value = value >> 6
            rows[at, 0] = ((0xFF << (8 - n)) & 0xFF) | value
    return rows, size


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of a linear predictor for each row, by Levinson's recursion on exact sums."""
    r = [np.einsum("ij,ij->i", x[:, lag:], x[:, : x.shape[1] - lag]).astype(np.float64) for lag in range(LPC_ORDER + 1)]
    a = np.zeros((LPC_ORDER, len(x)))
    error = r[0] + 1e-9
    for i in range(LPC_ORDER):
        k = r[i + 1].copy()
        for j in range(i):
            k -= a[j] * r[i - j]
        k /= error
        before = a[:i].copy()
        for j in range(i):
            a[j] = before[j] - k * before[i - 1 - j]
        a[i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(0), 1e-9)
    shift = np.clip(LPC_PRECISION - 1 - np.ceil(np.log2(largest) + 1e-9), 0, 14).astype(np.int32)
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift).astype(np.float64)), -most, most).astype(np.int32), shift


def _lpc_residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    guess = np.zeros((len(x), x.shape[1] - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        guess += coefs[j][:, None] * x[:, LPC_ORDER - 1 - j : x.shape[1] - 1 - j]
    return x[:, LPC_ORDER:] - (guess >> shift[:, None])


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of 576 signed samples: all bytes, and each frame's length."""
    n = len(x)
    x = x.astype(np.int32)
    residuals = {FIXED: x}
    for order in range(1, 5):
        residuals[FIXED + order] = np.diff(residuals[FIXED + order - 1], axis=1)
    coefs, shift = _predictors(x)
    residuals[LPC] = _lpc_residual(x, coefs, shift)
    extra = {FIXED + o: 8 * o for o in range(5)} | {LPC: 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER}
    cost = np.full((6, n), np.inf)
    for kind, e in residuals.items():
        mean = np.abs(e).mean(1)
        cost[kind] = extra[kind] + e.shape[1] * (np.log2(mean + 0.5) + 2.0)
    kind = cost.argmin(0)
    rice, bits_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    codes: dict[int, np.ndarray] = {}
    for k in range(6):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            e = residuals[k][rows]
            u = ((e << 1) ^ (e >> 31)).astype(np.int32)
            guess = np.clip(np.floor(np.log2(np.maximum(u.mean(1) * math.log(2), 1e-9))), 0, MOST_RICE - 1).astype(np.int32)
            options = [(u >> (guess + d)[:, None]).sum(1, dtype=np.int64) + u.shape[1] * (1 + guess + d) for d in (0, 1)]
            rice[rows] = guess + (options[1] < options[0])
            bits_of[rows] = 8 + extra[k] + 10 + np.minimum(*options)
            codes[k] = u
    kind[bits_of >= 8 + 8 * BLOCK] = VERBATIM
    kind[(x == x[:, :1]).all(1)] = CONSTANT
    bits_of[kind == VERBATIM], bits_of[kind == CONSTANT] = 8 + 8 * BLOCK, 16

    number, number_size = _number_bytes(numbers)
    head = np.zeros((n, 10), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x24, 0x02)  # fixed blocks, 576 samples, 8 kHz, mono, 8 bits
    head[:, 4:] = number
    head_size = 4 + number_size
    check = crc8(head, head_size)
    body = (bits_of + 7) // 8
    size = head_size + 1 + body + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    at = (start[:-1] + head_size + 1) * 8

    rows = np.flatnonzero(kind == CONSTANT)
    _put(bits, at[rows], 0, 8)
    _put(bits, at[rows] + 8, x[rows, 0] & 0xFF, 8)
    rows = np.flatnonzero(kind == VERBATIM)
    _put(bits, at[rows], 1 << 1, 8)
    _put(bits, at[rows][:, None] + 8 + 8 * np.arange(BLOCK), x[rows] & 0xFF, 8)
    for k in range(6):
        all_rows = np.flatnonzero(cost.argmin(0) == k) if k in codes else np.zeros(0, np.int64)
        chosen = kind[all_rows] == k
        rows = all_rows[chosen]
        if not len(rows):
            continue
        order = LPC_ORDER if k == LPC else k
        _put(bits, at[rows], (0b100000 | (LPC_ORDER - 1)) << 1 if k == LPC else (0b001000 | order) << 1, 8)
        p = at[rows] + 8
        for j in range(order):
            _put(bits, p, x[rows, j] & 0xFF, 8)
            p = p + 8
        if k == LPC:
            _put(bits, p, LPC_PRECISION - 1, 4)
            _put(bits, p + 4, shift[rows], 5)
            p = p + 9
            for j in range(order):
                _put(bits, p, coefs[j][rows] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
                p = p + LPC_PRECISION
        _put(bits, p + 6, rice[rows], 4)
        p = p + 10
        u = codes[k][chosen]
        for r in np.unique(rice[rows]).tolist():
            same = rice[rows] == r
            v = u[same]
            q = v >> r
            ends = np.cumsum(q + (1 + r), axis=1, dtype=np.int64) + p[same][:, None]
            ends -= r
            bits[ends - 1] = 1
            for j in range(r):
                bits[ends + j] = (v >> (r - 1 - j)) & 1
    out = np.packbits(bits)
    for j in range(10):
        rows = head_size > j
        out[start[:-1][rows] + j] = head[rows, j]
    out[start[:-1] + head_size] = check
    crc = crc16(out, start[:-1], size - 2)
    out[start[1:] - 2], out[start[1:] - 1] = crc >> 8, crc & 0xFF
    return out, size


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; samples are the bytes less 128."""
    frames = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError("payloads are positive multiples of 576 bytes")
    first = np.concatenate([[0], np.cumsum(frames)])
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    parts, sizes = [], []
    for begin in range(0, len(samples), CHUNK):
        data, size = encode_frames(samples[begin : begin + CHUNK], numbers[begin : begin + CHUNK])
        parts.append(data)
        sizes.append(size)
    data, size = np.concatenate(parts).tobytes(), np.concatenate(sizes)
    start = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i, payload in enumerate(payloads):
        own = size[first[i] : first[i + 1]]
        total = len(payload)
        md5 = hashlib.md5(samples[first[i] : first[i + 1]].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | total).to_bytes(8, "big") + md5
        offsets = np.concatenate([[0], np.cumsum(own)])
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(offsets[j]), BLOCK) for j in range(0, len(own), SEEK_FRAMES))
        blocks = b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + blocks + data[start[first[i]] : start[first[i + 1]]])
    return out


def read_header(stream: bytes) -> dict:
    """STREAMINFO, seek points (sample, offset) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"points": []}
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">HH", body[:4]), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 0x7F == 3:
            out["points"] = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, len(body), 18)]
        at += 4 + size
    if out.get("block") != (BLOCK, BLOCK) or out["channels"] != 1 or out["bits"] != 8:
        raise ValueError("only 8-bit mono streams of 576-sample blocks are read")
    return out | {"frames": at}


def find_frames(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, header sizes and numbers of places that look like frames: sync code, known fields, right CRC-8."""
    at = np.flatnonzero((data[:-4] == 0xFF) & (data[1:-3] == 0xF8) & (data[2:-2] == 0x24) & (data[3:-1] == 0x02)) if len(data) > 4 else np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    rows = padded[at[:, None] + np.arange(11)]
    lead = rows[:, 4]
    size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 0, 2, 3, 4, 5], 6)
    number = np.where(size == 1, lead, lead & (0xFF >> (size + 1))).astype(np.int64)
    for j in range(1, 6):
        number = np.where(j < size, number << 6 | (rows[:, 4 + j] & 0x3F), number)
    good = (size > 0) & (crc8(rows, 4 + size) == rows[np.arange(len(at)), 4 + size])
    return at[good], 5 + size[good], number[good]


def decode_frames(data: np.ndarray, starts: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of 576 samples of frames at known places, their CRC-16 verified."""
    crc = crc16(data, starts, ends - starts - 2)
    if (crc != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    n = len(starts)
    low = int(starts.min())
    part = np.concatenate([data[low : int(ends.max())], np.zeros(8, np.uint8)])
    bits = np.unpackbits(part)
    wide = part.astype(np.int32)
    window = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]

    def read(p: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return (window[p >> 3] >> (24 - (p & 7) - width)) & ((1 << width) - 1)

    signed = lambda v, width: v - ((v >> (width - 1)) << width)
    at = (starts - low + heads) * 8
    code = read(at, 8) >> 1
    at = at + 8
    out = np.zeros((BLOCK, n), np.int32)
    rows = np.flatnonzero(code == 0)
    out[:, rows] = signed(read(at[rows], 8), 8)
    rows = np.flatnonzero(code == 1)
    if len(rows):
        out[:, rows] = signed(read(at[rows] + 8 * np.arange(BLOCK)[:, None], 8), 8)
    order = np.select([code < 2, (code >= 8) & (code <= 12), code >= 32], [-1, code - 8, code - 31], -2)
    if (order == -2).any():
        raise ValueError("a subframe's type is unknown")
    rows = np.flatnonzero(order >= 0)
    rows = rows[np.argsort(order[rows], kind="stable")]  # those with the most residuals first
    if len(rows):
        p, o, linear = at[rows].copy(), order[rows], code[rows] >= 32
        for j in range(int(o.max())):
            has = j < o
            out[j, rows[has]] = signed(read(p[has], 8), 8)
            p[has] += 8
        coefs, shift = np.zeros((32, len(rows)), np.int32), np.zeros(len(rows), np.int32)
        if linear.any():
            precision = read(p, 4) + 1
            shift[linear] = read(p[linear] + 4, 5)
            p[linear] += 9
            for j in range(int(o.max())):
                has = linear & (j < o)
                coefs[j, has] = signed(read(p[has], precision[has]), precision[has])
                p[has] += precision[has]
        if read(p, 6).any():
            raise ValueError("only one Rice partition of 4-bit parameters is read")
        rice = read(p + 6, 4)
        p = (p + 10).astype(np.int64)
        mask, down = (1 << rice) - 1, 24 - rice
        following = np.where(bits.view(bool), np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
        following = np.minimum.accumulate(following[::-1])[::-1]
        u = np.zeros((BLOCK, len(rows)), np.int32)
        active = np.searchsorted(o, BLOCK - np.arange(BLOCK), side="left")
        for i, a in enumerate(active.tolist()):
            now = p[:a]
            stop = following[now] + 1
            u[i, :a] = (stop - 1 - now << rice[:a]) | ((window[stop >> 3] >> (down[:a] - (stop & 7))) & mask[:a])
            p[:a] = stop + rice[:a]
        e = (u >> 1) ^ -(u & 1)
        for d in np.unique(o).tolist():
            own = np.flatnonzero((o == d) & ~linear)
            if len(own):
                x = e[: BLOCK - d, own]
                warm = out[:d, rows[own]]
                for level in range(d - 1, -1, -1):
                    x = np.cumsum(np.concatenate([np.diff(warm, level, axis=0)[:1], x]), axis=0, dtype=np.int32)
                out[:, rows[own]] = x
            own = np.flatnonzero((o == d) & linear)
            if len(own):
                x, c, s = out[:, rows[own]], coefs[:d, own], shift[own]
                for i in range(d, BLOCK):
                    x[i] = e[i - d, own] + ((c * x[i - d : i][::-1]).sum(0) >> s)
                out[:, rows[own]] = x
    return out.T.astype(np.int8)


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; ValueError if a checksum, a number or the MD5 is wrong."""
    heads = [read_header(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    bound = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    at, size, number = find_frames(data)
    keep_at, keep_size, ends, counts = [], [], [], []
    for i, head in enumerate(heads):
        lo, hi = np.searchsorted(at, [bound[i] + head["frames"], bound[i + 1]])
        need = head["total"] // BLOCK
        a, z, m = at[lo:hi], size[lo:hi], number[lo:hi]
        if not (len(m) == need and (m == np.arange(need)).all()):  # a chance sync code inside a frame: take the numbers in turn
            chosen, want = [], 0
            for j, v in enumerate(m.tolist()):
                if v == want:
                    chosen.append(j)
                    want += 1
            a, z = a[chosen], z[chosen]
        if len(a) != need:
            raise ValueError("frames are missing")
        keep_at.append(a)
        keep_size.append(z)
        ends.append(np.append(a[1:], bound[i + 1]))
        counts.append(need)
    a, z, e = np.concatenate(keep_at), np.concatenate(keep_size), np.concatenate(ends)
    samples = np.concatenate([decode_frames(data, a[i : i + CHUNK], z[i : i + CHUNK], e[i : i + CHUNK]) for i in range(0, len(a), CHUNK)])
    out, first = [], 0
    for head, need in zip(heads, counts, strict=True):
        own = samples[first : first + need]
        if hashlib.md5(own.tobytes()).digest() != head["md5"]:
            raise ValueError("the MD5 of the samples is wrong")
        out.append((own.view(np.uint8) ^ 0x80).tobytes())
        first += need
    return out


def read_samples(stream: bytes, start: int, count: int) -> np.ndarray:
    """Signed samples [start, start + count) of a stream: decoding begins at the last seek point before them."""
    head = read_header(stream)
    start, stop = max(0, start), min(start + count, head["total"])
    if start >= stop:
        return np.zeros(0, np.int8)
    sample, offset = max((p for p in head["points"] if p[0] <= start), default=(0, 0))
    later = min((p[1] for p in head["points"] if p[0] >= stop), default=len(stream) - head["frames"])
    data = np.frombuffer(stream, np.uint8)[head["frames"] + offset : head["frames"] + later]
    at, size, number = find_frames(data)
    want, chosen = sample // BLOCK, []
    for j, v in enumerate(number.tolist()):
        if v == want:
            chosen.append(j)
            want += 1
    at, size = at[chosen], size[chosen]
    rows = decode_frames(data, at, size, np.append(at[1:], len(data)))
    return rows.reshape(-1)[start - sample : stop - sample]


def to_payload(text: bytes) -> bytes:
    """Bytes of a text with PAD behind them up to a positive multiple of 576."""
    return text + bytes([PAD]) * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def features(payload: bytes) -> str:
    """Mean, root mean square, peak and sign changes of the samples read back, from exact sums."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8)
    wide = x.astype(np.int64)
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};mean={int(wide.sum()) / len(x):.6f};rms={math.sqrt(int(wide @ wide) / len(x)):.6f};peak={int(np.abs(wide).max())};crossings={changes}"


def encode_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, `n_bytes` of the text and `media`, the FLAC stream of its payload."""
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, BATCH_BYTES):
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                data = byte_list(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(encode_payloads([to_payload(d) for d in data]), pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {key_type}, n_bytes bigint, media binary")


def digest_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored streams back and gives sizes, digests and features."""
    key_type = media.schema[key].dataType.simpleString()
    kinds = {"n_bytes": ("bigint", pa.int64()), "payload_bytes": ("bigint", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("bigint", pa.int64()), "media_bytes": ("bigint", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string())}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in small_batches(batches, "media", BATCH_BYTES):
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                streams = part.column(2).to_pylist()
                rows = [(n, len(p), sha(p), zlib.crc32(p[-32:]), len(s), sha(s), features(p)) for n, s, p in zip(part.column(1).to_pylist(), streams, decode_streams(streams), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds.values(), strict=True))], [key, *kinds])

    return media.select(key, "n_bytes", "media").mapInArrow(digest, f"`{key}` {key_type}, " + ", ".join(f"{n} {t}" for n, (t, _) in kinds.items()))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_table(encode_table(spread(table(spark, sf_dir, "documents"))))
