"""A FLAC reader that goes bit by bit, written from the format's public description alone: it shares nothing with the operator's."""

import hashlib


class Bits:
    def __init__(self, data, at=0):
        self.data, self.at = data, 8 * at

    def read(self, width):
        value = 0
        for _ in range(width):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def signed(self, width):
        value = self.read(width)
        return value - (1 << width) if width and value >> (width - 1) else value

    def unary(self):
        n = 0
        while not self.read(1):
            n += 1
        return n


def crc(data, width, poly):
    value, top = 0, 1 << (width - 1)
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value & top else 0)) & ((1 << width) - 1)
    return value


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def subframe(bits, size, depth):
    assert bits.read(1) == 0
    kind = bits.read(6)
    wasted = bits.unary() + 1 if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        return [bits.signed(depth) << wasted] * size
    if kind == 1:
        return [bits.signed(depth) << wasted for _ in range(size)]
    order = kind - 8 if 8 <= kind <= 12 else kind - 31
    assert 8 <= kind <= 12 or kind >= 32
    x = [bits.signed(depth) for _ in range(order)]
    weights, shift = FIXED.get(order), 0
    if kind >= 32:
        precision, shift = bits.read(4) + 1, bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)]
    method, partitions = bits.read(2), 1 << bits.read(4)
    assert method in (0, 1)
    width = 4 if method == 0 else 5
    for part in range(partitions):
        rice = bits.read(width)
        plain = bits.read(5) if rice == (1 << width) - 1 else None
        for _ in range(size // partitions - (order if part == 0 else 0)):
            if plain is None:
                folded = bits.unary() << rice | bits.read(rice)
                residual = folded >> 1 if folded % 2 == 0 else -(folded >> 1) - 1
            else:
                residual = bits.signed(plain)
            x.append(residual + (sum(w * v for w, v in zip(weights, x[::-1])) >> shift))
    return [v << wasted for v in x]


def decode(stream):
    """Samples, seek points (sample, offset, size), and the places of the frames by their first sample; all checksums are verified."""
    assert stream[:4] == b"fLaC"
    at, last, info, points = 4, 0, None, []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            head = Bits(block)
            low, high, _, _ = head.read(16), head.read(16), head.read(24), head.read(24)
            info = {"rate": head.read(20), "channels": head.read(3) + 1, "depth": head.read(5) + 1, "total": head.read(36), "md5": block[18:34], "low": low, "high": high}
        if kind == 3:
            points = [(int.from_bytes(block[p : p + 8], "big"), int.from_bytes(block[p + 8 : p + 16], "big"), int.from_bytes(block[p + 16 : p + 18], "big")) for p in range(0, size, 18)]
        at += 4 + size
    frames, samples, places = at, [], {}
    while at < len(stream):
        bits = Bits(stream, at)
        assert bits.read(14) == 0x3FFE and bits.read(1) == 0 and bits.read(1) == 0  # fixed block size: frames are numbered
        size_code, _, channels, _, reserved = bits.read(4), bits.read(4), bits.read(4), bits.read(3), bits.read(1)
        assert channels == 0 and reserved == 0
        first = bits.read(8)
        ones = 8 - (first ^ 0xFF).bit_length()
        number = first & (0x7F >> ones) if ones else first
        for _ in range(max(0, ones - 1)):
            number = number << 6 | bits.read(8) & 0x3F
        size = {1: 192, 6: None, 7: None}.get(size_code, 576 << size_code - 2 if 2 <= size_code <= 5 else 256 << size_code - 8 if size_code >= 8 else None)
        size = bits.read(8) + 1 if size_code == 6 else bits.read(16) + 1 if size_code == 7 else size
        assert bits.read(8) == crc(stream[at : (bits.at >> 3) - 1], 8, 0x07)
        places[number * size] = at - frames
        samples += subframe(bits, size, info["depth"])
        bits.at += -bits.at % 8
        end = bits.at >> 3
        assert int.from_bytes(stream[end : end + 2], "big") == crc(stream[at:end], 16, 0x8005)
        assert len(places) == number + 1
        at = end + 2
    assert info["channels"] == 1 and info["depth"] == 8 and len(samples) == info["total"]
    assert hashlib.md5(bytes(v & 0xFF for v in samples)).digest() == info["md5"]
    return samples, points, places
