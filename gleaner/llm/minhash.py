"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles of five words.

A word is a run of bytes that are not ASCII blanks or punctuation, A-Z lower-cased; a text of fewer than five
words is one shingle. The weight of a shingle in a text is its TF-IDF, tf * (1 + ln((N + s N) / (df + s N))), with N and df counted over
all documents, copies included, s = SMOOTH, and df rounded to the nearest STEPS-th of a doubling. The smoothing counts every shingle in
some more documents: what a few per cent of all documents share is common, and weighs less, but a text that has many near copies doesn't
lose its weight to the edits that tell them apart. Texts are linked if the weighted Jaccard similarity of their
shingles, sum of minima over sum of maxima, is `least` or more; a class is a connected component of links.

Equal texts are one text from the start: each map task sends a text once. The texts are then dealt to groups by
digest, once; there are enough groups for each to hold about GROUP_BYTES of text. Document frequencies travel as
delta-coded blobs (up: all hashes, down: those with df > 1).
BANDS bands of ROWS samples each give buckets. Buckets with the same members count once. Within a bucket a text is
compared with every member of other components, so that no link is lost in a bucket. A bucket over BUCKET_MOST texts
is dealt in blocks that all hold its first LEADERS members; if that leaves it in several components, all but the
largest meet each other and the largest in pairs of blocks, and every pair of different components is compared.

Null text counts as empty. A blank text and a null id are linked with nothing, a text without words with its exact
copies only. Rows that repeat an id count as copies and share its result. Further columns are not read. An empty
table gives an empty result. A text of any length is taken whole; a group holds at least one text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import byte_list, components, counted, deal, groups_for, opened, pack_sorted, table, trimmed, unpack_sorted, values
from gleaner.operators.lineage import checkpoint

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 10, 3
#: Steps of frequency codes for each doubling of df: one byte reaches 2 ** 42 documents.
STEPS = 6
#: Share of all documents added to each document frequency.
SMOOTH = 0.03
BUCKET_MOST, LEADERS = 1024, 64
HASH_BITS = 48
#: Text of a group of texts, about: a task holds it with its shingles, some thirty times as much at the worst. Groups send
#: each other a blob for every slice: with larger executors take larger groups.
GROUP_BYTES = 16_000_000
#: A text with this share of all rows or more is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: Bytes of text whose shingles are worked on at once.
CHUNK = 1_500_000

_U = np.uint64
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_draw = np.random.default_rng(20240501)
_BYTE = _draw.integers(1, 2**63, 256, dtype=_U) | _U(1)
_PLACE = _draw.integers(1, 2**63, 1024, dtype=_U) | _U(1)
_STEP = _draw.integers(1, 2**63, WIDTH, dtype=_U) | _U(1)
_SEEDS = _draw.integers(1, 2**63, BANDS * ROWS, dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _quantiles(n: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """n quantiles of Gamma(2, 1), and their logarithms' mirror: 1 - (1 + x) exp(-x) = u by Newton's method."""
    u = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        e = np.exp(-x)
        x = np.maximum(x - (1 - (1 + x) * e - u) / np.maximum(x * e, 1e-12), 1e-6)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles()


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted 48-bit shingle hashes of each text, repeated as often as the shingle occurs."""
    flat = np.frombuffer(b" ".join([t.translate(_WORD) for t in texts]) + b" ", np.uint8)
    inside = flat != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bound = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bound)
    if not len(starts):
        return [np.zeros(0, _U) for _ in texts]
    place = np.zeros(len(flat), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    value = _BYTE[flat] * _PLACE[place & 1023]
    value[~inside] = 0
    words = mix(np.add.reduceat(value, starts) + (ends - starts).astype(_U))
    n = len(words)
    padded = np.concatenate([words, np.zeros(WIDTH, _U)])
    whole = np.zeros(n, _U)
    for j in range(WIDTH):
        whole += padded[j : j + n] * _STEP[j]
    whole = mix(whole) >> _U(64 - HASH_BITS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.sort(whole[a : b - WIDTH + 1]))
        elif b > a:
            short = (words[a:b] * _STEP[: b - a]).sum(keepdims=True) + _U(b - a)
            out.append(mix(short) >> _U(64 - HASH_BITS))
        else:
            out.append(np.zeros(0, _U))
    return out


def pack_vector(h: np.ndarray, tf: np.ndarray, code: np.ndarray) -> bytes:
    """A text's hashes in six bytes each, frequency codes in one and term frequencies in one, or four if one is large."""
    width = 1 if not len(tf) or tf.max() < 256 else 4
    return bytes([width]) + np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() + code.astype(np.uint8).tobytes() + tf.astype(f"<u{width}").tobytes()


def unpack_vector(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = data[0]
    n = (len(data) - 1) // (7 + width)
    h = np.zeros((n, 8), np.uint8)
    h[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 1).reshape(-1, 6)
    return h.reshape(-1).view("<u8"), np.frombuffer(data, f"<u{width}", n, 1 + 7 * n).astype(np.int64), np.frombuffer(data, np.uint8, n, 1 + 6 * n)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: a row of BANDS * ROWS values for each stretch of elements (none empty)."""
    log_w = np.log(weights).astype(np.float32)
    sizes = np.diff(np.append(starts, len(hashes)))
    out = np.empty((len(starts), len(_SEEDS)), _U)
    for k, seed in enumerate(_SEEDS):
        z = mix(hashes ^ seed)
        r = _GAMMA[(z & _U(0xFFFF)).astype(np.intp)]
        log_c = _LOG_GAMMA[(z >> _U(16) & _U(0xFFFF)).astype(np.intp)]
        beta = (z >> _U(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
        at = hit[np.searchsorted(hit, starts)]
        out[:, k] = mix(hashes[at] ^ mix(t[at].astype(np.int64).view(_U) + seed))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), _U)
    for b in range(BANDS):
        for j in range(ROWS):
            keys[:, b] = mix(keys[:, b] * _U(31) + signatures[:, b * ROWS + j] + _U(b + 1))
    return keys


def weights_of(tf: np.ndarray, code: np.ndarray, n_docs: int) -> np.ndarray:
    """TF-IDF weights from term frequencies and frequency codes."""
    share = np.minimum(2.0 ** (code / STEPS) / max(1, n_docs), 1)
    return tf * (1 + np.log((1 + SMOOTH) / (share + SMOOTH)))


def similarity_row(h: np.ndarray, w: np.ndarray, all_h: np.ndarray, all_w: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of one text with many, whose elements lie one behind the other."""
    at = np.minimum(np.searchsorted(h, all_h), len(h) - 1)
    shared = np.where(h[at] == all_h, np.minimum(w[at], all_w), 0.0)
    both = np.add.reduceat(shared, starts)
    return both / (w.sum() + totals - both)


def bucket_components(vectors: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """The smallest index that each text of a bucket is linked with, directly or not, inside the bucket."""
    n = len(vectors)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.cumsum([0] + [len(h) for h, _ in vectors[:-1]])
    all_h, all_w = np.concatenate([h for h, _ in vectors]), np.concatenate([w for _, w in vectors])
    totals = np.add.reduceat(all_w, starts)
    for i in range(n):
        top = root(0)
        if i and root(i) == top:  # all that it could link outside the first component compare with it in turn
            continue
        linked = np.flatnonzero(similarity_row(*vectors[i], all_h, all_w, starts, totals) >= least)
        for j in linked.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def cross_components(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least: float) -> np.ndarray:
    """Labels of the texts of two blocks, `left` first, after joining those of different labels that are linked: the smaller label stays.

    Texts whose whole weights differ by more than `least` allows are not linked, so a text meets a stretch of `left` by weight.
    """
    n, labels = len(left), labels.copy()
    totals = np.array([w.sum() for _, w in left])
    order = np.argsort(totals, kind="stable")
    totals, sizes = totals[order], np.array([len(left[i][0]) for i in order.tolist()])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    all_h, all_w = np.concatenate([left[i][0] for i in order.tolist()]), np.concatenate([left[i][1] for i in order.tolist()])
    for k, (h, w) in enumerate(right):
        own = w.sum()
        a, b = np.searchsorted(totals, own * least * (1 - 1e-9)), np.searchsorted(totals, own / least * (1 + 1e-9), side="right")
        if a == b or (labels[order[a:b]] == labels[n + k]).all():
            continue
        inside = slice(starts[a], starts[b])
        linked = order[a:b][similarity_row(h, w, all_h[inside], all_w[inside], starts[a:b] - starts[a], totals[a:b]) >= least]
        met = np.unique(np.append(labels[linked], labels[n + k]))
        if len(met) > 1:
            labels[np.isin(labels, met)] = met[0]
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per input row: the key, `class_id` (smallest key of its class) and `kept` (it is that key)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_docs, groups = size["n"], groups_for(spark, size["bytes"], group_bytes)
    slices = max(groups // 4, min(groups, groups_for(spark, 0, group_bytes)))  # of the hashes: smaller than the text

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A map task's distinct texts, and the least id and the number of each, sealed by group."""
        seen: dict[bytes, list] = {}
        for batch in batches:
            fresh, texts = [], []
            for i, data in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), strict=True):
                digest = hashlib.md5(data).digest()
                if (own := seen.get(digest)) is None:
                    seen[digest] = [i, 1]
                    fresh.append(digest)
                    texts.append(data)
                else:
                    own[0], own[1] = min(own[0], i), own[1] + 1
            yield rows(fresh, [None] * len(fresh), [0] * len(fresh), texts)
            if len(seen) > 200_000:
                yield rows(list(seen), [x[0] for x in seen.values()], [x[1] for x in seen.values()], [None] * len(seen))
                seen.clear()
        yield rows(list(seen), [x[0] for x in seen.values()], [x[1] for x in seen.values()], [None] * len(seen))

    def rows(digests: list, ids: list, counts: list, texts: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.binary())], ["digest", "id", "n", "text"])
        group = np.array([int.from_bytes(d[:4], "little") % groups for d in digests], np.int64)
        made = list(deal(batch, group)) if digests else []
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int32()), pa.array([d for _, d in made], pa.binary())], ["g", "texts"])

    def texts_of(sealed_rows: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
        """Least ids, counts and texts of a group, in the order of their digests."""
        table = opened(sealed_rows["texts"].to_pylist())
        found: dict[bytes, list] = {}
        for digest, i, n, data in zip(*(table[c].to_pylist() for c in ("digest", "id", "n", "text")), strict=True):
            own = found.setdefault(digest, [None, 0, None])
            if i is not None:
                own[0] = i if own[0] is None else min(own[0], i)
            own[1] += n
            if data is not None:
                own[2] = data
        order = sorted(found)
        return [found[d][0] for d in order], [found[d][1] for d in order], [found[d][2] for d in order]

    def chunks(data: list[bytes]) -> Iterator[tuple[int, int]]:
        begin, size = 0, 0
        for i, d in enumerate(data):
            if size and size + len(d) > CHUNK:
                yield begin, i
                begin, size = i, 0
            size += len(d)
        if begin < len(data):
            yield begin, len(data)

    @trimmed
    def up(table: pa.Table) -> pa.Table:
        """A group's distinct shingles and the number of documents with each, for each slice of the hashes."""
        g = table["g"][0].as_py()
        _, counts, data = texts_of(table)
        parts, many = [], []
        for a, b in chunks(data):
            own = [counted(h)[0] for h in shingle_hashes(data[a:b])]
            parts += own
            many += [np.full(len(h), n, np.int64) for h, n in zip(own, counts[a:b], strict=True)]
        h, n = (np.concatenate(parts), np.concatenate(many)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, at) if len(at) else n
        h = h[at]
        cut = np.searchsorted(h, (np.arange(1, slices, dtype=np.float64) / slices * 2.0**HASH_BITS).astype(_U))
        out = []
        for b, (hh, nn) in enumerate(zip(np.split(h, cut), np.split(n, cut), strict=True)):
            if len(hh):
                often = np.flatnonzero(nn > 1)
                out.append((b, g, pack_sorted(hh), often.astype("<u4").tobytes() + nn[often].astype("<u4").tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["b", "g", "h", "n"])

    @trimmed
    def down(table: pa.Table) -> pa.Table:
        """For each group, its shingles of a slice that occur in more than one document, and their frequency codes."""
        sources, blobs, many = table["g"].to_pylist(), [unpack_sorted(x)[0] for x in table["h"].to_pylist()], []
        for h, n in zip(blobs, table["n"].to_pylist(), strict=True):
            count, often = np.ones(len(h), np.int64), np.frombuffer(n, "<u4")
            count[often[: len(often) // 2]] = often[len(often) // 2 :]
            many.append(count)
        h, n = np.concatenate(blobs), np.concatenate(many)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(n, at)
        keep = total > 1
        common, code = h[at][keep], np.minimum(255, np.rint(STEPS * np.log2(total[keep]))).astype(np.uint8)
        out = []
        for g, own in zip(sources, blobs, strict=True):
            if len(common):
                place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                has = common[place] == own
                if has.any():
                    out.append((g, "df", None, pack_sorted(own[has]) + code[place[has]].tobytes()))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["g", "kind", "id", "data"])

    def frequencies(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and codes of a group from all its slices."""
        h, c = [], []
        for x in blobs:
            own, rest = unpack_sorted(x)
            h.append(own)
            c.append(np.frombuffer(rest, np.uint8))
        if not h:
            return np.zeros(0, _U), np.zeros(0, np.uint8)
        hh, cc = np.concatenate(h), np.concatenate(c)
        order = np.argsort(hh, kind="stable")
        return hh[order], cc[order]

    def vectors(data: list[bytes], common: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct hashes, term frequencies and frequency codes of each text."""
        out = []
        for h in shingle_hashes(data):
            own, tf = counted(h)
            code = np.zeros(len(own), np.uint8)
            if len(common) and len(own):
                place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                code = np.where(common[place] == own, codes[place], np.uint8(0))
            out.append((own, tf, code))
        return out

    @trimmed
    def sign(texts: pa.Table, extra: pa.Table) -> pa.Table:
        """Band keys of a group's texts."""
        g, ids, keys = [], [], []
        if texts.num_rows:
            least_ids, _, data = texts_of(texts)
            common, codes = frequencies(values(extra, "data"))
            for a, b in chunks(data):
                own = [(i, v) for i, v in zip(least_ids[a:b], vectors(data[a:b], common, codes), strict=True) if len(v[0]) and i is not None]
                if own:
                    starts = np.cumsum([0] + [len(v[0]) for _, v in own[:-1]])
                    made = band_keys(samples(np.concatenate([v[0] for _, v in own]), np.concatenate([weights_of(v[1], v[2], n_docs) for _, v in own]), starts)).view(np.int64)
                    ids += [i for i, _ in own]
                    keys += list(made)
            g = [texts["g"][0].as_py()] * len(ids)
        return pa.table([pa.array(g, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["g", "id", "keys"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each band key."""
        for batch in batches:
            rows = np.repeat(np.arange(batch.num_rows), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(band), batch.column(2).flatten()], ["g", "id", "band", "value"])

    @trimmed
    def chosen(texts: pa.Table, extra: pa.Table) -> pa.Table:
        """Shingles of the texts that share a bucket."""
        ids, packed = [], []
        wanted = {i for i, kind in zip(values(extra, "id"), values(extra, "kind"), strict=True) if kind == "id"}
        if texts.num_rows and wanted:
            least_ids, _, data = texts_of(texts)
            common, codes = frequencies([d for d, kind in zip(values(extra, "data"), values(extra, "kind"), strict=True) if kind == "df"])
            some = [(i, d) for i, d in zip(least_ids, data, strict=True) if i in wanted]
            for a, b in chunks([d for _, d in some]):
                ids += [i for i, _ in some[a:b]]
                packed += [pack_vector(*v) for v in vectors([d for _, d in some[a:b]], common, codes)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["id", "vector"])

    def unpacked(packed: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(h, weights_of(tf, code, n_docs)) for h, tf, code in map(unpack_vector, packed)]

    @trimmed
    def verify(bucket: pa.Table) -> pa.Table:
        """Links of a bucket's texts with the smallest id of their component in it; the texts of a large bucket's block as well."""
        order = np.argsort(bucket["id"].to_numpy(), kind="stable")
        ids = bucket["id"].to_numpy()[order]
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
        order, ids = order[fresh], ids[fresh]
        packed = bucket["vector"].to_pylist()
        to = ids[bucket_components(unpacked([packed[i] for i in order.tolist()]), least)]
        linked = to != ids
        n = int(linked.sum())
        held = np.flatnonzero(np.array(bucket["held"].to_pylist(), bool)).tolist()
        again = [bucket["id"][i].as_py() for i in held]
        none = [None] * len(held)
        return pa.table([pa.array([*ids[linked].tolist(), *again], pa.int64()), pa.array([*to[linked].tolist(), *none], pa.int64()), pa.array([None] * n + [bucket["bucket"][i].as_py() for i in held], pa.int64()), pa.array([None] * n + [packed[i] for i in held], pa.binary())], ["a", "b", "bucket", "vector"])

    @trimmed
    def cross(pair: pa.Table) -> pa.Table:
        """Links between components of a large bucket's texts in two of its blocks."""
        block, i, j = np.array(pair["block"].to_pylist()), pair["i"][0].as_py(), pair["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
        packed, root = pair["vector"].to_pylist(), pair["root"].to_numpy()
        before = np.concatenate([root[left], root[right]])
        after = cross_components(unpacked([packed[x] for x in left.tolist()]), unpacked([packed[x] for x in right.tolist()]), before, least)
        made = np.unique(np.stack([before, after], 1)[before != after], axis=0)
        return pa.table([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    def met_again(texts: DataFrame, found: DataFrame) -> DataFrame:
        """Links between the components that large buckets still have, from all pairs of their texts (bucket, a, vector)."""
        half = BUCKET_MOST // 2
        member = checkpoint(texts.select("bucket", F.col("a").alias("id")).join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("root")))
        sizes = member.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        many = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all")).where(F.col("all") > F.col("top.m"))
        # Blocks of the largest component come first; they need not meet each other.
        first, rest = F.ceil(F.col("top.m") / half).cast("int"), F.ceil((F.col("all") - F.col("top.m")) / half).cast("int")
        big = F.col("root") == F.col("top.root")
        placed = member.join(many.withColumn("first", first).withColumn("rest", rest), "bucket")
        placed = placed.withColumn("block", F.when(big, F.pmod(F.xxhash64("id"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int"))
        meets = F.when(big, F.sequence("first", F.col("first") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("first") + F.col("rest") - 1))
        tasks = placed.select("bucket", "id", "root", "block", F.explode(meets).alias("other")).select("bucket", "id", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return tasks.join(texts.select("bucket", F.col("a").alias("id"), "vector"), ["bucket", "id"]).groupBy("bucket", "i", "j").applyInArrow(cross, "a bigint, b bigint")

    extra_kind = "g int, kind string, id bigint, data binary"
    sent = docs.where("id is not null").mapInArrow(once, "g int, texts binary").repartition(groups, "g")
    frequency = sent.groupBy("g").applyInArrow(up, "b int, g int, h binary, n binary").repartition(slices, "b").groupBy("b").applyInArrow(down, extra_kind)
    signed = sent.groupBy("g").cogroup(frequency.groupBy("g")).applyInArrow(sign, "g int, id bigint, keys array<bigint>")
    # Both uses below share the exchange, so signatures are made once: a Python node on top keeps its columns alike.
    members = signed.repartition(groups, "id").mapInArrow(spread, "g int, id bigint, band int, value bigint")
    print_of = F.xxhash64("id")
    buckets = members.groupBy("band", "value").agg(F.count("*").alias("m"), F.bit_xor(print_of).alias("p"), F.sum((print_of.bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")).alias("q"), F.min("id").alias("first")).where("m > 1")
    # Bands whose buckets have the same members say the same: one of them stays.
    single = buckets.groupBy("m", "p", "q", "first").agg(F.min(F.struct("band", "value")).alias("of")).select("m", "first", F.col("of.band").alias("band"), F.col("of.value").alias("value"))
    inside = members.join(single, ["band", "value"]).withColumn("bucket", F.xxhash64("band", "value"))
    inside = inside.select("bucket", "m", "g", "id").repartition(groups, "bucket", "id").mapInArrow(lambda batches: batches, "bucket bigint, m bigint, g int, id bigint")
    wanted = inside.select("g", F.lit("id").alias("kind"), "id", F.lit(None).cast("binary").alias("data")).distinct()
    vector = sent.groupBy("g").cogroup(frequency.unionByName(wanted).groupBy("g")).applyInArrow(chosen, "id bigint, vector binary")
    blocks = F.ceil(F.col("m") / BUCKET_MOST).cast("int")
    small = inside.where(F.col("m") <= BUCKET_MOST).select("bucket", F.lit(0).alias("block"), "id", F.lit(False).alias("held"))
    large = inside.where(F.col("m") > BUCKET_MOST)
    heads = large.groupBy("bucket").agg(F.max("m").alias("m"), F.expr(f"slice(array_sort(collect_set(if(pmod(xxhash64(id), greatest(1, cast(m / {4 * LEADERS} as int))) = 0, id, null))), 1, {LEADERS})").alias("ids"))
    dealt = large.select("bucket", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id", F.lit(True).alias("held"))
    led = heads.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("ids")).select("bucket", "block", F.explode("ids").alias("id"), F.lit(False).alias("held"))
    met = checkpoint(small.unionByName(dealt).unionByName(led).join(vector, "id").groupBy("bucket", "block").applyInArrow(verify, "a bigint, b bigint, bucket bigint, vector binary"))
    found = components(met.select("a", "b"))
    held = met.where("vector is not null")
    if held.limit(1).count():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(met_again(held.select("bucket", "a", "vector"), found)))
    # Copies of one text share its digest; its least id stands for them.
    digests = checkpoint(docs.select("id", F.when(F.col("text").rlike(r"\S"), F.unhex(F.md5(F.col("text").cast("binary")))).alias("digest")))
    return joined_classes(digests, found, key, n_docs)


def joined_classes(digests: DataFrame, found: DataFrame, key: str, n_docs: int) -> DataFrame:
    """Classes of all rows. A hot text's rows aren't shuffled: hot texts are few by definition, and broadcast."""
    known = F.col("digest").isNotNull() & F.col("id").isNotNull()
    least = digests.where(known).groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    classes = checkpoint(least.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"), "n"))
    is_hot = F.col("n") >= max(2, math.ceil(n_docs * HOT_SHARE))
    hot, others = F.broadcast(classes.where(is_hot).drop("n")), classes.where(~is_hot).drop("n")  # at most 1 / HOT_SHARE rows
    there = digests.where(F.col("digest").isNotNull())
    out = there.join(hot, "digest").unionByName(there.join(hot, "digest", "left_anti").join(others, "digest", "left"))
    out = out.unionByName(digests.where(F.col("digest").isNull()).withColumn("class_id", F.lit(None).cast("long")))
    out = out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
