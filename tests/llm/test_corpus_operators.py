"""Vectors, repeats, near-duplicates, WARC and the pipeline against brute force."""

import gzip
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import common, minhash, quality, suffixes, vectors, warc
from gleaner.operators import lineage
from tests.llm import plain
from tests.llm.data import frame, prose, texts


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2), (9, 9), (None, 4)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def many_texts(seed):
    """The edge cases and a group of near copies, each changed somewhere."""
    rows, draw = dict(texts(seed)), random.Random(seed)
    base = prose(draw, 200).split()
    for i in range(30):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = f"edit{i}"
        rows[1000 + i] = " ".join(words)
    line = "This very common line stands in many documents, and it is longer than a hundred bytes, as lines often are in practice."
    for i in range(40):
        rows[2000 + i] = f"{prose(draw, 12)}\n{line}\n{prose(draw, 12)}"
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = many_texts(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame(spark, list(rows.items())).repartition(5)).collect()}
    assert got == suffixes.brute_force(rows)


def test_repeats_with_null_and_repeated_ids(spark):
    a = prose(random.Random(3), 60)
    rows = [(None, a), (1, a), (1, a), (2, a), (2, a[:150]), (None, None), (3, None)]
    got = Counter((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame(spark, rows)).collect())
    assert got == Counter([(None, 0, a.encode()), (1, 0, a.encode()), (1, 0, a.encode()), (2, len(a), b""), (2, 0, a[:150].encode()), (None, 0, b""), (3, 0, b"")])
    assert suffixes.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    carried = suffixes.remove_repeats(frame(spark, rows), as_text=True, carry=["rest", "kept", "id"]).collect()
    assert all(r["rest"]["rest"] == "r" and r["rest"]["id"] == 1 for r in carried) and len(carried) == 7


def test_hot_anchors_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "STRINGS", 50)
    rows = many_texts(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame(spark, list(rows.items())).repartition(5)).collect()}
    assert got == suffixes.brute_force(rows)


def test_very_long_texts_lose_their_repeats(spark):
    draw = random.Random(14)
    long = "".join(chr(draw.randint(97, 122)) for _ in range(2_500_000))
    rows = [(1, "x" * 1_200_000), (2, long), (3, long[1_000_000:1_000_500] + "!" * 30), (4, "ab" * 600_000)]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    # Of a period, the first period and a window stay: every window but the first of each phase starts earlier.
    assert got == {1: (1_199_999, b"x"), 2: (0, long.encode()), 3: (500, b"!" * 30), 4: (1_199_998, b"ab")}


def test_anchors_of_windows_and_of_pieces():
    draw = random.Random(5)
    data = np.frombuffer((prose(draw, 900) + prose(draw, 5) * 60 + "a" * 300).encode(), np.uint8)
    bounds = np.array([0, 40, 40, 5000, len(data)])
    at, h, low, high = suffixes.anchors(data, bounds, 100, 50)
    rank = (suffixes.gram_hashes(data, 50) >> np.uint64(33)).tolist()
    want = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        for s in range(a, b - 99):
            want.setdefault(min(range(s, s + 51), key=lambda p: (rank[p], p)), []).append(s)
    assert {p: list(range(p - j, p - i + 1)) for p, i, j in zip(at.tolist(), low.tolist(), high.tolist())} == want
    got = []
    for first, last, lo, hi, keep_lo, keep_hi in suffixes.pieces(bounds, 1000, 150):
        a, g, i, j = suffixes.anchors(data[lo:hi], np.clip(bounds[first : last + 1], lo, hi) - lo, 100, 50)
        own = (a + lo >= keep_lo) & (a + lo < keep_hi)
        got += zip((a[own] + lo).tolist(), g[own].tolist(), i[own].tolist(), j[own].tolist())
    assert got == list(zip(at.tolist(), h.tolist(), low.tolist(), high.tolist()))
    for step in (0, 7, 10, 50):
        core, i, j = suffixes.bands(at, low, high, 50, step)
        windows = [c - x for c, a, b in zip(core.tolist(), i.tolist(), j.tolist()) for x in range(a, b + 1)]
        assert sorted(windows) == sorted(s for w in want.values() for s in w) and (j <= step).all() and (i >= 0).all()


def shards_of(seed, counts, step=10):
    """Strings of some shards as symbols, MARK and END among them."""
    draw = np.random.default_rng(seed)
    out = []
    for n in counts:
        low = draw.integers(0, step, n)
        high = np.array([draw.integers(x, step + 1) for x in low])
        data = draw.integers(97, 99, 4000).astype(np.uint8)
        core = draw.integers(200, 3000, n)
        out.append((*suffixes.strings_of(data, core, low, high, 90, step), high))
    return out


def test_walked_and_merged_transforms_order_suffixes():
    flat, symbols, shard, n = [], [], [], 0
    for k, (strings, sizes, _) in enumerate(shards_of(1, (7, 1, 40, 12))):
        rank, string, offset, before, block = suffixes.shard_transform(strings, sizes, 11)
        whole = [bytes(strings[i][: sizes[i]]) for i in rank]
        rows = [whole[i][o:] for i, o in zip(string.tolist(), offset.tolist())]
        assert rows == sorted(rows) and [whole[i][o - 1] for i, o in zip(string.tolist(), offset.tolist())] == before.tolist()
        assert [a[:11] == b[:11] for a, b in zip(rows, rows[1:])] == (np.diff(block) == 0).tolist()
        flat += [(n + i, whole[i], o) for i, o in zip(string.tolist(), offset.tolist())]
        n += len(whole)
        symbols.append(before)
        shard.append(np.full(len(before), k, np.uint16))
    symbols, shard = np.concatenate(symbols), np.concatenate(shard)
    longer, string, after = suffixes.walk(symbols, shard)
    assert [(i, len(w) - 1 - o) for i, w, o in flat] == list(zip(string.tolist(), after.tolist()))
    assert all(flat[r][0] == flat[x][0] for x, r in enumerate(longer.tolist()))
    order, common = suffixes.merge_transforms(symbols, longer, 11)
    circle = [((flat[r][1] * 3)[flat[r][2] :])[:11] for r in order.tolist()]
    assert circle == sorted(circle)
    shared = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 11) for a, b in zip(circle, circle[1:])]
    assert common[1:].tolist() == shared


def test_transform_without_some_strings_is_that_of_the_others():
    (strings, sizes, high), = shards_of(2, (60,))
    names = np.repeat(np.arange(60, dtype=np.uint64)[:, None] % np.uint64(3), 2, axis=1)
    strings[30:45], sizes[30:45], high[30:45], names[30:45] = strings[:15], sizes[:15], high[:15], names[:15]
    assert not suffixes.distinct(strings, names)[30:45].any() and suffixes.distinct(strings[:30], np.arange(60, dtype=np.uint64).reshape(30, 2)).all()
    begins, string, symbols, left = suffixes.shard_of(strings, sizes, high, names, np.arange(60) * 1000, 10)
    assert set(range(30, 45)).isdisjoint(left.tolist()) and len(begins) >= 15
    rank, *want = suffixes.shard_transform(strings[left], sizes[left], 11)
    assert (rank == np.arange(len(left))).all()
    assert (want[0] == string).all() and (want[2] == symbols).all()


def test_stable_order_equals_a_sort_of_tuples():
    draw = np.random.default_rng(8)
    for n in (0, 1, 2, 500):
        keys = [draw.integers(0, top, n).astype(kind) for top, kind in ((4, np.uint64), (3, np.int8), (1, np.int64), (5, np.int64))]
        assert suffixes.stable_order(keys).tolist() == sorted(range(n), key=lambda i: tuple(int(k[i]) for k in keys))


def test_spans_become_one():
    docs, starts, ends = (np.array(x) for x in ([2, 1, 1, 1, 2, 1], [0, 5, 0, 9, 300, 60], [100, 50, 10, 20, 400, 70]))
    assert [x.tolist() for x in suffixes.runs(docs, starts, ends)] == [[1, 1, 2, 2], [0, 60, 0, 300], [50, 70, 100, 400]]
    assert [len(x) for x in suffixes.runs(docs[:0], starts[:0], ends[:0])] == [0, 0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = many_texts(seed)
    out = minhash.near_duplicates(frame(spark, list(rows.items())).repartition(5)).collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert got == plain.classes(rows, minhash.LEAST, minhash.STEPS) and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)
    assert got[6] == 5 and got[7] == 5 and got[0] == 0 and got[2] == 2


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a = prose(random.Random(3), 60)
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, [(None, a), (4, a), (4, a), (2, a), (9, None), (None, None)])).collect())
    assert got == Counter([(None, 2, True), (4, 2, False), (4, 2, False), (2, 2, True), (9, 9, True), (None, None, True)])
    assert minhash.near_duplicates(frame(spark, [(1, a)]).limit(0)).count() == 0


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_MOST", 8)
    rows = {i: t for i, t in many_texts(1).items() if 1000 <= i < 2000}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, list(rows.items()))).collect()} == plain.classes(rows, minhash.LEAST, minhash.STEPS)


def test_pairs_of_different_blocks_of_a_large_bucket(spark, monkeypatch):
    """Texts that share every bucket, linked two by two and with no leader."""
    monkeypatch.setattr(minhash, "BUCKET_MOST", 4)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    monkeypatch.setattr(minhash, "band_keys", lambda signatures: np.tile(np.arange(minhash.BANDS, dtype=np.uint64), (len(signatures), 1)))
    draw, rows = random.Random(6), {}
    for i in range(0, 40, 2):
        rows[i] = prose(draw, 100)
        rows[i + 1] = rows[i] + " tail"
    for i in range(40, 52):
        rows[i] = rows[0] + f" end{i}"
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, list(rows.items()))).collect()}
    assert got == plain.classes(rows, minhash.LEAST, minhash.STEPS) and len(set(got.values())) == 20


def test_unlike_texts_forced_into_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_MOST", 8)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    monkeypatch.setattr(minhash, "band_keys", lambda signatures: np.zeros((len(signatures), minhash.BANDS), np.uint64))
    draw = random.Random(12)
    rows = {i: prose(draw, 60) for i in range(30)}
    rows |= {100 + i: t + " tail" for i, t in rows.items()}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, list(rows.items()))).collect()}
    assert got == {i: i % 100 for i in rows}


def test_near_duplicates_find_the_links_of_a_table(spark):
    """Recall over all pairs of a table, counted without the operator's own hashes."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    rows = dict(zip(*(c.to_pylist() for c in pq.read_table(path, columns=["doc_id", "text"]).columns)))
    pairs = plain.similar_pairs(rows, minhash.LEAST, minhash.STEPS)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(str(path))).collect()}
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.9
    loose = plain.classes(rows, minhash.LEAST - 0.001, minhash.STEPS)
    assert all(loose[i] == loose[c] for i, c in got.items())  # nothing is joined that isn't linked


def test_hot_texts_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_SHARE", 0.2)
    rows = [(i, "a hot text of some six words" if i % 2 else f"{i} text of its own {i}") for i in range(40)] + [(None, "a hot text of some six words"), (90, " ")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(40)} | {None: 1, 90: 90}


def test_very_long_texts_near_duplicates(spark):
    draw = random.Random(13)
    long = " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(400_000))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, long[: len(long) // 2])])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_packed_hashes_round_trip():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 500, dtype=np.uint64))
    back, rest = common.unpack_sorted(common.pack_sorted(h) + b"tail")
    assert (back == h).all() and rest == b"tail" and len(common.unpack_sorted(common.pack_sorted(h[:0]))[0]) == 0


def test_samples_collide_as_often_as_texts_are_alike():
    draw = np.random.default_rng(3)
    h = draw.integers(0, 1 << 48, 4000, dtype=np.uint64)
    a, b = draw.random(4000) + 0.5, draw.random(4000) + 0.5
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits = []
    for i in range(0, 4000, 40):  # 100 pairs of texts of 40 elements
        s = [minhash.samples(h[i : i + 40], w[i : i + 40], np.array([0]))[0] for w in (a, b)]
        hits.append((s[0] == s[1]).mean())
    assert np.mean(hits) == pytest.approx(truth, abs=0.04)


def vector_rows(seed):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = draw.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), [float(x) for x in centre + draw.normal(size=16) * draw.choice([0.05, 0.3])], c % 3))
    rows += [(len(rows) + i, [float(x) for x in draw.normal(size=16)], int(i % 3)) for i in range(60)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, [x * 7 for x in rows[0][1]], 0), (503, None, 0), (504, [], 0), (505, [0.0] * 16, 0), (506, [None, *rows[1][1][1:]], 0), (507, [float("nan"), *rows[1][1][1:]], 0), (508, [float("inf")] * 16, 0), (509, rows[1][1], None), (510, rows[0][1][:8], 0)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, cell int")


@pytest.mark.parametrize("most", [1200, 20])
def test_vectors_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "SHARD_MOST", most)
    monkeypatch.setattr(vectors, "SHARD_AIM", max(8, most // 3))
    rows = vector_rows(1)
    out = vectors.near_duplicates(vector_frame(spark, rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    want = plain.linked(*(list(c) for c in zip(*rows)))
    assert set(got) == set(want)
    total = sum(n for n, _ in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * total and all(got[i][0] <= want[i][0] for i in want)
    if most == 1200:
        assert got == want and vectors.audit(vector_frame(spark, rows), out) == 1.0


def test_dense_shards_in_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)
    rows = vector_rows(2)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(vector_frame(spark, rows)).collect()}
    assert got == plain.linked(*(list(c) for c in zip(*rows)))


@pytest.mark.parametrize("block", [2048, 150])
def test_links_between_groups_of_near_copies(spark, monkeypatch, block):
    """Groups of many more near copies than a node has candidates, all inside one linked cluster."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    draw = np.random.default_rng(4)
    centre = draw.normal(size=32)
    seats = centre + draw.normal(size=(4, 32)) * 0.2
    rows = [(k, [float(x) for x in seats[k % 4] + draw.normal(size=32) * 0.001], 0) for k in range(600)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(vector_frame(spark, rows)).collect()}
    assert got == plain.linked(*(list(c) for c in zip(*rows)))
    assert sum(n for n, _ in got.values()) > 600 * 300


def test_search_without_cut_nodes_finds_all():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(60, 16))
    x = vectors._unit(np.concatenate([c + draw.normal(size=(12, 16)) * s for c, s in zip(centres, draw.choice([0.02, 0.15, 0.3], 60))]))
    lists, cut = vectors.robust_prune(x)
    assert not cut.any()
    want = x @ x.T >= vectors.LEAST
    np.fill_diagonal(want, False)
    assert [sorted(f) for f in vectors.range_search(x, lists, vectors.LEAST)] == [np.flatnonzero(w).tolist() for w in want]


def test_links_count_every_pair_that_shares_a_shard(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_MOST", 60)
    monkeypatch.setattr(vectors, "SHARD_AIM", 20)
    monkeypatch.setattr(vectors, "CANDIDATES", 8)
    placed, whole = [], vectors.shards
    monkeypatch.setattr(vectors, "shards", lambda nodes, least: placed.append(lineage.checkpoint(whole(nodes, least))) or placed[0])
    rows = [r for r in vector_rows(3) if r[0] < 500]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(vector_frame(spark, [(i, v, 0) for i, v, _ in rows])).collect()}
    cells, x = {}, vectors._unit(np.array([v for _, v, _ in rows]))
    for r in placed[0].collect():
        cells.setdefault(tuple(r["v"]), set()).add(r["cell"])
    of = [cells[tuple(v)] for _, v, _ in rows]
    near = x @ x.T >= vectors.LEAST
    assert max(map(len, of)) > 1
    assert got == {rows[a][0]: sum(bool(near[a, b] and a != b and of[a] & of[b]) for b in range(len(rows))) for a in range(len(rows))}


def test_empty_vectors(spark):
    assert vectors.near_duplicates(vector_frame(spark, vector_rows(1)).limit(0)).count() == 0
    alone = vectors.near_duplicates(vector_frame(spark, [(None, [1.0], 1), (3, [1.0], 1)])).collect()
    assert sorted(map(tuple, alone), key=str) == [(3, 0, 3, True), (None, 0, None, True)]


PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>x{}</style><script>var t="</p>";</script></head><body><!-- no --><p>Eins<br>zwei &lt;3</p><a href="/x?a=1&amp;b=2">l</a></body></html>'


def test_warc_records_link_and_parse_back(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", PAGE, "k"), (2, None, None, "k"), (3, "http://b", "", "k"), (3, "http://b", "", "k")], "page_id long, url string, html string, kind string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    meta, text = (next(r for r in rows if r["page_id"] == 1 and r["kind"] == k) for k in ("metadata", "conversion"))
    source = next(warc.parse(warc.response_record(1, "http://a/\r\nX: y", PAGE)))[0]
    for r in (meta, text):
        fields, block = next(warc.parse(bytes(r["record"])))
        assert warc.field(fields, "WARC-Refers-To") == warc.field(source, "WARC-Record-ID") == r["refers_to"]
        assert warc.field(fields, "WARC-Source-Payload-Digest") == warc.field(source, "WARC-Payload-Digest") == warc.sha1(PAGE.encode())
        assert warc.field(fields, "WARC-Block-Digest") == warc.sha1(block) and int(warc.field(fields, "Content-Length")) == len(block) and block == bytes(r["block"])
        assert warc.field(fields, "WARC-Target-URI") == "http://a/ X: y" and warc.field(fields, "X") is None
    assert warc.field(next(warc.parse(bytes(meta["record"])))[0], "WARC-Concurrent-To") == text["record_id"]
    assert bytes(text["block"]).decode() == "A & B\nEins\nzwei <3\nl"
    said = bytes(meta["block"]).decode()
    assert "title: A & B" in said and "outlink: /x?a=1&b=2" in said and "http-header: Content-Type: text/html" in said
    assert next(r for r in rows if r["page_id"] == 2 and r["kind"] == "conversion")["block"] == b""
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


class Plain(HTMLParser):
    """Title, links and text of a page by the parser of the standard library."""

    BREAKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer main title blockquote pre head body".split())
    SKIPS = {"script", "style", "noscript", "template"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.inside, self.skipped = "", [], None, False, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIPS
        if tag == "title" and self.title is None:
            self.inside, self.title = True, ""
        if not self.skipped:
            self.text += "\n" if tag in self.BREAKS else ""
            self.links += [v for n, v in attrs if tag == "a" and n == "href"][:1]

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIPS
        self.inside &= tag != "title"
        self.text += "\n" if tag in self.BREAKS else " " if tag in self.SKIPS else ""

    def handle_data(self, data):
        if self.inside:
            self.title += data
        if not self.skipped:
            self.text += data

    def handle_comment(self, data):
        self.text += " "

    def handle_decl(self, decl):
        self.text += " "

    def lines(self):
        made = (" ".join(line.split()) for line in self.text.split("\n"))
        return "\n".join(line for line in made if line)


def test_warc_scanners_equal_a_plain_parser():
    draw, parts = random.Random(4), ["<p>", "</p>", "<br/>", "<div class='a'>", "</div>", "<b>", "</b>", "<!-- x <p> -->", "<script>if (a < b) { c('</p>') }</script>", "<style>p > q {}</style>", '<a href="/a?x=1&amp;y=2">', "</a>", "<a class=k href='b c'>", "<A HREF=plain id=1>", "<a name=x>", "<title>T &amp; U</title>", "one &lt; two", " three\n four ", "&nbsp;", "é 日本", "<h1>", "</h1>", "<img src=x>"]
    for _ in range(300):
        page = "<!DOCTYPE html>" + "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        plain = Plain(page)
        assert (warc.title_of(page), warc.links_of(page), warc.plain_text(page)) == (" ".join(plain.title.split()) if plain.title is not None else None, plain.links, plain.lines()), page
    for path in sorted(Path("/root/testdata/sf0.001").glob("pages.parquet")):
        for page in pq.read_table(path)["html"].to_pylist():
            plain = Plain(page or "")
            assert warc.links_of(page or "") == plain.links and warc.plain_text(page or "") == plain.lines()


@pytest.mark.parametrize("part", ["<a ", "<a href=", "<script ", "<title>", "<!--", "</script ", "<p ", "<!doctype ", "<script><!--", "&amp", "<a href='", '<a href="x" ', "<"])
def test_warc_scanners_are_linear(part):
    began = time.time()
    for page in (part * (1_000_000 // len(part)), part * (1_000_000 // len(part)) + ">", "<p>" + part * (1_000_000 // len(part)) + "</p>"):
        fields, block = next(warc.parse(warc.response_record(1, "http://a", page)))
        assert len(warc.derivatives(fields, block)) == 2
    assert time.time() - began < 10


def test_warc_files(spark, tmp_path):
    records = [warc.response_record(i, f"http://a/{i}", PAGE) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(records[0])
    back = warc.read_warc(spark, str(tmp_path))
    assert sorted(bytes(r["record"]) for r in back.collect()) == sorted([*records, records[0]])
    assert warc.derive(back, key="file").count() == 8
    with pytest.raises(ValueError):
        list(warc.parse(b"x"))
    with pytest.raises(ValueError):
        list(warc.parse(records[0][:-200]))


def test_pipeline_stages_take_edge_cases(spark, tmp_path):
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    draw = random.Random(9)
    unlike = prose(draw, 40)
    rows = [*texts().items(), (None, None), (None, "x y"), (None, "x y"), (5, texts()[5]), (6, unlike), (77, "password=abcdefghijkl " + prose(draw, 30)), (78, prose(draw, 100_000))]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is not corpus_pipeline.pack_windows:
            assert out.columns == docs.columns, name
        path = str(tmp_path / stage.__name__)
        out.write.parquet(path)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if stage is not corpus_pipeline.keep_quality:  # learnt from nonsense here: what it keeps is no test
            docs = spark.read.parquet(path)
    pieces = docs.collect()
    kept = Counter(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "keep_one_of_near_copies")).collect())
    # 5 and a copy of it, 6 the same text and an unlike one, two rows without id and text, two with one text.
    assert kept[5] == 1 and kept[6] == 1 and kept[None] == 2 and kept[77] == kept[78] == 1
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "keep_one_of_near_copies")).where("doc_id = 6").collect()] == [unlike]
    assert {p["doc_id"] for p in pieces} >= {0, 1, 77, None}
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0)[5] == 1
    hidden = spark.read.parquet(str(tmp_path / "hide_secrets")).where("doc_id = 77").first()
    assert "[assign]" in hidden["text"] and hidden["n_chars"] == len(hidden["text"])
    assert spark.read.parquet(str(tmp_path / "drop_repeats")).where(F.col("n_chars") != F.length("text")).count() == 0


def test_pipeline_equals_a_plain_chain(spark, tmp_path):
    """run() row by row against the stages one after the other in plain Python."""
    from tokenizers import Tokenizer

    draw = random.Random(21)
    rows = {i: t for i, t in many_texts(5).items() if t is not None}
    rows |= {3000 + i: re.sub(" ", "!!! ", prose(draw, draw.randint(20, 120)).upper()) for i in range(40)}
    rows |= {4000 + i: f"{prose(draw, 30)} token=abcdefghijkl{i:04d} AKIAABCDEFGHIJKLMN{i:02d} {prose(draw, 10)}" for i in range(20)}
    labels = [(i, int(not 3000 <= i < 4000), 0) for i in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, list(rows.items()), extra=False).selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {i: t for i, t in rows.items() if model.scores(np.array([quality.measures(t)]))[0] >= quality.THRESHOLD}
    assert 0 < len(good) < len(rows)
    of = plain.classes(good, minhash.LEAST, minhash.STEPS)
    one = {i: t for i, t in good.items() if of[i] == i}
    left = {i: kept.decode("utf-8", "ignore") for i, (_, _, _, kept) in suffixes.brute_force(one).items()}
    hidden = {i: re.sub(r"token=abcdefghijkl\d{4}", "[assign]", re.sub(r"AKIAABCDEFGHIJKLMN\d\d", "[access]", t)) for i, t in left.items()}
    library = Tokenizer.from_file(common.tokenizer_path())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in hidden.items()}
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p["doc_id"], p["start"]))
    assert {p["doc_id"] for p in pieces} == set(ids) and len(one) < len(good) and any(left[i] != one[i] for i in one) and any(hidden[i] != left[i] for i in one)
    at = Counter()
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == at[p["doc_id"]] and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]]), (p["doc_id"], hidden[p["doc_id"]])
        at[p["doc_id"]] += p["length"]
    assert all(at[i] == len(x) for i, x in ids.items())
