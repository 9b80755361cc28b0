"""Readers, writers, corpora, topics and the registry on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import bm25, corpus, dense, ranges, registry, strata, text, topics
from gleaner.sources import readers, writers


def test_items_in_two_encodings(spark, tmp_path):
    rows = "codigo\tdescricao\n1\t aço \nx\tbad\n2\t\n3\ttubo\n"
    for name, encoding in (("u.tsv", "utf-8-sig"), ("w.tsv", "cp1252")):
        (tmp_path / name).write_text(rows, encoding=encoding)
        got = readers.read_items(spark, str(tmp_path / name)).orderBy("item_id").collect()
        assert [(r["item_id"], r["description"]) for r in got] == [(1, "aço"), (3, "tubo")]
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_items(spark, str(tmp_path / "bad.tsv"))


def test_benchmark_is_flattened(spark, tmp_path):
    items = [{"codigo": 5, "descricao_original": " a ", "mutations": [{"mut_ID": 1, "descricao_mutada": " x ", "relevant_item_ids": [9, 7, 9, "z"]}, {"mut_ID": 2, "descricao_mutada": "y"}, {"mut_ID": None, "descricao_mutada": "y"}, {"mut_ID": 3, "descricao_mutada": " "}]}]
    (tmp_path / "b.json").write_text(json.dumps({"items": items}, indent=1))
    got = readers.read_benchmark(spark, str(tmp_path / "b.json")).orderBy("pos").collect()
    assert [(r["product_id"], r["product_description"], r["relevant_item_ids"]) for r in got] == [(1, "x", [7, 9]), (2, "y", [5])]
    (tmp_path / "c.json").write_text(json.dumps({"items": []}))
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, str(tmp_path / "c.json"))


def test_correlations_grouping_and_combined_queries(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('ID_Sup\tID_Prod\tProd_Desc\tID_Itm\tItm_Desc\n295\t1\t"a  b"\t8\tz\n295\t1\t"a  b"\t4\tq\n295\t2\tsame\t4\tsame\n')
    rows = readers.read_correlations(spark, str(tmp_path / "c.tsv"))
    assert sorted((r["ID_Prod"], r["ID_Itm"], r["different"]) for r in rows.collect()) == [(1, 4, True), (1, 8, True), (2, 4, False)]
    grouped = {r["ID_Prod"]: r for r in corpus.group_correlations(rows).collect()}
    assert grouped[1]["relevant_item_ids"] == [4, 8] and grouped[1]["original_description"] == "q"
    bench = spark.createDataFrame([(3, "m", "o", 5)], "mutation_id long, product_description string, original_description string, codigo long")
    both = corpus.combined_queries(rows, bench)
    assert both.count() == 4 and both.columns == ["source", "query_id", "query_text", "target_text", "target_id"]
    (tmp_path / "d.tsv").write_text("ID_Sup\tID_Prod\tProd_Desc\tID_Itm\tItm_Desc\n1\t1\ta\t8\tz\n")
    with pytest.raises(Exception, match="bad ids"):
        readers.read_correlations(spark, str(tmp_path / "d.tsv")).collect()


def test_combine_keeps_first_text_and_code(spark):
    left = spark.createDataFrame([(1, " Tubo  10 ", 0), (2, "tubo 10", 1), (3, "Cabo", 2)], "code long, text string, pos long")
    right = spark.createDataFrame([(7, "TUBO 10", 0), (8, "Fio", 1)], "code long, text string, pos long")
    got = {(r["description"], r["code_left"], r["code_right"], r["source"]) for r in corpus.combine(left, right).collect()}
    assert got == {("Tubo  10", 1, 7, "both"), ("Cabo", 3, None, "left"), ("Fio", None, 8, "right")}


def test_unique_items_reject_divergent_texts(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "item_id long, text string")
    assert corpus.unique_items(same).count() == 2
    with pytest.raises(Exception, match="several texts"):
        corpus.unique_items(same.union(spark.createDataFrame([(1, "c")], same.schema))).collect()


def test_candidates_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "m", 1, 9, 0.5), (1, "m", 2, 8, 0.25)], "query_id long, method string, rank long, item_id long, score double")
    queries, qrels = spark.createDataFrame([(1, "q")], "query_id long, text string"), spark.createDataFrame([(1, 8)], "query_id long, item_id long")
    writers.write_candidates(writers.candidate_rows(ranked, queries, qrels), str(tmp_path / "c"))
    back, judged = readers.read_candidates(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in back.orderBy("rank").collect()] == [(1, "m", 1, 9, 0.5), (1, "m", 2, 8, 0.25)]
    assert [tuple(r) for r in judged.collect()] == [(1, 8)]


def test_metrics_append_or_replace(spark, tmp_path):
    path, a, b = str(tmp_path / "m"), spark.createDataFrame([(1, 0.5)], "x int, y double"), spark.createDataFrame([(1,)], "z int")
    writers.append_metrics(a, path)
    writers.append_metrics(a, path)
    assert spark.read.csv(path, sep=";", header=True).count() == 2
    writers.append_metrics(b, path)
    assert spark.read.csv(path, sep=";", header=True).columns == ["z"]
    rounded = writers.round_floats(spark.createDataFrame([((0.12345678, [0.11111119]), "s")], "a struct<b:double,c:array<double>>, d string")).first()
    assert rounded["a"]["b"] == 0.123457 and rounded["a"]["c"] == [0.111111]
    assert "| x | y |" in writers.markdown(a, "T") and "0.5000" in writers.markdown(a)


def test_embedding_cache_encodes_each_text_once(spark, tmp_path):
    calls = []

    def encode(df):
        calls.append(df.count())
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "item_id long, text string")
    for _ in range(2):
        got = readers.cached_embeddings(spark, str(tmp_path / "e"), texts, "m", "raw", encode)
        assert sorted((r["item_id"], r["embedding"]) for r in got.collect()) == [(1, [1.0]), (2, [2.0]), (3, [1.0])]
    assert calls == [2]


def corpus_rows(spark):
    rows = [(1, "tubo pvc 25mm", [1.0, 0.0]), (2, "tubo aco", [0.6, 0.8]), (3, "cabo", [0.0, 1.0])]
    return spark.createDataFrame(rows, "item_id long, text string, embedding array<float>")


def test_registry_runs_and_reports_failures(spark):
    queries = spark.createDataFrame([(1, "tubo", [1.0, 0.0]), (2, "zzz", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    registry.RETRIEVERS["broken"] = lambda q, c, k: 1 / 0
    try:
        ranked, outcomes = registry.run(queries, corpus_rows(spark), ["bm25", "dense", "hybrid", "hybrid_mix", "broken"], k=2)
        good = {(r["method"], r["success"]) for r in outcomes.collect()}
        assert good == {("bm25", True), ("dense", True), ("hybrid", True), ("hybrid_mix", True), ("broken", False)}
        by = {(r["method"], r["query_id"], r["rank"]): r["item_id"] for r in ranked.collect()}
        assert ("bm25", 2, 1) not in by and by["dense", 1, 1] == 1 and by["hybrid", 1, 1] in (1, 2)
        assert registry.parse_methods("bm25, dense", "dense") == ["bm25"]
        with pytest.raises(ValueError):
            registry.parse_methods("nope")
        with pytest.raises(ValueError):
            registry.parse_methods("bm25", "bm25")
    finally:
        del registry.RETRIEVERS["broken"]


def test_bm25_matches_plain_python(spark):
    import math
    docs = {1: "a b a c", 2: "b b d", 3: "a", 4: ""}
    queries = {1: "a b b", 2: "x"}
    got = {(r["query_id"], r["item_id"]): r["score"] for r in bm25.scores(spark.createDataFrame(list(queries.items()), "query_id long, text string"), spark.createDataFrame(list(docs.items()), "item_id long, text string"), tokenizer=lambda c: F.filter(F.split(c, " "), lambda w: w != "")).collect()}
    toks = {i: d.split() for i, d in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for q, text in queries.items():
        for i, d in toks.items():
            s = 0.0
            for w in set(text.split()):
                df, tf = sum(w in x for x in toks.values()), d.count(w)
                if tf:
                    s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
            if s:
                want[q, i] = s
    assert got == pytest.approx(want)


def test_dense_blocks_agree(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(60)]
    items, queries = spark.createDataFrame(rows, "item_id long, embedding array<float>"), spark.createDataFrame(rows[:9], "query_id long, embedding array<float>")
    one = sorted(map(tuple, dense.retrieve(queries, items, 5).collect()))
    for block, most in ((4, 8), (2, 2)):  # broadcast, and by an exchange with more blocks than a task keeps
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        monkeypatch.setattr(dense, "BLOCKS_MOST", most)
        assert sorted(map(tuple, dense.retrieve(queries, items, 5).collect())) == one and len(one) == 45
    assert dense.retrieve(queries.limit(0), items, 5).count() == 0


def test_topics(spark):
    items = spark.createDataFrame([(1, 10, None, 0), (2, None, 20, 1), (3, 10, None, 2)], "topic int, code_left long, code_right long, pos long")
    assert sorted(map(tuple, topics.code_maps(items).collect())) == [("left", 10, 3), ("right", 20, 2)]
    bench = spark.createDataFrame([(1, [7, 8], 5), (2, [9], 6)], "query_id long, relevant_item_ids array<long>, codigo long")
    known = spark.createDataFrame([(7, 1), (6, 4)], "item_id long, topic int")
    assert sorted(map(tuple, topics.query_topics(bench, known).collect())) == [(1, 1), (2, -1)]
    assert sorted(map(tuple, topics.query_topics(bench, known, "code").collect())) == [(1, -1), (2, 4)]
    vectors = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    for bisecting in (False, True):
        assert topics.cluster(vectors, 2, bisecting=bisecting).select("topic").distinct().count() == 2


def test_first_codes_by_position(spark):
    rows = spark.createDataFrame([(5, 3), (6, 1), (5, 2), (7, 0)], "codigo long, pos long")
    assert {r["codigo"] for r in corpus.first_codes(rows, most=2).collect()} == {7, 6}
    assert {r["codigo"] for r in corpus.first_codes(rows, codes=[5]).collect()} == {5}


def test_third_encoding_where_windows_has_no_character(spark, tmp_path):
    (tmp_path / "l.tsv").write_bytes("codigo\tdescricao\n1\ta\x81\xe7o\n".encode("latin-1"))
    assert readers.detect_encoding(spark, str(tmp_path / "l.tsv")) == "iso-8859-1"
    assert readers.read_items(spark, str(tmp_path / "l.tsv")).first()["description"] == "a\x81\xe7o"
    (tmp_path / "w.tsv").write_bytes("codigo\tdescricao\n1\t10\u20ac\n".encode("cp1252"))
    assert readers.detect_encoding(spark, str(tmp_path / "w.tsv")) == "windows-1252"


def test_what_is_written_is_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', 8, "z", True), (1, 'a "b"', 4, "q", True), (2, "same", 4, "same", False)], "ID_Prod long, Prod_Desc string, ID_Itm long, Itm_Desc string, different boolean").withColumn("ID_Sup", F.lit(295).cast("long"))
    writers.write_benchmark(corpus.group_correlations(rows.where("different")), str(tmp_path / "bench"))
    back = readers.read_benchmark(spark, str(tmp_path / "bench")).collect()
    assert [(r["codigo"], r["product_id"], r["product_description"], r["original_description"], r["relevant_item_ids"]) for r in back] == [(1, 1, 'a "b"', "q", [4, 8])]
    writers.write_different(rows, str(tmp_path / "diff"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "diff").glob("part-*")))
    assert raw.count(b"\r\n") == raw.count(b"\n") > 2 and b'"ID_Sup"\t"ID_Prod"' in raw
    assert sorted((r["ID_Itm"], r["Prod_Desc"]) for r in readers.read_correlations(spark, str(tmp_path / "diff")).collect()) == [(4, 'a "b"'), (8, 'a "b"')]
    writers.write_items(spark.createDataFrame([(9, "n"), (3, "c"), (5, "e")], "item_id long, text string"), str(tmp_path / "items"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "items").glob("part-*")))
    assert whole.startswith(b"codigo\tdescricao\r\n") and whole.index(b"3\tc\r\n") < whole.index(b"5\te\r\n") < whole.index(b"9\tn\r\n")
    assert {r["item_id"]: r["description"] for r in readers.read_items(spark, str(tmp_path / "items")).collect()} == {3: "c", 5: "e", 9: "n"}


def test_results_and_curves(spark, tmp_path):
    results = [{"product_id": 1, "method": "a", "success": True, "map": 0.5}, {"product_id": 1, "method": "b", "success": False, "map": None}, {"product_id": 2, "method": "a", "success": True, "map": 0.25}]
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {}, "results": results}, indent=2))
    read = lambda **o: sorted((r["query_id"], r["method"], r["map"]) for r in readers.read_results(spark, str(tmp_path / "r.json"), **o).collect())
    assert read() == [(1, "a", 0.5), (2, "a", 0.25)] and read(methods=["b"]) == []
    assert read(successful_only=False) == [(1, "a", 0.5), (1, "b", None), (2, "a", 0.25)] and read(methods=["b"], successful_only=False) == [(1, "b", None)]
    (tmp_path / "c.json").write_text(json.dumps({"precision_recall": [{"method": "a", "recall": 0.5, "precision": 1.0, "threshold": None}]}, indent=1))
    assert [tuple(r) for r in readers.read_curves(spark, str(tmp_path / "c.json")).collect()] == [("a", 0.5, 1.0, None)]
    (tmp_path / "e.json").write_text(json.dumps({"precision_recall": []}))
    with pytest.raises(ValueError, match="no curve"):
        readers.read_curves(spark, str(tmp_path / "e.json"))
    table = spark.createDataFrame([(r["product_id"], r["method"], r["success"], r["map"] and r["map"] / 3) for r in results], "query_id long, method string, success boolean, map double")
    points = spark.createDataFrame([("a", 0.5, 1 / 3, 0.7), ("b", 0.25, 1.0, None)], "method string, recall double, precision double, threshold double")
    writers.write_results(str(tmp_path / "out"), results=table, curves=points, other=points)
    assert sorted(map(tuple, readers.read_results(spark, str(tmp_path / "out/results")).collect())) == [(1, "a", 0.166667), (2, "a", 0.083333)]
    assert sorted(map(tuple, readers.read_curves(spark, str(tmp_path / "out/curves")).collect())) == [("a", 0.5, 0.333333, 0.7), ("b", 0.25, 1.0, None)]


def test_halves_and_topics_by_source(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("source\tquery_id\thalf\na\t1\tlower\nb\t1\tupper\nb\tx\tupper\n")
    halves = readers.read_halves(spark, str(tmp_path / "h.tsv"))
    assert sorted((r["source"], r["query_id"], r["half"]) for r in halves.where("query_id is not null").collect()) == [("a", 1, "lower"), ("b", 1, "upper")]
    ranked = spark.createDataFrame([("a", 1, "m", 1, 7, 0.9), ("b", 1, "m", 1, 7, 0.8)], "source string, query_id long, method string, rank long, item_id long, score double")
    qrels = spark.createDataFrame([("a", 1, 7), ("b", 1, 9)], "source string, query_id long, item_id long")
    curves = {(r["half"], r["recall"]): r["precision"] for r in strata.pooled_curves(ranked, qrels, halves).collect()}
    assert curves["lower", 1.0] == 1.0 and curves["upper", 1.0] == 0.0
    metrics = spark.createDataFrame([("a", 1, "m", 1.0), ("b", 1, "m", 0.0)], "source string, query_id long, method string, map double")
    items = spark.createDataFrame([("a", 7, 1), ("b", 7, 2)], "source string, item_id long, topic int")
    bench = spark.createDataFrame([("a", 1, [7], 5), ("b", 1, [7], 5)], "source string, query_id long, relevant_item_ids array<long>, codigo long")
    of = topics.query_topics(bench, items)
    assert sorted(map(tuple, of.collect())) == [("a", 1, 1), ("b", 1, 2)]
    assert {r["topic"]: (r["m"], r["n_queries"]) for r in topics.quality_by_topic(metrics, of, ["m"], least=1).collect()} == {1: (1.0, 1), 2: (0.0, 1)}


def test_methods_that_take_too_long_end(spark):
    import time

    queries = spark.createDataFrame([(1, "tubo", [1.0, 0.0])], "query_id long, text string, embedding array<float>")

    def slow(q, c, k):
        wait = F.udf(lambda x: time.sleep(60) or x, "long")
        return q.select("query_id", wait("query_id").alias("item_id"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("rank"))

    registry.RETRIEVERS["slow"] = slow
    try:
        began = time.time()
        ranked, outcomes = registry.run(queries, corpus_rows(spark), ["slow"], k=2, timeout_s=8)
        assert time.time() - began < 50
        assert [(r["success"], r["error"] != "") for r in outcomes.collect()] == [(False, True)] and ranked.count() == 0
        ranked, outcomes = registry.run(queries, corpus_rows(spark), ["bm25"], k=2, timeout_s=300)
        assert [(r["success"], r["error"]) for r in outcomes.collect()] == [(True, "")] and ranked.count() == 2
    finally:
        del registry.RETRIEVERS["slow"]


def test_small_topic_helpers(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 1)], "topic int, n long")
    assert [r["topic"] for r in topics.largest(sizes, 3).collect()] == [2, 1, 3]
    items = spark.createDataFrame([(1, "tubo"), (2, "de a 3/4"), (3, "ab"), (4, None)], "item_id long, text string")
    assert {r["item_id"] for r in topics.long_enough(items).collect()} == {1}


def test_texts_that_contain_phrases(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabc é"), (2, "bc"), (3, ""), (4, None)], "item_id long, text string")
    phrases = spark.createDataFrame([(10, "bc"), (11, "é"), (12, ""), (13, "bc"), (14, None), (15, "abcabc é!")], "query_id long, text string")
    want = {(10, 1), (13, 1), (11, 1), (12, 1), (10, 2), (13, 2), (12, 2), (12, 3)}
    assert {tuple(r) for r in text.containing(texts, phrases).collect()} == want
    monkeypatch.setattr(text, "BROADCAST_ROWS", 1)
    assert {tuple(r) for r in text.containing(texts, phrases).collect()} == want


def test_ranges_equal_one_window(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = {(str(g), float(v)): int(n) for g, v, n in zip(draw.integers(0, 3, 300), np.round(draw.random(300), 2), draw.integers(1, 9, 300))}
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], "g string, v double, n long")
    found = []
    for most in (10**9, 10):
        monkeypatch.setattr(ranges, "WINDOW_MOST", most)
        up = {(r["g"], r["v"]): r["s"] for r in ranges.running(df, "v", {"s": "n"}, ["g"]).collect()}
        down = {(r["g"], r["v"]): r["s"] for r in ranges.running(df, "v", {"s": "n"}, ["g"], descending=True, most=True).collect()}
        q = {r["g"]: (r["low"], r["high"], r["q"]) for r in ranges.quantiles(df.withColumn("g", F.when(F.col("g") != "0", F.col("g"))), "v", [0.1, 0.5, 0.95], ["g"]).collect()}
        found.append((up, down, q))
    assert found[0] == found[1]
    for (g, v), s in found[0][0].items():
        assert s == sum(n for (h, w), n in rows.items() if h == g and w <= v)
        assert found[0][1][g, v] == max(n for (h, w), n in rows.items() if h == g and w >= v)
    for g, (low, high, q) in found[0][2].items():
        of = [v for (h, v) in rows if h == (g or "0")]
        assert (low, high) == (min(of), max(of)) and q == pytest.approx(np.quantile(of, [0.1, 0.5, 0.95]).tolist())


def test_dense_memory_is_bounded(spark):
    """A block of 4,096 queries over a batch of 4,096 vectors: products are made in slices, and queries don't ride with vectors."""
    import tracemalloc
    draw = np.random.default_rng(2)
    q, x = draw.normal(size=(4096, 16)), draw.normal(size=(4096, 16))
    tracemalloc.start()
    best = dense.Best(np.arange(4096), q, 10)
    best.meet(np.arange(4096), x)
    best.meet(np.arange(4096, 8192), -x)
    rows = [r for batch in best.rows() for r in zip(*(c.to_numpy() for c in batch.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    s = q[7] @ np.concatenate([x, -x]).T
    assert {i for a, i, _ in rows if a == 7} == set(np.argsort(-s)[:10])
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "item_id long, embedding array<float>")
    plan = dense.retrieve(few.withColumnRenamed("item_id", "query_id"), few, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoopJoin" not in plan


def test_dense_ties_are_bounded(spark):
    """Thousands of equal vectors tie for every query: a task keeps the smallest ids of a tie only, wherever the scores lie between two roundings."""
    draw = np.random.default_rng(3)
    q = np.concatenate([draw.normal(size=(30, 2)), [[0.0000005, 0.0], [0.5000005, 0.0], [0.0, 0.0]]])
    best = dense.Best(np.arange(len(q)), q, 5)
    for begin in draw.permutation(20) * 1000:
        best.meet(np.arange(begin, begin + 1000), np.tile([1.0, 2.0], (1000, 1)))
        assert best.size <= 8 * 5 * len(q)
    rows = [r for batch in best.rows() for r in zip(*(c.to_pylist() for c in batch.columns))]
    assert len(rows) <= 4 * 5 * len(q)
    assert all({0, 1, 2, 3, 4} <= {i for a, i, _ in rows if a == n} for n in range(len(q)))
    x = np.concatenate([np.tile([1.0, 2.0], (400, 1)), np.tile([1.0, 2.0 + 3e-7], (400, 1)), draw.normal(size=(400, 2))])[draw.permutation(1200)].astype(np.float32)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q.astype(np.float32))], "query_id long, embedding array<float>")
    pairs = asked.crossJoin(items.withColumnRenamed("embedding", "other"))
    product = "aggregate(zip_with(embedding, other, (a, b) -> cast(a as double) * cast(b as double)), 0d, (a, b) -> a + b)"
    want = dense.top_k(pairs.selectExpr("query_id", "item_id", f"{product} AS score"), 5)
    assert sorted(map(tuple, dense.retrieve(asked, items, 5).collect())) == sorted(tuple(r[c] for c in ("query_id", "item_id", "score", "rank")) for r in want.collect())


def test_candidates_by_label_make_no_pairs(spark):
    """Lists of labels in place of pairs give the same rows; a label without a list, or none, gives an empty one."""
    ranked = spark.createDataFrame([(q, m, 1, 9, 0.5) for q in (1, 2, 3, 4) for m in "mn"], "query_id long, method string, rank long, item_id long, score double")
    queries = spark.createDataFrame([(1, "q", 7), (2, "r", 7), (3, "s", 8), (4, "t", None)], "query_id long, text string, label int")
    pairs = spark.createDataFrame([(q, i) for q in (1, 2) for i in (5, 4, 9)], "query_id long, item_id long")
    lists = spark.createDataFrame([(7, [4, 5, 9]), (None, [6])], "label int, relevant_item_ids array<bigint>")
    shown = lambda df: (df.columns, sorted(map(str, df.collect())))
    found = writers.candidate_rows(ranked, queries, None, relevant=lists)
    assert shown(found) == shown(writers.candidate_rows(ranked, queries, pairs))
    from gleaner.operators import sizes
    with pytest.MonkeyPatch.context() as patch:  # lists that are too long for a broadcast
        patch.setattr(sizes, "BROADCAST_ELEMENTS", 3)
        assert shown(writers.candidate_rows(ranked, queries, None, relevant=lists)) == shown(found)
    from gleaner.plans.queries import QUERIES
    plan = QUERIES["candidate_lists"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan  # the lists are made already, by label


def test_bm25_tasks_follow_the_pairs(spark, monkeypatch):
    """Ten items and two queries of two terms make 40 rows or less: ten tasks of four, whatever their bytes."""
    docs = spark.createDataFrame([(i, "xx yy") for i in range(10)], "item_id long, text string")
    queries = spark.createDataFrame([(1, "xx"), (2, "yy")], "query_id long, text string")
    want = sorted(map(tuple, bm25.scores(queries, docs).collect()))
    monkeypatch.setattr(bm25, "ROWS_A_TASK", 4, raising=False)
    got = bm25.scores(queries, docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 20
    assert got.rdd.getNumPartitions() == 10
