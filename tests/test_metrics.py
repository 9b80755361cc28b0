"""Metrics and curves against hand-computed values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import curves, fusion, metrics, ranking

RANKED = "query_id long, method string, rank long, item_id long, score double"


@pytest.fixture
def small(spark):
    rows = [(1, "a", 1, 10, 0.9), (1, "a", 2, 11, 0.8), (1, "a", 3, 10, 0.7), (1, "a", 4, 12, 0.7), (2, "a", 1, 20, None), (2, "a", 2, 21, float("nan")), (2, "a", 3, 22, 0.5)]
    qrels = [(1, 10), (1, 12), (1, 13), (2, 22), (3, 30)]
    return spark.createDataFrame(rows, RANKED), spark.createDataFrame(qrels, "query_id long, item_id long")


def test_query_metrics_divide_by_k_and_by_all_relevant(spark, small):
    runs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "query_id long, method string")
    got = {r["query_id"]: r for r in metrics.query_metrics(*small, runs=runs).collect()}
    assert got[1]["hits"] == 2 and got[1]["returned"] == 4
    assert got[1]["map"] == pytest.approx((1 + 2 / 4) / 3)
    assert got[1]["precision_at_5"] == pytest.approx(2 / 5) and got[1]["precision_at_10"] == pytest.approx(0.2)
    assert got[2]["mrr"] == pytest.approx(1 / 3) and got[2]["first_rank"] == 3
    assert got[3]["returned"] == 0 and got[3]["map"] == 0 and got[3]["mrr"] == 0 and got[3]["first_rank"] is None


def test_repeats_stay_or_close_up(small):
    ranked, qrels = small
    keep = {(r["query_id"], r["rank"]): r["flag"] for r in ranking.flags_keep(ranked, qrels).collect()}
    assert keep[1, 1] == 1 and keep[1, 3] == 0 and keep[1, 4] == 1
    drop = {(r["query_id"], r["rank"]): r["item_id"] for r in ranking.flags_drop(ranked, qrels).collect()}
    assert drop[1, 3] == 12 and (1, 4) not in drop


def test_ndcg(small):
    got = {r["query_id"]: r for r in metrics.ndcg(*small).collect()}
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert got[1]["ndcg_at_10"] == pytest.approx((1 + 1 / math.log2(4)) / ideal)
    assert got[2]["ndcg_at_10"] == pytest.approx(1 / math.log2(4))


def test_threshold_curve_ties_and_bad_scores(small):
    ranked, qrels = small
    flagged = ranking.flags_keep(ranked, qrels)
    points = sorted(curves.by_threshold(flagged, ranking.relevant_counts(qrels)).collect(), key=lambda r: r["returned"])
    assert [(r["hits"], r["returned"]) for r in points] == [(0, 0), (1, 1), (1, 2), (2, 4), (3, 5)]
    assert points[0]["threshold"] is None and points[0]["precision"] == 1.0
    assert all(r["total_relevant"] == 4 for r in points)


def plain_curve(rows, total):
    out, hits, n = [(0.0, 1.0)], 0, 0
    for score in sorted({s for s, _ in rows}, reverse=True):
        group = [f for s, f in rows if s == score]
        hits, n = hits + sum(group), n + len(group)
        out.append((hits / total, hits / n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_against_plain_python(spark, seed):
    draw = random.Random(seed)
    rows, qrels = [], []
    for q in range(6):
        items = draw.sample(range(40), 15)
        scores = sorted((draw.randint(0, 8) / 4 for _ in items), reverse=True)
        rows += [(q, "m", r + 1, i, s) for r, (i, s) in enumerate(zip(items, scores))]
        qrels += [(q, i) for i in draw.sample(range(40), 8)]
    ranked, judged = spark.createDataFrame(rows, RANKED), spark.createDataFrame(qrels, "query_id long, item_id long")
    curve = curves.by_threshold(ranking.flags_keep(ranked, judged), ranking.relevant_counts(judged)).cache()
    want = plain_curve([(r[4], (r[0], r[3]) in set(qrels)) for r in rows], len(qrels))
    got = sorted(((r["recall"], r["precision"], r["returned"]) for r in curve.collect()), key=lambda x: x[2])
    assert [v for x in got for v in x[:2]] == pytest.approx([v for x in want for v in x])
    inter = {r["recall"]: r["precision"] for r in curves.interpolated(curve).collect()}
    assert set(inter) >= {0.0, 1.0}
    for level, p in inter.items():
        assert p == pytest.approx(max((y for x, y in want if round(x, 9) >= level), default=0.0))
    values = [inter[k] for k in sorted(inter)]
    assert values == sorted(values, reverse=True)
    ap = sum((b[0] - a[0]) * b[1] for a, b in zip(want, want[1:]) if b[0] > a[0])
    assert curves.step_ap(curve).first()["ap"] == pytest.approx(ap)
    final = max(curve.collect(), key=lambda r: r["returned"])
    assert final["recall"] == pytest.approx(final["hits"] / len(qrels))


def test_rrf_order_of_ties(spark):
    schema = "query_id long, item_id long, score double, rank long"
    a = spark.createDataFrame([(1, 5, 1.0, 1), (1, 6, 0.5, 2)], schema)
    b = spark.createDataFrame([(1, 7, 1.0, 1), (1, 8, 0.5, 2), (1, 6, 0.4, 3)], schema)
    got = [r["item_id"] for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [6, 5, 7, 8]
    assert [r["item_id"] for r in fusion.rrf(a, a).orderBy("rank").collect()] == [5, 6]


def test_weighted_mean_of_sets(spark):
    parts = [spark.createDataFrame([("m", v)] * n, "method string, map double") for v, n in ((0.796715, 852), (0.559239, 48))]
    assert metrics.pooled_mean(parts).first()["map"] == pytest.approx(0.784050, abs=1e-6)


def test_summary_counts_failures(spark, small):
    outcomes = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False)], "query_id long, method string, success boolean")
    row = metrics.summarize(metrics.query_metrics(*small), outcomes).first()
    assert (row["tested"], row["successful"], row["failed"]) == (3, 2, 1)
    assert row["mrr"] == pytest.approx((1 + 1 / 3) / 2)


def test_empty_ranking(spark):
    empty, qrels = spark.createDataFrame([], RANKED), spark.createDataFrame([(1, 1)], "query_id long, item_id long")
    assert metrics.query_metrics(empty, qrels).count() == 0
    assert curves.by_threshold(ranking.flags_keep(empty, qrels), ranking.relevant_counts(qrels)).count() == 0
    assert metrics.summarize(metrics.query_metrics(empty, qrels)).count() == 0
    assert curves.interpolated(curves.by_threshold(ranking.flags_keep(empty, qrels), ranking.relevant_counts(qrels))).select(F.count("*")).first()[0] == 0
