from gleaner.plans.benchmark import run_benchmark
from gleaner.sources import readers


def test_run_from_queries_to_files(spark, tmp_path):
    schema = "product_id long, codigo long, product_description string, relevant_item_ids array<long>, pos long, embedding array<float>"
    bench = spark.createDataFrame([(1, 10, "tubo pvc", [1], 0, [1.0, 0.0]), (2, 11, "cabo", [3, 4], 1, [0.0, 1.0]), (3, 12, "fio", [9], 2, [0.0, 1.0])], schema)
    corpus = spark.createDataFrame([(1, "tubo pvc 25mm", [1.0, 0.0]), (2, "tubo aco", [0.6, 0.8]), (3, "cabo", [0.0, 1.0])], "item_id long, text string, embedding array<float>")
    out = run_benchmark(bench, corpus, "bm25,dense", max_codes=2, path=str(tmp_path))
    summary = {r["method"]: r for r in out["summary"].collect()}
    assert summary["bm25"]["tested"] == 2 and summary["bm25"]["map"] == 0.75 and summary["dense"]["failed"] == 0
    ranked, qrels = readers.read_candidates(spark, str(tmp_path / "candidates"))
    assert {(r["query_id"], r["item_id"]) for r in qrels.collect()} == {(1, 1), (2, 3), (2, 4)}
    assert ranked.where("method = 'bm25' and query_id = 1").count() == 2
    assert spark.read.csv(str(tmp_path / "threshold_curve"), sep=";", header=True).count() == out["threshold_curve"].count()
    assert spark.read.csv(str(tmp_path / "summary"), sep=";", header=True).count() == 2
