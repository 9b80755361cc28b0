from gleaner.operators import bm25
from gleaner.streaming.retrieval import rank_stream


def test_stream_ranks_like_a_batch(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "tubo pvc"), (2, "cabo"), (3, "tubo aco")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "tubo"), (2, "cabo aco")], "query_id long, text string")
    queries.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        rank_stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "state"), k=2).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "item_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.retrieve(queries, corpus, 2).select("query_id", "item_id", "score", "rank").collect()))
