"""Every query of the driver contract against its SQL at the smallest scale."""

import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import __spark_entry__ as entry  # noqa: E402
from gleaner.plans.oracle import oracle  # noqa: E402
from gleaner.plans.queries import QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
FEW = ("bm25_summary", "dense_metrics", "pr_interpolated", "jaccard_quartiles", "normalize_text", "ctfidf_terms", "corpus_dedup_union", "ngram_vocab")


def rows(frame):
    columns = sorted(frame.columns)
    show = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(show(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def test_every_query_has_sql_but_the_iterative():
    assert set(QUERIES) - set(oracle()) == {"topic_clusters"}
    assert set(entry.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.execute(oracle()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
