"""Cumulative values and quantiles over distinct numbers, dealt to tasks by ranges of the numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.lineage import checkpoint
from gleaner.operators.sizes import broadcast_if_small

#: So many rows are summed up in one window; more are dealt by ranges. Both give the same rows.
WINDOW_MOST = 200_000


def same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join by columns that may be null."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    to = b.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return a.join(broadcast_if_small(to), on, "left").drop(*[f"_by_{c}" for c in by])


def running(rows: DataFrame, value: str, columns: dict[str, str], by: Sequence[str] = (), descending: bool = False, most: bool = False) -> DataFrame:
    """Adds sums (or maxima) of columns over all rows of a group up to this value, under the names given.

    A group has a value once, and no null. Ranges hold about equally many rows; only their totals meet in one place.
    """
    agg = F.max if most else F.sum
    rows = checkpoint(rows)
    order = lambda c: F.col(c).desc() if descending else F.col(c)
    up_to_here = lambda *part: Window.partitionBy(*part).orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if rows.limit(WINDOW_MOST + 1).count() <= WINDOW_MOST:
        return rows.withColumns({name: agg(c).over(up_to_here(*by)) for name, c in columns.items()})
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ranges come from a sample: written, they stay as they are for both uses.
    dealt = checkpoint(rows.repartitionByRange(ranges, value).withColumn("_r", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy(*by, "_r").agg(*[agg(c).alias(f"_t_{name}") for name, c in columns.items()])
    offsets = totals.select(*by, "_r", *[agg(f"_t_{name}").over(before).alias(f"_o_{name}") for name in columns])
    inside = dealt.withColumns({name: agg(c).over(up_to_here(*by, "_r")) for name, c in columns.items()})
    join = (lambda o, c: F.greatest(o, c)) if most else (lambda o, c: F.coalesce(o, F.lit(0)) + c)  # greatest passes over null
    out = same(inside, offsets, [*by, "_r"])
    return out.withColumns({name: join(F.col(f"_o_{name}"), F.col(name)) for name in columns}).drop("_r", *[f"_o_{name}" for name in columns])


def counts_below(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `_b`, the sum of `_c` over all smaller values of the group, to rows of distinct numbers and their counts `_c`."""
    return running(counts, value, {"_b": "_c"}, by).withColumn("_b", F.col("_b") - F.col("_c"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, low, high, q): least and largest value of each group, and its linear quantiles in the order of `shares`.

    Values are counted first, so that no task holds all of them.
    """
    counts = checkpoint(df.groupBy(*by, value).agg(F.count("*").alias("_c")))
    there = counts.where(F.col(value).isNotNull())
    groups = counts.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum(F.when(F.col(value).isNotNull(), F.col("_c"))).alias("_n"))
    placed = same(counts_below(there, value, by), groups.select(*by, "_n"), by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_b") <= place) & (place < F.col("_b") + F.col("_c")), F.col(value).cast("double")))

    found = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("_n") - 1)
        found += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    ends = placed.groupBy(*by).agg(*found)
    one = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")
    return same(groups.drop("_n"), ends.select(*by, F.array(*[one(i) for i in range(len(shares))]).alias("q")), by)
