"""Checks of size before a broadcast or an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Elements of all rows together, where rows hold lists.
BROADCAST_ELEMENTS = 4_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """With a broadcast hint if a count shows at most `most` rows; else as it is, for a shuffled join. size: elements of
    a row, of which all rows together may have BROADCAST_ELEMENTS."""
    if size is not None:
        rows, elements = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
        return F.broadcast(df) if rows <= most and elements <= BROADCAST_ELEMENTS else df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly if a scan gives fewer partitions than there are cores; else, as at any larger size, as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
