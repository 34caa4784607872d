"""Carrying the latest value forward along an order, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, key: str, at: str, order: list[str], value: str, size: int, before: bool = False) -> DataFrame:
    """``df`` with ``value`` replaced by the last one known at each row, by ``key``, in the order of ``at`` and ``order``.

    A row's own value counts, unless ``before``. Rows are cut into blocks of ``size`` of the
    numeric column ``at``: the last value of each block is carried over the blocks that follow
    it, then inside each block. So a task holds a block of a key, or a row for each block of
    a key, never all rows of a frequent key.
    """
    rows = df.withColumn("_block", F.floor(F.col(at) / size).cast("long"))
    place = F.struct(at, *order)
    lasts = rows.groupBy(key, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select(key, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_start"))
    inside = Window.partitionBy(key, "_block").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.withColumn("_seen", F.last(value, ignorenulls=True).over(inside)).join(starts, [key, "_block"], "left")
    return out.withColumn(value, F.coalesce("_seen", "_start")).drop("_seen", "_start", "_block")
