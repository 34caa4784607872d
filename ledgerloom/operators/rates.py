"""Exchange rates by block: joins on the date, gaps, and the latest known rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import carried


def block_date(timestamp: Column) -> Column:
    """Day of an epoch second, as text in UTC."""
    return F.date_format(F.timestamp_seconds(timestamp), "yyyy-MM-dd")


def block_rates(blocks: DataFrame, daily: DataFrame, names: list[str]) -> DataFrame:
    """(block_id, fiat_values): rates of a block's day in the order of ``names``.

    ``blocks`` has block_id and timestamp, ``daily`` date and a map fiat_values. Blocks after
    the last day known are left out; days without rates give zeros.
    """
    dated = blocks.select("block_id", block_date(F.col("timestamp")).alias("date"))
    last = daily.agg(F.max("date").alias("last"))
    known = dated.crossJoin(F.broadcast(last)).filter("date <= last")  # one row
    joined = known.join(daily, "date", "left")
    values = F.array(*[F.coalesce(F.try_element_at("fiat_values", F.lit(n)).cast("double"), F.lit(0.0)) for n in names])
    return joined.select("block_id", values.alias("fiat_values"))


def filled(daily: DataFrame, column: str = "fiat_values") -> DataFrame:
    """``daily`` with a row for each day from the first to the last; missing ones repeat the one before.

    A day's fill is the latest day with a value at or before it. Days are a calendar, so
    one window over all of them stays small whatever the ledger's size.
    """
    span = daily.agg(F.min(F.to_date("date")).alias("a"), F.max(F.to_date("date")).alias("b"))
    days = span.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("date"))
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(daily, "date", "left").withColumn(column, F.last(column, ignorenulls=True).over(order))


def as_of(rows: DataFrame, rates: DataFrame, key: str, at: str, value: str, size: int = 10_000) -> DataFrame:
    """``rows`` with ``value`` from the latest rate of the same ``key`` at or before ``at``; null if none.

    Both sides are merged and ordered once, in blocks of ``size`` of ``at``, instead of
    joining each row with every earlier rate. A rate at the row's own place counts.
    """
    left = rows.withColumns({"_kind": F.lit(1), "_value": F.lit(None).cast(dict(rates.dtypes)[value])})
    right = rates.select(key, at, F.col(value).alias("_value")).withColumn("_kind", F.lit(0))
    merged = carried(left.unionByName(right, allowMissingColumns=True), key, at, ["_kind"], "_value", size)
    return merged.filter("_kind = 1").select(*rows.columns, F.col("_value").alias(value))


def frontier(blocks: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: the last block up to which every block has a rate (null if the first has none)."""
    missing = blocks.join(rates, "block_id", "left_anti").agg(F.min("block_id").alias("gap"))
    return blocks.crossJoin(F.broadcast(missing)).filter("gap is null or block_id < gap").agg(F.max("block_id").alias("frontier"))


def block_before(blocks: DataFrame, times: DataFrame) -> DataFrame:
    """For each time the last block at or before it and the first after it.

    Block timestamps needn't rise with the height, so both are aggregates over all blocks.
    ``times`` is a list of lookups that a caller asks for, which bounds it.
    """
    pairs = blocks.select("block_id", "timestamp").join(F.broadcast(times), F.lit(True))
    before = F.max(F.when(F.col("timestamp") <= F.col("asked"), F.col("block_id")))
    after = F.min(F.when(F.col("timestamp") > F.col("asked"), F.col("block_id")))
    return pairs.groupBy("asked").agg(before.alias("before_block"), after.alias("after_block"))
