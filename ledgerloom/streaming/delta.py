"""Keeping aggregated state up to date from micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.stage import files

#: How each measure of two states of a node merges.
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def merged(state: DataFrame | None, delta: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """State and delta, rows of the same shape, as one row for each key.

    ``measures`` says sum, min or max for each column. These merge in any order and
    grouping, so batches of any size give the same state.
    """
    rows = delta if state is None else state.unionByName(delta)
    return rows.groupBy(*keys).agg(*[MERGE[how](c).alias(c) for c, how in measures.items()])


class State:
    """A table of versions, one for each micro-batch; the last whole one counts.

    A batch's version is written under its number and counts from the moment its _SUCCESS
    is there. A batch that is run again after a crash starts from the version before it, so
    it is applied once, however often it runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        fs, root = files(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            done = files(self.spark, f"{self.path}/{name}/_SUCCESS")[1]
            if name.isdigit() and fs.exists(done):
                found.append(int(name))
        return sorted(found)

    def read(self, before: int | None = None) -> DataFrame | None:
        have = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/{have[-1]}") if have else None

    def write(self, version: int, df: DataFrame, keep: int = 2) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{version}")
        fs, _ = files(self.spark, self.path)
        for old in [v for v in self._versions() if v <= version][:-keep]:
            fs.delete(files(self.spark, f"{self.path}/{old}")[1], True)


def run(stream: DataFrame, state: State, to_delta: Callable[[DataFrame], DataFrame], keys: list[str], measures: dict[str, str], checkpoint: str) -> DataFrame:
    """Fold all that a stream has now into ``state``, batch by batch, and return the state."""

    def apply(batch: DataFrame, number: int) -> None:
        state.write(number, merged(state.read(before=number), to_delta(batch), keys, measures))

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read()


def import_range(raw_highest: int | None, rated_highest: int | None, last: int | None, fill: bool = False) -> tuple[int, int] | None:
    """Blocks to process next: from the one after the last to the highest with rates (or known, if rates are carried on)."""
    end = raw_highest if fill else None if None in (raw_highest, rated_highest) else min(raw_highest, rated_highest)
    start = 0 if last is None else last + 1
    return None if end is None or end < start else (start, end)


def contiguous(blocks: DataFrame, last: int | None) -> None:
    """Refuse a batch that repeats processed blocks or leaves some out."""
    first, top, n = blocks.agg(F.min("block_id"), F.max("block_id"), F.count_distinct("block_id")).first()
    if first is None:
        return
    if last is not None and first != last + 1 or top - first + 1 != n:
        raise ValueError(f"blocks {first} to {top} ({n} of them) don't follow block {last}")


def merged_clusters(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(address_id, cluster_id) after new co-spends.

    The components of the new edges together with a star for each cluster that they touch;
    clusters that meet take the least id, all others stay as they are.
    """
    ends = edges.select(F.col("u").alias("address_id")).union(edges.select("v")).distinct()
    touched = known.join(ends, "address_id", "left_semi").select("cluster_id").distinct()
    stars = known.join(touched, "cluster_id", "left_semi").select(F.col("cluster_id").alias("u"), F.col("address_id").alias("v"))
    found = connected_components(edges.select("u", "v").union(stars)).select(F.col("node").alias("address_id"), F.col("component").alias("cluster_id"))
    return known.join(found.select("address_id"), "address_id", "left_anti").select("address_id", "cluster_id").union(found)


def watched(flows: DataFrame, watchlist: DataFrame, address: str = "address", value: str = "value") -> DataFrame:
    """Flows of watched addresses in the watched direction and above the watched value.

    The watchlist has address, direction and value_gt; whether it is broadcast is left to its
    size. A flow to several addresses counts in equal parts.
    """
    joined = flows.join(watchlist.withColumnRenamed("address", "_watched"), F.col(address) == F.col("_watched"))
    return joined.filter((F.col("direction").isNull() | (F.col("direction") == F.col("side"))) & (F.col(value) > F.col("value_gt"))).drop("_watched", "direction", "value_gt")


def flows(txs: DataFrame) -> DataFrame:
    """(tx_id, block_id, address, side, value): inputs and outputs, cut evenly between the addresses of each."""

    def side(column: str, name: str) -> DataFrame:
        each = txs.select("tx_id", "block_id", F.explode(column).alias("x")).select("tx_id", "block_id", F.col("x.value").alias("v"), F.size("x.address").alias("n"), F.explode("x.address").alias("address"))
        return each.select("tx_id", "block_id", "address", F.lit(name).alias("side"), (F.col("v") / F.col("n")).alias("value"))

    return side("inputs", "out").union(side("outputs", "in"))


def windowed(events: DataFrame, time: str, every: str, late: str, *by: Column) -> DataFrame:
    """Counts and sums of a stream by tumbling event-time windows; rows later than ``late`` are dropped, and so is the state of windows before that."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def latest(stream: DataFrame, state: State, keys: list[str], checkpoint: str) -> DataFrame:
    """The last row of each key that a streaming aggregate has put out (update mode), kept in ``state``."""

    def apply(batch: DataFrame, number: int) -> None:
        old = state.read(before=number)
        kept = batch if old is None else old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        state.write(number, kept)

    query = stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read()


def stale(blocks: DataFrame, now: int, hours: float) -> DataFrame:
    """One row: age of the latest block in hours, and whether it is above the limit."""
    age = (F.lit(now) - F.max("timestamp")) / 3600.0
    return blocks.agg(age.alias("age_hours")).withColumn("stale", F.col("age_hours") > hours)
