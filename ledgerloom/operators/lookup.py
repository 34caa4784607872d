"""Look-ups that join stored tables: enriched transactions, lineage, checks, and what has to be redone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut
from . import ids


def normalized(entries: DataFrame, coin: DataFrame, tokens: DataFrame) -> DataFrame:
    """Address transactions with sender, receiver and value of the transfer that their reference names.

    ``entries`` has tx_id, trace_index and log_index (one of them null).
    """
    c = coin.select("tx_id", "trace_index", F.col("from_address").alias("cf"), F.col("to_address").alias("ct"), F.col("value").alias("cv"))
    t = tokens.select("tx_id", F.col("trace_index").alias("log_index"), F.col("from_address").alias("tf"), F.col("to_address").alias("tt"), F.col("value").alias("tv"))
    out = entries.join(c, ["tx_id", "trace_index"], "left").join(t, ["tx_id", "log_index"], "left")
    pick = {"from_address": F.coalesce("cf", "tf"), "to_address": F.coalesce("ct", "tt"), "value": F.coalesce("cv", "tv")}
    return out.withColumns(pick).drop("cf", "ct", "cv", "tf", "tt", "tv")


def in_fiat(rows: DataFrame, rates: DataFrame, factor: float, names: list[str], value: str = "value") -> DataFrame:
    """Rows with their value in each currency at their block's rate, rounded half to even to cents; null without a rate."""
    joined = rows.join(rates.select("block_id", F.col("fiat_values").alias("_r")), "block_id", "left")
    worth = {n: F.bround(F.col(value) / F.lit(factor) * F.get("_r", F.lit(i)), 2) for i, n in enumerate(names)}
    return joined.withColumns(worth).drop("_r")


def assets_of(edges: DataFrame) -> DataFrame:
    """(address_id, outgoing, assets): tokens that an address has sent or received."""
    sides = [edges.select(F.col(c).alias("address_id"), F.lit(c == "src_id").alias("outgoing"), F.explode(F.map_keys("token_values")).alias("asset")) for c in ("src_id", "dst_id")]
    return sides[0].union(sides[1]).groupBy("address_id", "outgoing").agg(F.array_sort(F.collect_set("asset")).alias("assets"))


def cluster_sums(members: DataFrame, addresses: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Sums and extremes of a cluster's addresses; transactions inside a cluster count on both sides."""
    rows = members.join(addresses, "address_id", "left")
    return rows.groupBy(key).agg(
        ids.saturated(F.count("*")).alias("no_addresses"),
        F.min("address_id").alias("min_address_id"),
        F.min("first_tx_id").alias("first_tx_id"),
        F.max("last_tx_id").alias("last_tx_id"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("no_incoming_txs", "no_outgoing_txs", "total_received", "total_spent")],
    )


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to write, keys to delete) when a table is computed anew: old keys that aren't in it are stale."""
    return new, old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti")


def clusters_of(subjects: DataFrame, id_table: DataFrame, clusters: DataFrame) -> DataFrame:
    """(address, address_id, cluster_id, cluster_size) of subjects; an address without a cluster is one of its own."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    known = subjects.select("address").distinct().join(id_table, "address").join(clusters, "address_id", "left")
    known = known.withColumn("cluster_id", F.coalesce("cluster_id", "address_id")).join(sizes, "cluster_id", "left")
    return known.select("address", "address_id", "cluster_id", F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def contradictions(ledger: DataFrame, inputs: DataFrame, outputs: DataFrame, id_table: DataFrame) -> DataFrame:
    """Ledger rows whose transaction doesn't have their address on the side that their sign says; none if all is well."""
    side = lambda df: df.join(id_table, "address").select("tx_id", "address_id").distinct()
    spent = ledger.filter("value < 0").join(side(inputs), ["tx_id", "address_id"], "left_anti")
    return spent.unionByName(ledger.filter("value > 0").join(side(outputs), ["tx_id", "address_id"], "left_anti"))


def lineage(spending: DataFrame, start: DataFrame, fits: DataFrame, depth: int) -> DataFrame:
    """(tx_id, depth): transactions in ``fits`` that ``start`` comes from, through ones that fit, up to ``depth`` steps.

    ``spending`` has tx_id and spent_tx_id. Each level is written out before the next.
    """
    level = start.join(fits.select("tx_id"), "tx_id", "left_semi").select("tx_id", F.lit(0).alias("depth")).distinct()
    seen = level
    for d in range(1, depth + 1):
        before = spending.join(level.select("tx_id"), "tx_id", "left_semi").select(F.col("spent_tx_id").alias("tx_id")).distinct()
        level = cut(before.join(fits.select("tx_id"), "tx_id", "left_semi").join(seen, "tx_id", "left_anti").select("tx_id", F.lit(d).alias("depth")), "lineage")
        seen = seen.union(level)
    return seen


def touched(ledger: DataFrame, after: int) -> DataFrame:
    """(address_id, is_new): addresses with a transaction after one, and whether they had none before."""
    rows = ledger.groupBy("address_id").agg(F.min("tx_id").alias("a"), F.max("tx_id").alias("b"))
    return rows.filter(F.col("b") > after).select("address_id", (F.col("a") > after).alias("is_new"))


def trace_index(traces: DataFrame, block: str, order: list[str]) -> DataFrame:
    """Traces numbered from 0 inside their block."""
    return traces.withColumn("trace_index", F.row_number().over(Window.partitionBy(block).orderBy(*order)) - 1)


def by_prefix(table: DataFrame, column: str, length: int, size: int) -> DataFrame:
    """A table with the prefix of a hash and the group of its id, by which stored copies are partitioned."""
    return table.withColumns({f"{column}_prefix": ids.prefix(F.col(column), length), "tx_id_group": ids.id_group(F.col("tx_id"), size)})


def merged_pages(streams: list[DataFrame], order: str, limit: int, after: int | None = None, offset: int = 0) -> DataFrame:
    """One page over several ordered streams, such as directions or assets, from the highest ``order`` down.

    Each stream gives its own first rows, as many as the page could need, before they meet.
    """
    def first(df: DataFrame) -> DataFrame:
        rows = df if after is None else df.filter(F.col(order) < after)
        return rows.orderBy(F.desc(order), *[c for c in df.columns if c != order]).limit(limit + offset)

    rows = first(streams[0])
    for df in streams[1:]:
        rows = rows.unionByName(first(df))
    return rows.orderBy(F.desc(order), *[c for c in rows.columns if c != order]).offset(offset).limit(limit)


def highest(**tables: tuple[DataFrame, Column]) -> DataFrame:
    """(name, highest) of a column of each table."""
    out = None
    for name, (df, column) in tables.items():
        row = df.agg(F.max(column).cast("long").alias("highest")).select(F.lit(name).alias("name"), "highest")
        out = row if out is None else out.union(row)
    return out
