"""Ledgers whose transactions have many inputs and many outputs.

A transaction is a row with tx_id, block_id, timestamp, coinbase, coinjoin, total_input,
total_output and arrays inputs and outputs of (address array, value, address_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from . import ids
from .components import connected_components

FIAT = 2


def with_coinbase_input(txs: DataFrame) -> DataFrame:
    """Coinbase transactions get one input, of all they pay out, from the pseudo-address ``coinbase``."""
    kind = txs.schema["inputs"].dataType.simpleString()
    pseudo = F.array(F.struct(F.array(F.lit("coinbase")).alias("address"), F.col("total_output").alias("value"), F.lit(0).alias("address_type"))).cast(kind)
    return txs.withColumn("inputs", F.when(F.col("coinbase"), pseudo).otherwise(F.col("inputs")))


def regular_inputs(txs: DataFrame) -> DataFrame:
    """Inputs of exactly one address, summed per transaction and address."""
    each = txs.select("tx_id", "block_id", "timestamp", "coinjoin", F.explode("inputs").alias("i")).filter(F.size("i.address") == 1)
    keys = ["tx_id", "block_id", "timestamp", "coinjoin", F.get("i.address", F.lit(0)).alias("address")]
    return each.groupBy(*keys).agg(F.sum("i.value").alias("value"))


def regular_outputs(txs: DataFrame) -> DataFrame:
    """Outputs of exactly one address with their place n."""
    each = txs.select("tx_id", "block_id", "timestamp", "coinjoin", F.posexplode("outputs").alias("n", "o")).filter(F.size("o.address") == 1)
    return each.select("tx_id", "block_id", "timestamp", "coinjoin", F.get("o.address", F.lit(0)).alias("address"), F.col("o.value").alias("value"), "n")


def address_ids(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(address, address_id): ids from 1 in the order of first appearance; 0 is the coinbase."""
    seen = inputs.select("address", "tx_id", F.lit(-1).alias("n")).union(outputs.select("address", "tx_id", "n")).filter("address <> 'coinbase'")
    first = seen.groupBy("address").agg(F.min(F.struct("tx_id", "n")).alias("first"))
    numbered = ids.dense_ids(first, ["first.tx_id", "first.n", "address"], "address_id", 1).select("address", "address_id")
    spark = inputs.sparkSession
    return numbered.union(spark.createDataFrame([("coinbase", 0)], "address string, address_id long"))


def address_transactions(inputs: DataFrame, outputs: DataFrame, id_table: DataFrame) -> DataFrame:
    """The ledger: net value per transaction and address, inputs negative."""
    flows = inputs.select("tx_id", "block_id", "address", (-F.col("value")).alias("value")).unionByName(outputs.select("tx_id", "block_id", "address", "value"))
    net = flows.groupBy("tx_id", "address").agg(F.min("block_id").alias("block_id"), F.sum("value").alias("value"))
    out = net.join(id_table, "address").select("address_id", "tx_id", "block_id", "value", (F.col("value") < 0).alias("is_outgoing"))
    return out.withColumn("address_id_group", ids.id_group(F.col("address_id")))


def split(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spent, received), both positive; what nets to nothing is in neither."""
    return ledger.filter("value < 0").withColumn("value", -F.col("value")), ledger.filter("value > 0")


def with_fiat(rows: DataFrame, rates: DataFrame, value: str = "value", fiat: str = "fiat_values") -> DataFrame:
    """Fiat values by the block's rates; zeros where a block has none."""
    none = F.array(*[F.lit(0.0)] * FIAT)
    joined = rows.join(rates.select("block_id", F.col("fiat_values").alias("_rates")), "block_id", "left")
    return joined.withColumn(fiat, money.utxo_fiat(F.col(value), F.coalesce("_rates", none))).drop("_rates")


def statistics(ledger: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """First and last transaction, counts and totals received and spent of each ``key``.

    One pass: received and spent are conditional sums over the ledger, so no joins of
    separately grouped sides are needed.
    """
    rows = with_fiat(ledger.withColumn("amount", F.abs("value")), rates, "amount")
    incoming, outgoing = F.col("value") > 0, F.col("value") < 0

    def total(side: Column) -> list[Column]:
        fiat = [F.coalesce(F.sum(F.when(side, F.get("fiat_values", F.lit(i)))), F.lit(0.0)) for i in range(FIAT)]
        return [F.coalesce(F.sum(F.when(side, F.col("amount"))), F.lit(0)).cast("long"), *fiat]

    received, spent = total(incoming), total(outgoing)
    return rows.groupBy(key).agg(
        F.min("tx_id").alias("first_tx_id"),
        F.max("tx_id").alias("last_tx_id"),
        ids.saturated(F.count(F.when(incoming, 1))).alias("no_incoming_txs"),
        ids.saturated(F.count(F.when(outgoing, 1))).alias("no_outgoing_txs"),
        received[0].alias("total_received"),
        F.array(*received[1:]).alias("total_received_fiat"),
        spent[0].alias("total_spent"),
        F.array(*spent[1:]).alias("total_spent_fiat"),
    )


def plain_relations(txs: DataFrame, inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Estimated flow between net senders and net receivers of each transaction.

    A sender's share is its net value over the transaction's input without what regular
    inputs get back: total input - regular inputs + net senders. Rounded half up; 0 where
    that base is 0.
    """
    spent, received = split(ledger)
    regular = inputs.groupBy("tx_id").agg(F.sum("value").alias("regular"))
    reduced = spent.groupBy("tx_id").agg(F.sum("value").alias("net"))
    base = txs.select("tx_id", "total_input").join(regular, "tx_id").join(reduced, "tx_id")
    base = base.select("tx_id", (F.col("total_input") - F.col("regular") + F.col("net")).alias("base"))
    a = spent.select("tx_id", "block_id", F.col("address_id").alias("src_id"), F.col("value").alias("in_value"))
    b = received.select("tx_id", F.col("address_id").alias("dst_id"), F.col("value").alias("out_value"))
    pairs = a.join(b, "tx_id").join(base, "tx_id")
    share = F.when(F.col("base") != 0, F.floor(F.col("in_value") / F.col("base") * F.col("out_value") + F.lit(0.5))).otherwise(0)
    return pairs.select("tx_id", "block_id", "src_id", "dst_id", share.cast("long").alias("estimated_value"))


def relations(plain: DataFrame, rates: DataFrame) -> DataFrame:
    """Edges: number of transactions, value and fiat values from src to dst, and their groups."""
    rows = with_fiat(plain, rates, "estimated_value")
    out = rows.groupBy("src_id", "dst_id").agg(ids.saturated(F.count("tx_id")).alias("no_transactions"), *money.sums("estimated_value", "fiat_values", FIAT))
    return out.withColumns({"src_id_group": ids.id_group(F.col("src_id")), "dst_id_group": ids.id_group(F.col("dst_id"))})


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``nodes`` with in_degree and out_degree, counting edges; every node of an edge is in the result."""
    sides = edges.select(F.col("src_id").alias(key), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst_id", F.lit(0), F.lit(1)))
    counted = sides.groupBy(key).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    joined = nodes.join(counted, key, "full")
    return joined.withColumns({c: ids.saturated(F.coalesce(c, F.lit(0))) for c in ("in_degree", "out_degree")})


def addresses(stats: DataFrame, edges: DataFrame, id_table: DataFrame, clusters: DataFrame) -> DataFrame:
    """The address table: statistics, degrees, address and cluster."""
    out = degrees(stats, edges, "address_id").join(id_table, "address_id").join(clusters, "address_id", "left")
    return out.withColumn("address_id_group", ids.id_group(F.col("address_id")))


def co_spends(txs: DataFrame, id_table: DataFrame, skip_coinjoin: bool = True) -> DataFrame:
    """Edges (u, v) from the least to every other address that one transaction spends from.

    All addresses of all inputs count, also of those with several. A null coinjoin flag is
    no coinjoin. A star per transaction is enough: it has the components of all its pairs.
    """
    rows = txs.filter(~F.coalesce("coinjoin", F.lit(False))) if skip_coinjoin else txs
    each = rows.filter(~F.coalesce("coinbase", F.lit(False))).select("tx_id", F.explode("inputs").alias("i")).select("tx_id", F.explode("i.address").alias("address")).distinct()
    member = each.join(id_table, "address").select("tx_id", "address_id")
    centre = member.groupBy("tx_id").agg(F.min("address_id").alias("u"))
    return member.join(centre, "tx_id").filter("address_id <> u").select("u", F.col("address_id").alias("v")).distinct()


def address_clusters(txs: DataFrame, id_table: DataFrame, skip_coinjoin: bool = True) -> DataFrame:
    """(address_id, cluster_id) for every address; the cluster is its least address, alone if never spent with another."""
    found = connected_components(co_spends(txs, id_table, skip_coinjoin)).select(F.col("node").alias("address_id"), F.col("component").alias("cluster_id"))
    alone = id_table.select("address_id").join(found, "address_id", "left_anti").withColumn("cluster_id", F.col("address_id"))
    return found.union(alone)


def cluster_addresses(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", "address_id", ids.id_group(F.col("cluster_id")).alias("cluster_id_group"))


def cluster_transactions(ledger: DataFrame, clusters: DataFrame) -> DataFrame:
    """The ledger of clusters: what moves inside one nets out."""
    net = ledger.join(clusters, "address_id").groupBy("tx_id", "cluster_id").agg(F.min("block_id").alias("block_id"), F.sum("value").alias("value"))
    return net.withColumns({"is_outgoing": F.col("value") < 0, "cluster_id_group": ids.id_group(F.col("cluster_id"))})


def plain_cluster_relations(plain: DataFrame, clusters: DataFrame) -> DataFrame:
    src = clusters.select(F.col("address_id").alias("src_id"), F.col("cluster_id").alias("src_cluster"))
    dst = clusters.select(F.col("address_id").alias("dst_id"), F.col("cluster_id").alias("dst_cluster"))
    joined = plain.join(src, "src_id", "left").join(dst, "dst_id", "left")
    out = joined.groupBy("block_id", "tx_id", "src_cluster", "dst_cluster").agg(F.sum("estimated_value").alias("estimated_value"))
    return out.select("block_id", "tx_id", F.col("src_cluster").alias("src_id"), F.col("dst_cluster").alias("dst_id"), "estimated_value")


def cluster_relations(plain: DataFrame, rates: DataFrame) -> DataFrame:
    """As relations, and adjusted values, which are null for a cluster's edge to itself."""
    rows = with_fiat(plain, rates, "estimated_value")
    other = F.col("src_id") != F.col("dst_id")
    adjusted = [F.sum(F.when(other, F.get("fiat_values", F.lit(i)))) for i in range(FIAT)]
    return rows.groupBy("src_id", "dst_id").agg(
        ids.saturated(F.count("tx_id")).alias("no_transactions"),
        *money.sums("estimated_value", "fiat_values", FIAT),
        F.sum(F.when(other, F.col("estimated_value"))).alias("value_adj"),
        F.when(F.count(F.when(other, 1)) > 0, F.array(*adjusted)).alias("fiat_values_adj"),
    )


def clusters_table(stats: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """The cluster table: member count, statistics, degrees and totals without flows to itself."""
    sizes = members.groupBy("cluster_id").agg(ids.saturated(F.count("*")).alias("no_addresses"))
    known = sizes.join(stats, "cluster_id")
    other = edges.filter("src_id <> dst_id")
    sides = other.select(F.col("src_id").alias("cluster_id"), F.col("value").alias("s"), F.lit(0).cast("long").alias("r")).union(other.select("dst_id", F.lit(0).cast("long"), "value"))
    adjusted = sides.groupBy("cluster_id").agg(F.sum("r").alias("total_received_adj"), F.sum("s").alias("total_spent_adj"))
    linked = degrees(known.select("cluster_id"), edges, "cluster_id").join(adjusted, "cluster_id", "left")
    out = linked.join(known, "cluster_id", "right")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("total_received_adj", "total_spent_adj")})


def summary(txs: DataFrame, address_table: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of heights and counts."""
    heights = txs.agg((F.max("block_id") + 1).cast("int").alias("no_blocks"), (F.max("tx_id") + 1).alias("no_transactions"), F.max("timestamp").alias("timestamp"))
    counts = [address_table.agg(F.count("*").alias("no_addresses")), edges.agg(F.count("*").alias("no_address_relations")), clusters.agg(F.count_distinct("cluster_id").alias("no_clusters"))]
    for one in counts:
        heights = heights.crossJoin(one)  # one row each
    return heights


def coinjoin_flag(inputs: Column, outputs: Column) -> Column:
    """Shape of a coin-mixing transaction, from its inputs and outputs alone.

    Two inputs and three outputs or more; the participants, half the outputs rounded up, are
    no more than the inputs nor than their distinct address lists; the most frequent output
    value (the least of ties) occurs once for each participant and isn't a dust amount.
    """
    n_in, n_out = F.size(inputs), F.size(outputs)
    people = F.floor((n_out + 1) / 2).cast("int")
    senders = F.size(F.array_distinct(F.transform(inputs, lambda i: i["address"])))
    values = F.transform(outputs, lambda o: o["value"])
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda w: w == v))).alias("n"), v.alias("v")))
    common = F.array_min(counted)
    shape = (n_in >= 2) & (n_out >= 3) & (people <= n_in) & (people <= senders)
    return F.when(shape, (-common["n"] == people) & ~common["v"].isin(*DUST)).otherwise(False)


#: Dust amounts that no mixing round pays out.
DUST = (546, 2730)
