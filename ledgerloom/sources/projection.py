"""A ledger made from star-schema tables, so that every operator can run on them.

Orders are transactions: a customer pays the suppliers of the order's lines. Every fifth
order is paid by two customers, every seventh gives a tenth back as change, every
fiftieth is a coinbase. Money is in whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ids, utxo
from ..operators.rates import block_rates
from ..plans.stage import cut, ship

DAY, EPOCH = 86_400, "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place n in the order and their price in cents."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    return rows.withColumn("n", F.row_number().over(place) - 1).withColumn("cents", cents("l_extendedprice"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested transactions of the UTXO model."""
    part = F.struct(F.array(F.concat(F.lit("S"), "l_suppkey")).alias("address"), F.col("cents").alias("value"), (F.col("l_suppkey") % 3).cast("int").alias("address_type"))
    paid = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("cents").alias("paid"), F.array_sort(F.collect_list(F.struct("n", part.alias("o")))).alias("each"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("people"))
    rows = orders.join(paid, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(customers))  # one row
    rows = rows.withColumn("change", F.when(F.col("o_orderkey") % 7 == 0, F.floor(F.col("paid") / 10)).otherwise(0).cast("long"))
    rows = rows.withColumn("total_output", F.col("paid") + F.col("change"))
    kind = "array<struct<address: array<string>, value: bigint, address_type: int>>"
    one = lambda key, value: F.struct(F.array(F.concat(F.lit("C"), key)).alias("address"), value.alias("value"), (key % 3).cast("int").alias("address_type"))
    me, next_ = F.col("o_custkey"), (F.col("o_custkey") + 1) % F.col("people")
    half = F.floor(F.col("total_output") / 2).cast("long")
    inputs = F.when(F.col("o_orderkey") % 5 == 0, F.array(one(me, F.col("total_output") - half), one(next_, half))).otherwise(F.array(one(me, F.col("total_output"))))
    back = F.when(F.col("change") > 0, F.array(one(me, F.col("change")))).otherwise(F.array().cast(kind))
    outputs = F.concat(F.transform("each", lambda x: x["o"]).cast(kind), back.cast(kind))
    block = F.datediff(F.col("o_orderdate").cast("date"), F.lit(EPOCH).cast("date"))
    rows = rows.select(
        F.col("o_orderkey").alias("order_key"),
        "o_orderdate",
        block.alias("block_id"),
        (F.lit(788_918_400) + block.cast("long") * DAY).alias("timestamp"),
        (F.col("o_orderkey") % 50 == 0).alias("coinbase"),
        F.col("total_output").alias("total_input"),
        "total_output",
        inputs.cast(kind).alias("inputs"),
        outputs.alias("outputs"),
    )
    rows = utxo.with_coinbase_input(rows)
    rows = rows.withColumn("coinjoin", utxo.coinjoin_flag(F.col("inputs"), F.col("outputs")))
    return ids.dense_ids(rows, ["o_orderdate", "order_key"], "tx_id").drop("o_orderdate")


def blocks(txs: DataFrame) -> DataFrame:
    return txs.select("block_id", "timestamp").distinct()


def daily_rates(spark: SparkSession) -> DataFrame:
    """Rates of weekdays from 1995 to 2002, as maps; weekends are missing."""
    days = spark.range(0, 2800).withColumn("day", F.date_add(F.lit(EPOCH).cast("date"), F.col("id").cast("int")))
    weekdays = days.filter(F.weekday("day") < 5)
    values = F.create_map(F.lit("EUR"), (100 + F.col("id") % 37).cast("double"), F.lit("USD"), (110 + F.col("id") % 41).cast("double"))
    return weekdays.select(F.date_format("day", "yyyy-MM-dd").alias("date"), values.alias("fiat_values"))


class Ledger:
    """The UTXO tables of a directory, each planned once.

    Tables that several others are made from are written as stages when they are first
    needed, and read from there; with ``keep`` all are.
    """

    STAGES = ("txs", "ids", "ledger", "plain", "clusters")

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark, self.sf_dir, self.keep, self._made = spark, sf_dir, keep, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(make(), name) if self.keep or name in self.STAGES else make()
        return self._made[name]

    txs = property(lambda self: self._once("txs", lambda: transactions(self.spark, self.sf_dir)))
    rates = property(lambda self: self._once("rates", lambda: block_rates(blocks(self.txs), daily_rates(self.spark), ["EUR", "USD"])))
    inputs = property(lambda self: self._once("inputs", lambda: utxo.regular_inputs(self.txs)))
    outputs = property(lambda self: self._once("outputs", lambda: utxo.regular_outputs(self.txs)))
    ids = property(lambda self: self._once("ids", lambda: utxo.address_ids(self.inputs, self.outputs)))
    ledger = property(lambda self: self._once("ledger", lambda: utxo.address_transactions(self.inputs, self.outputs, self.ids)))
    stats = property(lambda self: self._once("stats", lambda: utxo.statistics(self.ledger, self.rates, "address_id")))
    plain = property(lambda self: self._once("plain", lambda: utxo.plain_relations(self.txs, self.inputs, self.ledger)))
    edges = property(lambda self: self._once("edges", lambda: utxo.relations(self.plain, self.rates)))
    clusters = property(lambda self: self._once("clusters", lambda: utxo.address_clusters(self.txs, self.ids)))
    addresses = property(lambda self: self._once("addresses", lambda: utxo.addresses(self.stats, self.edges, self.ids, self.clusters)))
    cluster_ledger = property(lambda self: self._once("cluster_ledger", lambda: utxo.cluster_transactions(self.ledger, self.clusters)))
    cluster_plain = property(lambda self: self._once("cluster_plain", lambda: utxo.plain_cluster_relations(self.plain, self.clusters)))
    cluster_edges = property(lambda self: self._once("cluster_edges", lambda: utxo.cluster_relations(self.cluster_plain, self.rates)))
    cluster_stats = property(lambda self: self._once("cluster_stats", lambda: utxo.statistics(self.cluster_ledger, self.rates, "cluster_id")))
