"""An account ledger made from the same tables: each order line is a transfer.

Lines with an even number move the coin, the others the token of the part's brand; a line
without discount moves nothing. Every order pays a fee to the miner of its block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import account, ids
from ..operators.rates import as_of
from ..plans.stage import cut
from . import projection

COIN_DIVISOR, TOKEN_DIVISOR = 100.0, 100.0


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = projection.lines(spark, sf_dir)
    parts = projection.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = projection.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.join(lines.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    block = F.datediff(F.col("o_orderdate").cast("date"), F.lit(projection.EPOCH).cast("date"))
    inside = Window.partitionBy("block_id").orderBy("o_orderkey")
    txs = orders.withColumn("block_id", block).withColumn("tx_index", F.row_number().over(inside) - 1)
    rows = lines.join(txs, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        ids.transaction_id(F.col("block_id"), F.col("tx_index")).alias("tx_id"),
        "block_id",
        F.col("n").alias("trace_index"),
        F.concat(F.lit("C"), "o_custkey").alias("from_address"),
        F.concat(F.lit("S"), "l_suppkey").alias("to_address"),
        F.when(F.col("l_discount") == 0, 0).otherwise(F.col("cents")).cast("long").alias("value"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("p_brand")).alias("ticker"),
        (F.col("o_orderkey") % 97 + 1).alias("fee"),
    )


class AccountLedger:
    """The account tables of a directory, each planned once, and with ``keep`` written as stages and read from there."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark, self.sf_dir, self.keep, self._made = spark, sf_dir, keep, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(make(), name) if self.keep else make()
        return self._made[name]

    transfers = property(lambda self: self._once("transfers", lambda: transfers(self.spark, self.sf_dir)))
    coin = property(lambda self: self.transfers.filter("ticker is null").drop("ticker", "fee"))
    tokens = property(lambda self: self.transfers.filter("ticker is not null").drop("fee"))
    ids = property(lambda self: self._once("ids", lambda: account.address_ids(self.coin, self.tokens)))

    @property
    def rates(self) -> DataFrame:
        return projection.block_rates(self.transfers.select("block_id", (F.lit(788_918_400) + F.col("block_id").cast("long") * projection.DAY).alias("timestamp")).distinct(), projection.daily_rates(self.spark), ["EUR", "USD"])

    @property
    def config(self) -> DataFrame:
        """Tickers in order: five on the dollar, five on the euro, five on the coin, the others without a peg."""
        brands = projection.table(self.spark, self.sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
        rank = F.row_number().over(Window.orderBy("ticker"))
        peg = F.when(F.col("rank") <= 5, "usd").when(F.col("rank") <= 10, "eur").when(F.col("rank") <= 15, "native")
        return brands.withColumn("rank", rank).select("ticker", "rank", F.lit(TOKEN_DIVISOR).alias("divisor"), peg.alias("peg"))

    @property
    def own_rates(self) -> DataFrame:
        """Rates of tokens without a peg: quoted every third block, otherwise the latest quote."""
        wanted = self.tokens.join(self.config.filter("peg is null").select("ticker"), "ticker", "left_semi").select("ticker", "block_id").distinct()
        blocks = self.spark.range(0, 2800, 3).select(F.col("id").cast("int").alias("block_id"))
        quotes = self.config.filter("peg is null").crossJoin(blocks)  # tokens of the configuration times days
        values = F.array((F.col("rank") + F.col("block_id") % 5).cast("double"), (F.col("rank") + 1 + F.col("block_id") % 7).cast("double"))
        return as_of(wanted, quotes.select("ticker", "block_id", values.alias("own_rates")), "ticker", "block_id", "own_rates")

    encoded = property(lambda self: self._once("encoded", lambda: account.encoded(self.coin, self.ids, self.rates, COIN_DIVISOR)))
    encoded_tokens = property(lambda self: self._once("encoded_tokens", lambda: account.encoded_tokens(self.tokens, self.ids, self.rates, self.config.drop("rank"), self.own_rates)))
    contracts = property(lambda self: self.ids.filter("address like 'S%' and cast(substring(address, 2) as int) % 4 = 0").select("address_id"))
    addresses = property(lambda self: self._once("addresses", lambda: account.addresses(self.encoded, self.encoded_tokens, self.contracts)))
    edges = property(lambda self: self._once("edges", lambda: account.relations(self.encoded, self.encoded_tokens)))

    @property
    def fees(self) -> DataFrame:
        each = self.transfers.groupBy("tx_id", "block_id").agg(F.first("from_address").alias("payer"), F.first("fee").alias("fee"))
        return each.select("payer", F.concat(F.lit("M"), F.col("block_id") % 7).alias("miner"), "fee", F.floor(F.col("fee") / 3).cast("long").alias("burnt"))
