"""Swaps in the asset flows of a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def swaps(flows: DataFrame) -> DataFrame:
    """(tx_id, sender, asset_in, amount_in, asset_out, amount_out) of transactions that swap one asset for another.

    ``flows`` has tx_id, sender (who started the transaction), source, target, asset and
    amount. Flows are netted for each account and asset; a transaction is a swap if its
    sender ends with less of exactly one asset and more of exactly one other.
    """
    sides = flows.select("tx_id", "sender", F.col("source").alias("account"), "asset", (-F.col("amount")).alias("amount")).union(flows.select("tx_id", "sender", "target", "asset", "amount"))
    net = sides.filter("account = sender").groupBy("tx_id", "sender", "asset").agg(F.sum("amount").alias("amount")).filter("amount <> 0")
    lost, won = F.col("amount") < 0, F.col("amount") > 0
    per = net.groupBy("tx_id", "sender").agg(
        F.count(F.when(lost, 1)).alias("n_lost"),
        F.count(F.when(won, 1)).alias("n_won"),
        F.max(F.when(lost, F.col("asset"))).alias("asset_in"),
        (-F.sum(F.when(lost, F.col("amount")))).alias("amount_in"),
        F.max(F.when(won, F.col("asset"))).alias("asset_out"),
        F.sum(F.when(won, F.col("amount"))).alias("amount_out"),
    )
    return per.filter("n_lost = 1 and n_won = 1").drop("n_lost", "n_won")


def balanced(flows: DataFrame) -> DataFrame:
    """(tx_id, eulerian): whether every account of a transaction has as many flows in as out."""
    sides = flows.select("tx_id", F.col("source").alias("account"), F.lit(1).alias("d")).union(flows.select("tx_id", "target", F.lit(-1)))
    per = sides.groupBy("tx_id", "account").agg(F.sum("d").alias("d"))
    return per.groupBy("tx_id").agg((F.max(F.abs("d")) == 0).alias("eulerian"))
