"""Numbers, addresses and events of account chains, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes of the events that are decoded, and what they mean.
TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

#: Call types whose value doesn't move.
NO_VALUE_CALLS = ("delegatecall", "callcode", "staticcall")
_LIMB = 12


def uint(digits: Column) -> Column:
    """Hexadecimal digits as decimal(38,0); null if there are none, or for numbers of more than 38 digits.

    Read in limbs of 12 digits, which fit 64 bits with their product by 2**48 in a decimal.
    Zeros in front are skipped by an expression, as trimming goes through them one by one.
    """
    padded = F.lpad(F.substring(digits, -3 * _LIMB, 3 * _LIMB), 3 * _LIMB, "0")
    big = lambda at: F.conv(F.substring(padded, 1 + at * _LIMB, _LIMB), 16, 10).cast("decimal(38,0)")
    base = F.lit(2**48).cast("decimal(15,0)")
    step = F.try_add(F.try_multiply(big(0), base).cast("decimal(38,0)"), big(1))
    whole = F.try_add(F.try_multiply(step.cast("decimal(23,0)"), base).cast("decimal(38,0)"), big(2))
    return F.when(digits.rlike("^0*[0-9a-fA-F]{1,31}$"), whole.cast("decimal(38,0)"))


def address_of(topic: Column) -> Column:
    """The last 20 of a topic's 32 bytes, as lower-case digits."""
    return F.lower(F.substring(topic, 25, 40))


def decode_transfers(logs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Transfers from logs (address, topics and data as hex digits) of known contracts.

    A log with another event, fewer than three topics or data that is no number is left
    out. ``contracts`` (contract, ticker) lists known ones.
    """
    known = logs.filter(F.get("topics", F.lit(0)) == TRANSFER).join(contracts, F.lower("address") == F.lower("contract"))
    out = known.withColumns({"from_address": address_of(F.get("topics", F.lit(1))), "to_address": address_of(F.get("topics", F.lit(2))), "value": uint(F.col("data"))})
    return out.filter("from_address is not null and to_address is not null and value is not null").drop("topics", "data", "contract")


def undecodable(logs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Transfer logs of known contracts that decode_transfers leaves out."""
    known = logs.filter(F.get("topics", F.lit(0)) == TRANSFER).join(contracts, F.lower("address") == F.lower("contract"), "left_semi")
    return known.filter(F.get("topics", F.lit(2)).isNull() | uint(F.col("data")).isNull())


def withdrawals(blocks: DataFrame) -> DataFrame:
    """Reward traces of a block's withdrawals: amounts in 10**9 units of the coin's least one, indexes from 10**9 on."""
    each = blocks.select("block_id", F.posexplode("withdrawals").alias("at", "w"))
    amount = (F.col("w.amount").cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)")
    return each.select("block_id", (F.col("at") + 10**9).alias("trace_index"), F.col("w.address").alias("to_address"), amount.alias("value"), F.lit("reward").alias("trace_type"))


def failed_by_parent(traces: DataFrame) -> DataFrame:
    """Traces with status 0 if they or a trace above them failed.

    ``trace_address`` is the path of a trace in its transaction's tree, empty for the root.
    Each trace looks up its ancestors' paths, as many as it is deep.
    """
    path = F.col("trace_address")
    above = F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, F.lit(1), n))
    each = traces.select("tx_hash", path, F.explode(above).alias("ancestor"))
    failed = traces.filter("status = 0").select("tx_hash", F.col("trace_address").alias("ancestor"))
    bad = each.join(failed, ["tx_hash", "ancestor"], "left_semi").select("tx_hash", "trace_address").distinct().withColumn("_bad", F.lit(True))
    return traces.join(bad, ["tx_hash", "trace_address"], "left").withColumn("status", F.when(F.col("_bad"), 0).otherwise(F.col("status"))).drop("_bad")
