"""What differs for a chain whose transactions carry value beside their internal traces.

Transactions have tx_hash, block_id, transaction_index, from_address, to_address, value, fee,
receipt_status, receipt_contract_address and transaction_type; traces have tx_hash,
block_id, trace_index, caller_address, transferto_address, call_value, note, rejected and
call_token_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import account, ids

#: Notes of internal calls and of those that make a contract, units of a coin.
CALL, CREATE, COIN = "call", "create", 1e6


def moving_traces(traces: DataFrame) -> DataFrame:
    """Traces that were carried out, are calls, and move the coin and no other token. A null rejected flag is none."""
    return traces.filter(~F.coalesce("rejected", F.lit(False)) & (F.col("note") == CALL) & F.col("call_token_id").isNull())


def creating_traces(traces: DataFrame) -> DataFrame:
    return traces.filter(~F.coalesce("rejected", F.lit(False)) & (F.col("note") == CREATE))


def known_receivers(txs: DataFrame) -> DataFrame:
    """Transactions with a receiver; creations go to the contract that they made."""
    return account.with_created_address(txs).filter("to_address is not null")


def address_ids(txs: DataFrame, traces: DataFrame, tokens: DataFrame, most_in_a_block: int) -> DataFrame:
    """(address, address_id) from 1 in the order of first appearance.

    Inside a block transactions come before traces, as their index less ``most_in_a_block``
    is below any trace's, and traces before logs; a receiver comes before its sender.
    """

    def seen(df: DataFrame, log: bool, index: Column, src: str, dst: str) -> DataFrame:
        sides = [df.select(F.col(c).alias("address"), F.struct("block_id", F.lit(log).alias("log"), index.cast("long").alias("index"), F.lit(c == src).alias("sender")).alias("at")) for c in (src, dst)]
        return sides[0].union(sides[1]).filter("address is not null")

    rows = seen(txs, False, F.col("transaction_index") - most_in_a_block, "from_address", "to_address")
    rows = rows.union(seen(traces, False, F.col("trace_index"), "caller_address", "transferto_address"))
    rows = rows.union(seen(tokens, True, F.col("trace_index"), "from_address", "to_address"))
    first = rows.groupBy("address").agg(F.min("at").alias("at"))
    return ids.dense_ids(first, ["at", "address"], "address_id", 1).select("address", "address_id")


def address_ids_by_hash(addresses: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """(address, address_id): ids that need no order; raises while it runs if two addresses got one id."""
    made = ids.hash_ids(addresses, column, seed).withColumnRenamed(column, "address")
    shared = made.groupBy("address_id").agg(F.count("*").alias("n"), F.min("address").alias("address"), F.max("address").alias("other"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("one id for"), "address", F.lit("and"), "other"))
    return shared.withColumn("address", F.when(F.col("n") > 1, clash.cast("string")).otherwise(F.col("address"))).select("address", "address_id")


def contracts(txs: DataFrame, traces: DataFrame, id_table: DataFrame) -> DataFrame:
    """Ids of addresses that a successful transaction or a trace has created."""
    made = account.successful(txs).filter("receipt_contract_address is not null").select(F.col("receipt_contract_address").alias("address"))
    made = made.union(creating_traces(traces).select("transferto_address")).distinct()
    return made.join(id_table, "address").select("address_id")


def balances(txs: DataFrame, traces: DataFrame, tokens: DataFrame, coin_name: str = "coin") -> DataFrame:
    """(address, currency, balance): transactions and calls that went through, tokens, less the fees that senders pay; fees are burnt."""
    number = lambda c: c.cast("decimal(38,0)").alias("value")
    moved = account.successful(txs)
    calls = moving_traces(traces)
    rows = moved.select(F.col("to_address").alias("address"), F.lit(coin_name).alias("currency"), number(F.col("value")))
    rows = rows.union(moved.select("from_address", F.lit(coin_name), number(-F.col("value")))).union(txs.select("from_address", F.lit(coin_name), number(-F.col("fee"))))
    rows = rows.union(calls.select("transferto_address", F.lit(coin_name), number(F.col("call_value")))).union(calls.select("caller_address", F.lit(coin_name), number(-F.col("call_value"))))
    rows = rows.union(tokens.select("to_address", "ticker", number(F.col("value")))).union(tokens.select("from_address", "ticker", number(-F.col("value"))))
    return rows.filter("address is not null").groupBy("address", "currency").agg(F.sum("value").cast("decimal(38,0)").alias("balance"))


def encoded(txs: DataFrame, traces: DataFrame, id_table: DataFrame, rates: DataFrame) -> DataFrame:
    """Transactions (trace_index null) and moving traces as one table of transfers with address ids and fiat values.

    A table of rates grows with the blocks, so whether it is broadcast is left to its size.
    """
    tops = account.successful(txs).select("tx_hash", "block_id", F.lit(None).cast("int").alias("trace_index"), "from_address", "to_address", "value")
    calls = moving_traces(traces).select("tx_hash", "block_id", F.col("trace_index").cast("int"), "caller_address", "transferto_address", "call_value")
    return account.encoded(tops.union(calls), id_table, rates, COIN)
