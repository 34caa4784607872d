"""Ledgers whose transfers have one sender and one receiver, in the coin or in tokens.

Transfers have tx_id, block_id, trace_index, from_address, to_address, value and, for
tokens, ticker. Transaction ids hold the block in their high 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.evm import NO_VALUE_CALLS
from . import ids

FIAT = 2



def successful(txs: DataFrame) -> DataFrame:
    return txs.filter(F.col("receipt_status") == 1)


def with_created_address(txs: DataFrame) -> DataFrame:
    """A contract creation without a receiver goes to the contract it made."""
    return txs.withColumn("to_address", F.coalesce("to_address", "receipt_contract_address"))


def value_txs(txs: DataFrame) -> DataFrame:
    """Transactions that move value between known accounts: creations and unknown receivers are out."""
    return txs.filter("receipt_contract_address is null and to_address is not null")


def address_ids(coin: DataFrame, tokens: DataFrame) -> DataFrame:
    """(address, address_id) from 1, in the order of (block, is a log, index, is a sender) of first appearance."""

    def seen(df: DataFrame, log: bool) -> DataFrame:
        sides = [df.select(F.col(c).alias("address"), F.struct("block_id", F.lit(log).alias("log"), "tx_id", "trace_index", F.lit(c == "from_address").alias("sender")).alias("at")) for c in ("from_address", "to_address")]
        return sides[0].union(sides[1]).filter("address is not null")

    first = seen(coin, False).union(seen(tokens, True)).groupBy("address").agg(F.min("at").alias("at"))
    return ids.dense_ids(first, ["at", "address"], "address_id", 1).select("address", "address_id")


def contracts(traces: DataFrame, id_table: DataFrame) -> DataFrame:
    """Ids of addresses that a successful trace has created."""
    made = traces.filter(F.col("trace_id").startswith("create") & (F.col("status") == 1)).select(F.col("to_address").alias("address")).distinct()
    return made.join(id_table, "address").select("address_id")


def _with_ids(df: DataFrame, id_table: DataFrame) -> DataFrame:
    src, dst = (id_table.select(F.col("address").alias(f"{s}_address"), F.col("address_id").alias(f"{t}_id")) for s, t in (("from", "src"), ("to", "dst")))
    return df.join(src, "from_address", "left").join(dst, "to_address", "left").drop("from_address", "to_address")


def encoded(coin: DataFrame, id_table: DataFrame, rates: DataFrame, divisor: float) -> DataFrame:
    """Transfers of the coin with address ids and fiat values; zeros where a block has no rate."""
    joined = _with_ids(coin, id_table).join(rates, "block_id", "left")
    none = F.array(*[F.lit(0.0)] * FIAT)
    return joined.withColumn("fiat_values", money.account_fiat(F.col("value"), F.coalesce("fiat_values", none), divisor))


def token_rates(transfers: DataFrame, config: DataFrame, daily: DataFrame, block_days: DataFrame) -> DataFrame:
    """(ticker, block_id, own_rates) of tokens without a peg, for the blocks they move in and days with a rate."""
    wanted = transfers.join(config.filter("peg is null").select("ticker"), "ticker", "left_semi").select("ticker", "block_id").distinct()
    return wanted.join(block_days, "block_id").join(daily, ["ticker", "date"]).select("ticker", "block_id", "own_rates")


def encoded_tokens(transfers: DataFrame, id_table: DataFrame, rates: DataFrame, config: DataFrame, own: DataFrame) -> DataFrame:
    """Token transfers with address ids and fiat values by their token's peg or own rate.

    ``config`` (ticker, divisor, peg) lists supported tokens.
    """
    joined = _with_ids(transfers, id_table).join(rates, "block_id", "left").join(config, "ticker", "left").join(own, ["ticker", "block_id"], "left")
    none = F.array(*[F.lit(0.0)] * FIAT)
    used = money.pegged_rates(F.coalesce("fiat_values", none), F.col("own_rates"), F.col("peg"))
    return joined.withColumn("fiat_values", F.transform(used, lambda r: F.col("value").cast("double") * r / F.col("divisor"))).drop("own_rates", "peg", "divisor")


def balances(coin: DataFrame, tokens: DataFrame, fees: DataFrame, coin_name: str = "coin") -> DataFrame:
    """(address, currency, balance): what came in less what went out, and fees.

    ``fees`` has payer, miner, fee and burnt: payers lose the fee, miners get it without the
    burnt part. Calls that move no value don't count; a null call type does. Signed rows
    are summed once, so no outer joins of separately grouped sides are needed.
    """
    moved = coin.filter(F.col("call_type").isNull() | ~F.col("call_type").isin(*NO_VALUE_CALLS)) if "call_type" in coin.columns else coin
    number = lambda c: c.cast("decimal(38,0)").alias("value")
    rows = moved.select(F.col("to_address").alias("address"), F.lit(coin_name).alias("currency"), number(F.col("value")))
    rows = rows.union(moved.select("from_address", F.lit(coin_name), number(-F.col("value"))))
    rows = rows.union(fees.select("payer", F.lit(coin_name), number(-F.col("fee")))).union(fees.select("miner", F.lit(coin_name), number(F.col("fee") - F.col("burnt"))))
    rows = rows.union(tokens.select("to_address", "ticker", number(F.col("value")))).union(tokens.select("from_address", "ticker", number(-F.col("value"))))
    return rows.filter("address is not null").groupBy("address", "currency").agg(F.sum("value").cast("decimal(38,0)").alias("balance"))


def block_transactions(transfers: DataFrame) -> DataFrame:
    return transfers.select("block_id", "tx_id").distinct().withColumn("block_id_group", ids.block_group(F.col("block_id")))


def address_transactions(coin: DataFrame, tokens: DataFrame, coin_name: str = "coin") -> DataFrame:
    """A row for each transfer and side, with what tells the transfer apart in its transaction."""
    both = coin.withColumn("currency", F.lit(coin_name)).select("tx_id", "block_id", "trace_index", F.lit(None).cast("int").alias("log_index"), "src_id", "dst_id", "currency")
    both = both.union(tokens.select("tx_id", "block_id", F.lit(None).cast("int"), F.col("trace_index").alias("log_index"), "src_id", "dst_id", F.col("ticker")))
    sides = [both.select(F.col(c).alias("address_id"), "tx_id", "block_id", "currency", F.lit(c == "src_id").alias("is_outgoing"), F.struct("trace_index", "log_index").alias("tx_reference")) for c in ("src_id", "dst_id")]
    out = sides[0].union(sides[1]).filter("address_id is not null")
    return out.withColumns({"address_id_group": ids.id_group(F.col("address_id")), "block_id_group": ids.block_group(F.col("block_id"))})


def _tokens(side: Column, amount: str, n: int) -> Column:
    return F.map_from_entries(F.collect_list(F.when(side, F.struct("currency", money.currency(F.col(amount), F.col("fiat"))))))


def addresses(coin: DataFrame, tokens: DataFrame, contract_ids: DataFrame, coin_name: str = "coin") -> DataFrame:
    """The address table: totals in the coin, totals by token, transactions, distinct neighbours, first and last use.

    Counts of transfers and degrees are over coin and tokens together, and again for
    transfers of nothing. Two groupings over one union of both sides: by address and
    currency for totals, by address and neighbour for the rest.
    """
    both = coin.withColumn("currency", F.lit(coin_name)).select("tx_id", "src_id", "dst_id", "currency", "value", "fiat_values")
    both = both.union(tokens.select("tx_id", "src_id", "dst_id", F.col("ticker"), "value", "fiat_values"))
    out = both.select(F.col("src_id").alias("address_id"), F.col("dst_id").alias("other"), F.lit(True).alias("outgoing"), "tx_id", "currency", "value", "fiat_values")
    rows = out.union(both.select("dst_id", "src_id", F.lit(False), "tx_id", "currency", "value", "fiat_values")).filter("address_id is not null")
    outgoing, incoming, nothing = F.col("outgoing"), ~F.col("outgoing"), F.col("value") == 0

    # Grouped by neighbour first, distinct counts are plain counts and rows aren't multiplied for them.
    pairs = rows.groupBy("address_id", "other", "outgoing").agg(F.min("tx_id").alias("first"), F.max("tx_id").alias("last"), F.count("*").alias("n"), F.count(F.when(nothing, 1)).alias("zero"))
    known, empty = F.col("other").isNotNull(), F.col("zero") > 0
    plain = pairs.groupBy("address_id").agg(
        F.min("first").alias("first_tx_id"),
        F.max("last").alias("last_tx_id"),
        *[ids.saturated(F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))).alias(f"no_{name}_txs{end}") for c, end in (("n", ""), ("zero", "_zero_value")) for name, side in (("incoming", incoming), ("outgoing", outgoing))],
        *[ids.saturated(F.count(F.when(side & known & test, 1))).alias(f"{name}_degree{end}") for test, end in ((F.lit(True), ""), (empty, "_zero_value")) for name, side in (("in", incoming), ("out", outgoing))],
    )
    fiat = F.array(*[F.sum(F.get("fiat_values", F.lit(i))) for i in range(FIAT)])
    each = rows.groupBy("address_id", "currency", "outgoing").agg(F.sum("value").alias("value"), fiat.alias("fiat"))
    native, token = F.col("currency") == coin_name, F.col("currency") != coin_name
    totals = each.groupBy("address_id").agg(
        *[F.coalesce(F.sum(F.when(native & side, F.col("value"))), F.lit(0)).alias(name) for name, side in (("total_received", incoming), ("total_spent", outgoing))],
        *[_tokens(token & side, "value", FIAT).alias(name) for name, side in (("total_tokens_received", incoming), ("total_tokens_spent", outgoing))],
    )
    flagged = plain.join(totals, "address_id").join(contract_ids.distinct().withColumn("is_contract", F.lit(True)), "address_id", "left")
    return flagged.withColumns({"is_contract": F.coalesce("is_contract", F.lit(False)), "address_id_group": ids.id_group(F.col("address_id"))})


def relations(coin: DataFrame, tokens: DataFrame, coin_name: str = "coin") -> DataFrame:
    """Edges: transfers in coin and tokens, value in the coin, values by token, groups and secondary groups."""
    both = coin.withColumn("currency", F.lit(coin_name)).select("src_id", "dst_id", "currency", "value", "fiat_values")
    both = both.union(tokens.select("src_id", "dst_id", F.col("ticker"), "value", "fiat_values")).filter("src_id is not null and dst_id is not null")
    fiat = F.array(*[F.sum(F.get("fiat_values", F.lit(i))) for i in range(FIAT)])
    each = both.groupBy("src_id", "dst_id", "currency").agg(F.count("*").alias("n"), F.sum("value").alias("value"), fiat.alias("fiat"))
    out = each.groupBy("src_id", "dst_id").agg(
        ids.saturated(F.sum("n")).alias("no_transactions"),
        F.coalesce(F.sum(F.when(F.col("currency") == coin_name, F.col("value"))), F.lit(0)).alias("value"),
        _tokens(F.col("currency") != coin_name, "value", FIAT).alias("token_values"),
    )
    groups = {"src_id_group": ids.id_group(F.col("src_id")), "dst_id_group": ids.id_group(F.col("dst_id"))}
    return out.withColumns(groups | {"src_id_secondary_group": ids.secondary_group(F.col("src_id")), "dst_id_secondary_group": ids.secondary_group(F.col("dst_id"))})


def summary(txs: DataFrame, address_table: DataFrame, edges: DataFrame) -> DataFrame:
    one = txs.agg((F.max("block_id") + 1).alias("no_blocks"), F.count_distinct("tx_id").alias("no_transactions"))
    return one.crossJoin(address_table.agg(F.count("*").alias("no_addresses"))).crossJoin(edges.agg(F.count("*").alias("no_address_relations")))  # one row each
