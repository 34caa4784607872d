"""Queries over the account projection, each with SQL that computes it independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evm
from ..operators import account, ids
from ..sources.account_projection import AccountLedger

ACCOUNT_SQL = """
with ln as (
    select *, cast(round(l_extendedprice * 100) as bigint) cents,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 n
    from lineitem
), tx as (
    select o_orderkey k, o_custkey cust, date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id from orders where o_orderkey in (select l_orderkey from lineitem)
), txi as (
    select *, (block_id::bigint << 32) | (row_number() over (partition by block_id order by k) - 1) tx_id from tx
), tr as (
    select tx_id, block_id, n::int trace_index, 'C' || cust from_address, 'S' || l_suppkey to_address, case when l_discount = 0 then 0 else cents end as value,
        case when l_linenumber % 2 = 1 then p_brand end ticker, k % 97 + 1 fee
    from ln join txi on k = l_orderkey join part on p_partkey = l_partkey
), seen as (
    select from_address address, (block_id, ticker is not null, tx_id, trace_index, true) f from tr union all select to_address, (block_id, ticker is not null, tx_id, trace_index, false) from tr
), ids as (
    select address, row_number() over (order by min(f), address) address_id from seen group by address
), rates as (
    select distinct block_id, case when isodow(date '1995-01-01' + block_id) < 6 then (100 + block_id % 37)::double else 0.0 end eur,
        case when isodow(date '1995-01-01' + block_id) < 6 then (110 + block_id % 41)::double else 0.0 end usd from tr
), config as (
    select ticker, r, case when r <= 5 then 'usd' when r <= 10 then 'eur' when r <= 15 then 'native' end peg
    from (select p_brand ticker, row_number() over (order by p_brand) r from (select distinct p_brand from part))
), enc as (
    select t.*, a.address_id src_id, b.address_id dst_id, eur, usd, peg, r, block_id - block_id % 3 quoted
    from tr t join ids a on a.address = from_address join ids b on b.address = to_address join rates using (block_id) left join config using (ticker)
), valued as (
    select *, coalesce(ticker, 'coin') currency,
        value::double * case when ticker is null or peg = 'native' then eur when peg = 'usd' then case when usd = 0 then 0 else eur / usd end when peg = 'eur' then 1 else r + quoted % 5 end / 100 e,
        value::double * case when ticker is null or peg = 'native' then usd when peg = 'usd' then 1 when peg = 'eur' then case when eur = 0 then 0 else usd / eur end else r + 1 + quoted % 7 end / 100 u
    from enc
), sides as (
    select src_id address_id, dst_id other, true outgoing, * from valued union all select dst_id, src_id, false, * from valued
)
"""

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, made=None: f(made or AccountLedger(spark, sf_dir))
        SQL[f.__name__] = ACCOUNT_SQL + sql
        return f

    return add


def _fiat(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.get("fiat_values", F.lit(i)) for i, n in enumerate(("eur", "usd"))}).drop("fiat_values")


@query("select tx_id, block_id, trace_index, from_address, to_address, value, ticker, fee from tr")
def account_transfers(x: AccountLedger) -> DataFrame:
    return x.transfers


@query("select distinct tx_id, block_id, (tx_id & 4294967295)::int tx_index, (block_id // 150000)::int block_group, (tx_id // 25000 + 2147483648) % 4294967296 - 2147483648 wrapped from tr")
def account_transaction_ids(x: AccountLedger) -> DataFrame:
    tx = F.col("tx_id")
    rows = x.transfers.select("tx_id").distinct()
    index = tx.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    wrapped = (F.pmod(F.expr("tx_id div 25000") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("long")
    return rows.select(tx, ids.block_of(tx).alias("block_id"), index.alias("tx_index"), ids.block_group(ids.block_of(tx)).alias("block_group"), wrapped.alias("wrapped"))


@query("select address, address_id from ids")
def account_address_ids(x: AccountLedger) -> DataFrame:
    return x.ids


@query("select tx_id, block_id, trace_index, src_id, dst_id, value, e eur, u usd from valued where ticker is null")
def account_encoded_transactions(x: AccountLedger) -> DataFrame:
    return _fiat(x.encoded)


@query("select distinct ticker, block_id, (r + quoted % 5)::double eur, (r + 1 + quoted % 7)::double usd from enc where ticker is not null and peg is null")
def account_token_rates_as_of(x: AccountLedger) -> DataFrame:
    return x.own_rates.select("ticker", "block_id", F.get("own_rates", F.lit(0)).alias("eur"), F.get("own_rates", F.lit(1)).alias("usd"))


@query("select tx_id, block_id, trace_index, src_id, dst_id, ticker, value, e eur, u usd from valued where ticker is not null")
def account_encoded_token_transfers(x: AccountLedger) -> DataFrame:
    return _fiat(x.encoded_tokens)


@query(
    """, fees as (select tx_id, any_value(from_address) payer, 'M' || (block_id % 7) miner, any_value(fee) fee from tr group by tx_id, block_id), signed as (
    select to_address address, coalesce(ticker, 'coin') currency, value from tr union all select from_address, coalesce(ticker, 'coin'), -value from tr
    union all select payer, 'coin', -fee from fees union all select miner, 'coin', fee - fee // 3 from fees)
    select address, currency, sum(value)::bigint balance from signed group by all"""
)
def account_balances(x: AccountLedger) -> DataFrame:
    out = account.balances(x.coin, x.tokens, x.fees)
    return out.withColumn("balance", F.col("balance").cast("long"))


@query("select distinct block_id, tx_id, (block_id // 150000)::int block_id_group from tr")
def account_block_transactions(x: AccountLedger) -> DataFrame:
    return account.block_transactions(x.transfers)


@query(
    """select address_id, tx_id, block_id, currency, outgoing is_outgoing, case when ticker is null then trace_index end trace_index, case when ticker is not null then trace_index end log_index,
    (address_id // 25000)::int address_id_group, (block_id // 150000)::int block_id_group from sides"""
)
def account_address_transactions(x: AccountLedger) -> DataFrame:
    out = account.address_transactions(x.encoded, x.encoded_tokens)
    return out.select("*", "tx_reference.trace_index", "tx_reference.log_index").drop("tx_reference")


@query(
    """select address_id, min(tx_id) first_tx_id, max(tx_id) last_tx_id, count(*) filter (where not outgoing)::int no_incoming_txs, count(*) filter (where outgoing)::int no_outgoing_txs,
    count(*) filter (where not outgoing and value = 0)::int no_incoming_txs_zero_value, count(*) filter (where outgoing and value = 0)::int no_outgoing_txs_zero_value,
    count(distinct other) filter (where not outgoing)::int in_degree, count(distinct other) filter (where outgoing)::int out_degree,
    count(distinct other) filter (where not outgoing and value = 0)::int in_degree_zero_value, count(distinct other) filter (where outgoing and value = 0)::int out_degree_zero_value,
    coalesce(sum(value) filter (where currency = 'coin' and not outgoing), 0)::bigint total_received, coalesce(sum(value) filter (where currency = 'coin' and outgoing), 0)::bigint total_spent,
    count(distinct ticker) filter (where not outgoing)::int tokens_received, any_value(address like 'S%' and try_cast(substr(address, 2) as int) % 4 = 0) is_contract, (address_id // 25000)::int address_id_group
    from sides join ids using (address_id) group by address_id"""
)
def account_addresses(x: AccountLedger) -> DataFrame:
    return x.addresses.withColumn("tokens_received", F.size("total_tokens_received")).drop("total_tokens_received", "total_tokens_spent")


@query("select address_id, outgoing, currency ticker, sum(value)::bigint as value, floor(sum(e) + 0.0037)::bigint whole_eur from sides where ticker is not null group by address_id, outgoing, currency")
def account_token_totals(x: AccountLedger) -> DataFrame:
    sides = [x.addresses.select("address_id", F.lit(out).alias("outgoing"), F.explode(c).alias("ticker", "c")) for c, out in (("total_tokens_received", False), ("total_tokens_spent", True))]
    return sides[0].union(sides[1]).select("address_id", "outgoing", "ticker", "c.value", F.floor(F.get("c.fiat_values", F.lit(0)) + 0.0037).alias("whole_eur"))


@query(
    """select src_id, dst_id, count(*)::int no_transactions, coalesce(sum(value) filter (where ticker is null), 0)::bigint as value, count(distinct ticker)::int tokens,
    coalesce(sum(value) filter (where ticker is not null), 0)::bigint token_value, (src_id // 25000)::int src_id_group, (dst_id // 25000)::int dst_id_group,
    (src_id % 100)::int src_id_secondary_group, (dst_id % 100)::int dst_id_secondary_group from valued group by src_id, dst_id"""
)
def account_address_relations(x: AccountLedger) -> DataFrame:
    values = F.map_values("token_values")
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, c: a + c["value"])
    return x.edges.withColumns({"tokens": F.size("token_values"), "token_value": total}).drop("token_values")


@query(
    """, g as (select address_id, address_id % 10 grp from ids), s as (select grp, count(*) n from (select address_id % 7 * (address_id % 3) grp from sides) group by grp),
    m as (select median(n) * 2.5 lim from s) select grp, n rows, greatest(1, ceil(n / lim))::int pieces from s, m"""
)
def account_secondary_groups(x: AccountLedger) -> DataFrame:
    rows = account.address_transactions(x.encoded, x.encoded_tokens).select("tx_id", "address_id", (F.col("address_id") % 7 * (F.col("address_id") % 3)).alias("grp"))
    cut = ids.skewed_secondary_ids(rows, "grp", "tx_id")
    return cut.groupBy("grp").agg(F.count("*").alias("rows"), (F.max("secondary_group") + 1).alias("pieces"))


@query("select address_id // 1000 grp, max((src_id % 100)::int) max_secondary_id from (select src_id, src_id address_id from valued) group by grp having max(src_id % 100) > 0")
def account_secondary_lookup(x: AccountLedger) -> DataFrame:
    rows = x.edges.select(F.expr("src_id div 1000").alias("grp"), "src_id_secondary_group")
    return ids.secondary_lookup(rows, "grp", "src_id_secondary_group")


@query("select max(block_id) + 1 no_blocks, count(distinct tx_id) no_transactions, (select count(*) from ids) no_addresses, (select count(*) from (select distinct src_id, dst_id from valued)) no_address_relations from tr")
def account_summary_statistics(x: AccountLedger) -> DataFrame:
    return account.summary(x.transfers, x.addresses, x.edges)


@query("select tx_id, trace_index, ticker, lower(lpad(hex(from_address), 40, '0')) from_address, lower(lpad(hex(to_address), 40, '0')) to_address, value from tr where ticker is not null")
def token_transfer_decode(x: AccountLedger) -> DataFrame:
    """Transfers written as event logs and decoded again."""
    topic = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("binary")), 64, "0"))
    contract = F.lower(F.lpad(F.hex(F.col("ticker").cast("binary")), 40, "0"))
    logs = x.tokens.select("tx_id", "trace_index", contract.alias("address"), F.array(F.lit(evm.TRANSFER), topic("from_address"), topic("to_address")).alias("topics"), F.lpad(F.hex("value"), 64, "0").alias("data"))
    known = x.config.select(contract.alias("contract"), "ticker")
    return evm.decode_transfers(logs, known).drop("address").withColumn("value", F.col("value").cast("long"))
