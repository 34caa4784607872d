"""Queries over the UTXO projection, each with SQL that computes it independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ids, rates, utxo
from ..sources.projection import Ledger, blocks, daily_rates

LEDGER_SQL = """
with recursive ln as (
    select l_orderkey k, l_suppkey supp, cast(round(l_extendedprice * 100) as bigint) cents,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 n
    from lineitem
), paid as (
    select k, sum(cents)::bigint paid, count(*) lines from ln group by k
), people as (select count(*) people from customer
), base as (
    select row_number() over (order by o_orderdate, o_orderkey) - 1 tx_id, o_orderkey k, o_custkey cust, people,
        date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, paid, lines,
        case when o_orderkey % 7 = 0 then paid // 10 else 0 end change, o_orderkey % 50 = 0 coinbase
    from orders join paid on k = o_orderkey, people
), outs as (
    select tx_id, block_id, 'S' || supp address, cents as value, n, supp % 3 address_type from base join ln using (k)
    union all
    select tx_id, block_id, 'C' || cust, change, lines, cust % 3 from base where change > 0
), ins as (
    select tx_id, block_id, 'coinbase' address, paid + change as value, 0 address_type from base where coinbase
    union all
    select tx_id, block_id, 'C' || cust, case when k % 5 = 0 then paid + change - (paid + change) // 2 else paid + change end, cust % 3 from base where not coinbase
    union all
    select tx_id, block_id, 'C' || ((cust + 1) % people), (paid + change) // 2, (cust + 1) % people % 3 from base where not coinbase and k % 5 = 0
), value_counts as (
    select tx_id, value, count(*) c from outs group by all
), common as (
    select tx_id, max(c) c, min(value) filter (where c = top) v from (select *, max(c) over (partition by tx_id) top from value_counts) group by tx_id
), shape as (
    select tx_id, n_in, n_out, senders from (select tx_id, count(*) n_in, count(distinct address) senders from ins group by tx_id) join (select tx_id, count(*) n_out from outs group by tx_id) using (tx_id)
), txs as (
    select b.*, paid + change total_output, n_in, n_out,
        n_in >= 2 and n_out >= 3 and (n_out + 1) // 2 <= n_in and (n_out + 1) // 2 <= senders and c = (n_out + 1) // 2 and v not in (546, 2730) coinjoin
    from base b join shape using (tx_id) join common using (tx_id)
), reg_in as (
    select tx_id, block_id, address, sum(value)::bigint as value from ins group by all
), firsts as (
    select address, min((tx_id, n)) f from (select address, tx_id, -1 n from reg_in union all select address, tx_id, n from outs) where address <> 'coinbase' group by address
), ids as (
    select address, row_number() over (order by f, address) address_id from firsts union all select 'coinbase', 0
), rates as (
    select distinct block_id, case when isodow(date '1995-01-01' + block_id) < 6 then (100 + block_id % 37)::double else 0.0 end eur,
        case when isodow(date '1995-01-01' + block_id) < 6 then (110 + block_id % 41)::double else 0.0 end usd
    from base where block_id <= 2799
), ledger as (
    select address_id, tx_id, min(block_id) block_id, sum(value)::bigint as value from (
        select tx_id, block_id, address, -value as value from reg_in union all select tx_id, block_id, address, value from outs
    ) join ids using (address) group by address_id, tx_id
), valued as (
    select l.*, floor(abs(value) * coalesce(eur, 0.0) / 1e6 + 0.5) / 100.0 e, floor(abs(value) * coalesce(usd, 0.0) / 1e6 + 0.5) / 100.0 u
    from ledger l left join rates using (block_id)
), stats as (
    select address_id, min(tx_id) first_tx_id, max(tx_id) last_tx_id, count(*) filter (where value > 0)::int no_incoming_txs, count(*) filter (where value < 0)::int no_outgoing_txs,
        coalesce(sum(value) filter (where value > 0), 0)::bigint total_received, coalesce(-sum(value) filter (where value < 0), 0)::bigint total_spent
    from ledger group by address_id
), regular as (
    select tx_id, sum(value) regular from reg_in group by tx_id
), net as (
    select tx_id, sum(-value) net from ledger where value < 0 group by tx_id
), shares as (
    select tx_id, total_output - regular + net base from net join regular using (tx_id) join txs using (tx_id)
), plain as (
    select a.tx_id, a.block_id, a.address_id src_id, b.address_id dst_id,
        case when base <> 0 then floor((-a.value)::bigint / base::bigint * b.value + 0.5)::bigint else 0 end estimated_value
    from ledger a join ledger b using (tx_id) join shares using (tx_id) where a.value < 0 and b.value > 0
), edges as (
    select src_id, dst_id, count(*)::int no_transactions, sum(estimated_value)::bigint as value from plain group by all
), spent_together as (
    select distinct cust i from txs where k % 5 = 0 and not coinbase and not coinjoin
), rings as (
    select r.i, sum(case when s.i is null then 1 else 0 end) over (order by r.i) grp
    from (select range i from range(0, (select people from people))) r left join spent_together s on s.i = (r.i - 1 + (select people from people)) % (select people from people)
), members as (
    select address_id, case when grp = 0 then max(grp) over () else grp end grp from rings left join ids on address = 'C' || i
), clusters as (
    select address_id, min(address_id) over (partition by grp) cluster_id from members where address_id is not null
    union all
    select address_id, address_id from ids where address not like 'C%'
), cluster_ledger as (
    select cluster_id, tx_id, min(block_id) block_id, sum(value)::bigint as value from ledger join clusters using (address_id) group by cluster_id, tx_id
), cluster_plain as (
    select block_id, tx_id, s.cluster_id src_id, d.cluster_id dst_id, sum(estimated_value)::bigint estimated_value
    from plain p join clusters s on s.address_id = p.src_id join clusters d on d.address_id = p.dst_id group by all
)
"""

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Register a query of a Ledger under its own name, with the SELECT that follows LEDGER_SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, made=None: f(made or Ledger(spark, sf_dir))
        if sql:
            SQL[f.__name__] = LEDGER_SQL + sql
        return f

    return add


def _two(df: DataFrame, column: str, *names: str) -> DataFrame:
    """Array columns as one column for each currency, for comparing."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("select tx_id, block_id, k order_key, coinbase, coinjoin, total_output, n_in no_inputs, n_out no_outputs from txs")
def utxo_transactions(x: Ledger) -> DataFrame:
    sizes = (F.size("inputs").cast("long").alias("no_inputs"), F.size("outputs").cast("long").alias("no_outputs"))
    return x.txs.select("tx_id", "block_id", "order_key", "coinbase", "coinjoin", "total_output", *sizes)


@query("select block_id, eur, usd from rates")
def utxo_exchange_rates(x: Ledger) -> DataFrame:
    return _two(x.rates, "fiat_values", "eur", "usd")


@query("select tx_id, block_id, address, value from reg_in")
def utxo_regular_inputs(x: Ledger) -> DataFrame:
    return x.inputs.select("tx_id", "block_id", "address", "value")


@query("select tx_id, block_id, address, value, n::int n from outs")
def utxo_regular_outputs(x: Ledger) -> DataFrame:
    return x.outputs.select("tx_id", "block_id", "address", "value", F.col("n").cast("int").alias("n"))


@query("select address, address_id from ids")
def utxo_address_ids(x: Ledger) -> DataFrame:
    return x.ids


@query("select address_id, address, case when address like 'C%' then substr(address, 2, 3) else substr(address, 1, 3) end address_prefix, (address_id // 25000)::int address_id_group from ids")
def utxo_address_prefixes(x: Ledger) -> DataFrame:
    return x.ids.select("address_id", "address", ids.address_prefix(F.col("address"), 3, "C").alias("address_prefix"), ids.id_group(F.col("address_id")).alias("address_id_group"))


@query("select address_id, tx_id, block_id, value, value < 0 is_outgoing, (address_id // 25000)::int address_id_group from ledger")
def utxo_address_transactions(x: Ledger) -> DataFrame:
    return x.ledger


@query(
    """select address_id, min(tx_id) first_tx_id, max(tx_id) last_tx_id, count(*) filter (where value > 0)::int no_incoming_txs, count(*) filter (where value < 0)::int no_outgoing_txs,
    coalesce(sum(value) filter (where value > 0), 0)::bigint total_received, coalesce(-sum(value) filter (where value < 0), 0)::bigint total_spent,
    round(coalesce(sum(e) filter (where value > 0), 0), 2) received_eur, round(coalesce(sum(u) filter (where value < 0), 0), 2) spent_usd from valued group by address_id"""
)
def utxo_address_statistics(x: Ledger) -> DataFrame:
    received, spent = F.round(F.get("total_received_fiat", F.lit(0)), 2), F.round(F.get("total_spent_fiat", F.lit(1)), 2)
    return x.stats.withColumns({"received_eur": received, "spent_usd": spent}).drop("total_received_fiat", "total_spent_fiat")


@query("select tx_id, block_id, src_id, dst_id, estimated_value from plain")
def utxo_plain_address_relations(x: Ledger) -> DataFrame:
    return x.plain


@query(
    """select src_id, dst_id, count(*)::int no_transactions, sum(estimated_value)::bigint as value, round(sum(floor(estimated_value * coalesce(eur, 0.0) / 1e6 + 0.5) / 100.0), 2) eur,
    round(sum(floor(estimated_value * coalesce(usd, 0.0) / 1e6 + 0.5) / 100.0), 2) usd, (src_id // 25000)::int src_id_group, (dst_id // 25000)::int dst_id_group
    from plain left join rates using (block_id) group by src_id, dst_id"""
)
def utxo_address_relations(x: Ledger) -> DataFrame:
    return _two(x.edges, "fiat_values", "eur", "usd").withColumns({"eur": F.round("eur", 2), "usd": F.round("usd", 2)})


@query(
    """select address_id, address, cluster_id, first_tx_id, last_tx_id, no_incoming_txs, no_outgoing_txs, total_received, total_spent,
    (select count(*) from edges where dst_id = address_id)::int in_degree, (select count(*) from edges where src_id = address_id)::int out_degree
    from stats join ids using (address_id) join clusters using (address_id)"""
)
def utxo_addresses(x: Ledger) -> DataFrame:
    return x.addresses.drop("total_received_fiat", "total_spent_fiat", "address_id_group")


@query("select address_id, cluster_id from clusters")
def utxo_address_clusters(x: Ledger) -> DataFrame:
    return x.clusters


@query("select cluster_id, address_id, (cluster_id // 25000)::int cluster_id_group from clusters")
def utxo_cluster_addresses(x: Ledger) -> DataFrame:
    return utxo.cluster_addresses(x.clusters)


@query("select cluster_id, tx_id, block_id, value, value < 0 is_outgoing, (cluster_id // 25000)::int cluster_id_group from cluster_ledger")
def utxo_cluster_transactions(x: Ledger) -> DataFrame:
    return x.cluster_ledger


@query("select block_id, tx_id, src_id, dst_id, estimated_value from cluster_plain")
def utxo_plain_cluster_relations(x: Ledger) -> DataFrame:
    return x.cluster_plain


@query(
    """select src_id, dst_id, count(*)::int no_transactions, sum(estimated_value)::bigint as value, sum(estimated_value) filter (where src_id <> dst_id)::bigint value_adj
    from cluster_plain group by src_id, dst_id"""
)
def utxo_cluster_relations(x: Ledger) -> DataFrame:
    return x.cluster_edges.drop("fiat_values", "fiat_values_adj")


@query(
    """, ce as (select src_id, dst_id, sum(estimated_value)::bigint as value from cluster_plain group by src_id, dst_id),
    cs as (select cluster_id, min(tx_id) first_tx_id, max(tx_id) last_tx_id, count(*) filter (where value > 0)::int no_incoming_txs, count(*) filter (where value < 0)::int no_outgoing_txs,
        coalesce(sum(value) filter (where value > 0), 0)::bigint total_received, coalesce(-sum(value) filter (where value < 0), 0)::bigint total_spent from cluster_ledger group by cluster_id)
    select cluster_id, (select count(*) from clusters c where c.cluster_id = cs.cluster_id)::int no_addresses, first_tx_id, last_tx_id, no_incoming_txs, no_outgoing_txs, total_received, total_spent,
    (select count(*) from ce where dst_id = cluster_id)::int in_degree, (select count(*) from ce where src_id = cluster_id)::int out_degree,
    coalesce((select sum(value) from ce where dst_id = cluster_id and src_id <> dst_id), 0)::bigint total_received_adj,
    coalesce((select sum(value) from ce where src_id = cluster_id and src_id <> dst_id), 0)::bigint total_spent_adj from cs"""
)
def utxo_clusters(x: Ledger) -> DataFrame:
    return utxo.clusters_table(x.cluster_stats, x.clusters, x.cluster_edges).drop("total_received_fiat", "total_spent_fiat")


@query(
    """select max(block_id) + 1 no_blocks, max(tx_id) + 1 no_transactions, 788918400 + max(block_id)::bigint * 86400 as timestamp,
    (select count(*) from stats) no_addresses, (select count(*) from edges) no_address_relations, (select count(distinct cluster_id) from clusters) no_clusters from txs"""
)
def utxo_summary_statistics(x: Ledger) -> DataFrame:
    return utxo.summary(x.txs, x.stats, x.edges, x.clusters)


@query(
    """, runs as (select *, lag(block_id) over (order by block_id) b from (select distinct block_id from base)), islands as (select block_id, sum(case when b is null or block_id > b + 1 then 1 else 0 end) over (order by block_id) g from runs)
    select min(block_id) range_start, max(block_id) range_end from islands group by g"""
)
def processed_block_ranges(x: Ledger) -> DataFrame:
    from ..sources.lake import processed_ranges

    return processed_ranges(x.txs.select("block_id"), "block_id")


@query("select asked, max(block_id) filter (where ts <= asked) before_block, min(block_id) filter (where ts > asked) after_block from (select distinct block_id, 788918400 + block_id::bigint * 86400 ts from base), (values (788918400::bigint), (800000000), (850000001), (999999999), (1)) t(asked) group by asked")
def block_by_date(x: Ledger) -> DataFrame:
    times = x.spark.createDataFrame([(t,) for t in (788_918_400, 800_000_000, 850_000_001, 999_999_999, 1)], "asked long")
    return rates.block_before(blocks(x.txs), times)


@query(
    """, days as (select range as d from range(0, 2799)) select strftime(date '1995-01-01' + d::int, '%Y-%m-%d') as date,
    (100 + f % 37)::double eur, (110 + f % 41)::double usd from (select d, case isodow(date '1995-01-01' + d::int) when 6 then d - 1 when 7 then d - 2 else d end f from days) where f >= 1 and d >= 1"""
)
def rates_forward_filled(x: Ledger) -> DataFrame:
    out = rates.filled(daily_rates(x.spark).filter("date <= '2002-08-30'"))
    return out.select("date", F.try_element_at("fiat_values", F.lit("EUR")).alias("eur"), F.try_element_at("fiat_values", F.lit("USD")).alias("usd"))
