"""Look-up queries, with SQL that computes them independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abi
from ..operators import lookup, serving, tags
from ..sources.account_projection import AccountLedger
from ..sources.projection import Ledger, table
from .account_queries import ACCOUNT_SQL
from .utxo_queries import LEDGER_SQL

QUERIES, SQL, KINDS = {}, {}, {}


def query(kind, sql: str):
    """Register a query of a Ledger, an AccountLedger, or of (spark, sf_dir) if ``kind`` is None."""

    def add(f):
        QUERIES[f.__name__] = f if kind is None else lambda spark, sf_dir, made=None: f(made or kind(spark, sf_dir))
        KINDS[f.__name__] = kind
        SQL[f.__name__] = {Ledger: LEDGER_SQL, AccountLedger: ACCOUNT_SQL, None: ""}[kind] + sql
        return f

    return add


@query(AccountLedger, "select tx_id, from_address, to_address, value, coalesce(ticker, 'coin') currency from tr where to_address = 'S2'")
def account_normalized_transactions(x: AccountLedger) -> DataFrame:
    coin, tokens = (df.filter("to_address = 'S2'") for df in (x.coin, x.tokens))
    entries = coin.select("tx_id", "trace_index", F.lit(None).cast("int").alias("log_index"), F.lit("coin").alias("currency"))
    entries = entries.union(tokens.select("tx_id", F.lit(None).cast("int"), F.col("trace_index").alias("log_index"), F.col("ticker")))
    return lookup.normalized(entries, x.coin, x.tokens).select("tx_id", "from_address", "to_address", "value", "currency")


@query(AccountLedger, "select tx_id, trace_index, from_address, to_address, value, ticker from tr where tx_id = (select max(tx_id) from tr where from_address = 'C4') and value <> 0")
def transaction_asset_flows(x: AccountLedger) -> DataFrame:
    last = x.transfers.filter("from_address = 'C4'").agg(F.max("tx_id")).first()[0]
    return serving.asset_flows(x.transfers.drop("fee", "block_id"), last if last is not None else -1, with_zero=False)


@query(AccountLedger, "select address_id, outgoing, array_to_string(list_sort(list(distinct ticker)), ',') assets from sides where ticker is not null group by address_id, outgoing")
def account_token_assets(x: AccountLedger) -> DataFrame:
    return lookup.assets_of(x.edges).withColumn("assets", F.array_join("assets", ","))


_FIAT = "select address_id, tx_id, value, e eur, u usd from (select address_id, tx_id, value, round_even(value / 100.0::double * eur, 2) + 0.0 e, round_even(value / 100.0::double * usd, 2) + 0.0 u from ledger left join rates using (block_id))"


@query(Ledger, _FIAT)
def fiat_on_read(x: Ledger) -> DataFrame:
    rows = x.ledger.select("address_id", "tx_id", "block_id", "value")
    return lookup.in_fiat(rows, x.rates, 100.0, ["eur", "usd"]).drop("block_id")


@query(Ledger, """select cluster_id, count(*)::int no_addresses, min(address_id) min_address_id, min(first_tx_id) first_tx_id, max(last_tx_id) last_tx_id, sum(no_incoming_txs)::bigint no_incoming_txs,
    sum(no_outgoing_txs)::bigint no_outgoing_txs, sum(total_received)::bigint total_received, sum(total_spent)::bigint total_spent from clusters join stats using (address_id) group by cluster_id""")
def cluster_additive_statistics(x: Ledger) -> DataFrame:
    return lookup.cluster_sums(x.clusters, x.stats)


@query(Ledger, "select address_id from clusters c where cluster_id % 2 = 0 and cluster_id not in (select cluster_id from clusters where cluster_id % 4 = 0)")
def stale_cluster_rows(x: Ledger) -> DataFrame:
    old, new = (x.clusters.filter(f"cluster_id % {n} = 0") for n in (2, 4))
    return lookup.replaced(old, new, ["address_id"])[1]


@query(Ledger, "select address, address_id, cluster_id, (select count(*) from clusters d where d.cluster_id = c.cluster_id) cluster_size from ids join clusters c using (address_id) where address in ('C1', 'C9', 'S1', 'nobody')")
def clusters_of_subjects(x: Ledger) -> DataFrame:
    subjects = x.spark.createDataFrame([("C1",), ("C9",), ("S1",), ("C1",), ("nobody",)], "address string")
    return lookup.clusters_of(subjects, x.ids, x.clusters)


@query(Ledger, "select address_id, tx_id from ledger where value <> 0 and address_id % 7 = 0 and not ((value < 0 and (tx_id, address_id) in (select tx_id, address_id from outs join ids using (address))) or (value > 0 and (tx_id, address_id) in (select tx_id, address_id from reg_in join ids using (address))))")
def ledger_contradictions(x: Ledger) -> DataFrame:
    """Rows found when the sign of every seventh address is turned round; those on both sides of a transaction contradict nothing."""
    turned = x.ledger.withColumn("value", F.when(F.col("address_id") % 7 == 0, -F.col("value")).otherwise(F.col("value")))
    return lookup.contradictions(turned, x.inputs, x.outputs, x.ids).select("address_id", "tx_id")


@query(Ledger, """, sp as (select i.tx_id, max(o.tx_id) spent from (select distinct tx_id, address from ins) i join outs o on o.address = i.address and o.tx_id < i.tx_id group by i.tx_id, i.address),
    l0 as (select tx_id from txs where n_out >= 6), l1 as (select distinct spent tx_id from sp where tx_id in (select tx_id from l0) and spent not in (select tx_id from l0)),
    l2 as (select distinct spent tx_id from sp where tx_id in (select tx_id from l1) and spent not in (select tx_id from l0) and spent not in (select tx_id from l1))
    select tx_id, 0 as depth from l0 union all select tx_id, 1 from l1 union all select tx_id, 2 from l2""")
def transaction_lineage(x: Ledger) -> DataFrame:
    spending = serving.spending(x.txs, x.outputs)
    return lookup.lineage(spending, x.txs.filter("size(outputs) >= 6"), x.txs, 2)


@query(Ledger, "select address_id, min(tx_id) > (select max(tx_id) // 2 from txs) is_new from ledger group by address_id having max(tx_id) > (select max(tx_id) // 2 from txs)")
def touched_addresses(x: Ledger) -> DataFrame:
    half = x.txs.agg(F.floor(F.max("tx_id") / 2)).first()[0]
    return lookup.touched(x.ledger, half if half is not None else -1)


@query(Ledger, "select name, highest from (values ('block', (select max(block_id) from txs)::bigint), ('transaction', (select max(tx_id) from txs)), ('address', (select max(address_id) from ids)), ('cluster', (select max(cluster_id) from clusters))) t(name, highest)")
def highest_ids(x: Ledger) -> DataFrame:
    return lookup.highest(block=(x.txs, F.col("block_id")), transaction=(x.txs, F.col("tx_id")), address=(x.ids, F.col("address_id")), cluster=(x.clusters, F.col("cluster_id")))


@query(Ledger, "select tx_id, md5(k::varchar) tx_hash, upper(substr(md5(k::varchar), 1, 5)) tx_hash_prefix, (tx_id // 1000)::int tx_id_group from txs where md5(k::varchar) like 'a%'")
def search_transactions(x: Ledger) -> DataFrame:
    hashed = x.txs.select("tx_id", F.md5(F.col("order_key").cast("string").cast("binary")).alias("tx_hash"))
    return lookup.by_prefix(hashed, "tx_hash", 5, 1000).filter(F.col("tx_hash").startswith("a"))


@query(Ledger, """, busy as (select address_id from ledger where address_id <> 0 group by address_id having min(value) < 0 and max(value) > 0 order by count(*) desc, address_id limit 1)
    select tx_id, side, value from (select tx_id, 'in' side, value from ledger where address_id = (select address_id from busy) and value > 0 union all select tx_id, 'out', value from ledger where address_id = (select address_id from busy) and value < 0)
    where tx_id < (select max(tx_id) from txs) order by tx_id desc, side, value limit 6 offset 2""")
def merged_transaction_pages(x: Ledger) -> DataFrame:
    """A page of the incoming and outgoing transactions of the busiest address that has both."""
    both = x.ledger.filter("address_id <> 0").groupBy("address_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < 0 and hi > 0")
    busiest, last = both.orderBy(F.desc("n"), "address_id").first(), x.txs.agg(F.max("tx_id")).first()[0]
    rows = x.ledger.filter(F.col("address_id") == (busiest.address_id if busiest else -1))
    sides = [rows.filter(c).select("tx_id", F.lit(s).alias("side"), "value") for c, s in (("value > 0", "in"), ("value < 0", "out"))]
    return lookup.merged_pages(sides, "tx_id", 6, after=last, offset=2)


@query(None, "select date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, o_orderkey, (row_number() over (partition by o_orderdate::date order by o_orderkey) - 1)::int trace_index from orders")
def trace_indexes(spark, sf_dir: str) -> DataFrame:
    block = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select(block.alias("block_id"), "o_orderkey")
    return lookup.trace_index(rows, "block_id", ["o_orderkey"])


@query(None, "select distinct lpad(lower(hex(p_brand)), 40, '0') pair, lpad(lower(hex(p_type)), 40, '0') token0, lpad(lower(hex(p_name)), 40, '0') token1 from part")
def exchange_pairs(spark, sf_dir: str) -> DataFrame:
    """Pairs written as event logs and decoded again."""
    word = lambda c, n: F.lower(F.lpad(F.hex(F.col(c).cast("binary")), n, "0"))
    first = F.lit(abi.topic("PairCreated(address,address,address,uint256)"))
    data = F.concat(word("p_brand", 64), F.lpad(F.hex("p_partkey"), 64, "0"))
    logs = table(spark, sf_dir, "part").select(F.array(first, word("p_type", 64), word("p_name", 64)).alias("topics"), data.alias("data"))
    noise = logs.select(F.array(F.lit("00"), F.get("topics", F.lit(1))).alias("topics"), "data")
    return abi.exchange_pairs(logs.union(noise))


@query(None, "select o_orderkey, case when o_orderkey % 2 = 0 then 'transfer' end as \"function\", case when o_orderkey % 2 = 0 then lpad(lower(hex('C' || o_custkey)), 40, '0') end as target, case when o_orderkey % 2 = 0 then o_custkey::varchar end amount from orders")
def decoded_calls(spark, sf_dir: str) -> DataFrame:
    known = {"transfer(address,uint256)": {"name": "transfer", "params": [("to", "address"), ("amount", "uint256")]}}
    to = F.lower(F.lpad(F.hex(F.concat(F.lit("C"), "o_custkey").cast("binary")), 64, "0"))
    body = F.concat(F.when(F.col("o_orderkey") % 2 == 0, abi.selector("transfer(address,uint256)")).otherwise("00000000"), to, F.lpad(F.hex("o_custkey"), 64, "0"))
    out = abi.decode_calls(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("input")), known)
    get = lambda k: F.try_element_at("arguments", F.lit(k))
    return out.select("o_orderkey", "function", get("to").alias("target"), get("amount").alias("amount"))


@query(None, "select n_name actor, count(c_custkey) tags, count(distinct c_mktsegment) labels from nation left join customer on c_nationkey = n_nationkey group by n_name")
def tag_counts_by_actor(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("actor_id"), F.col("c_mktsegment").alias("label"))
    actors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("actor_id"), F.col("n_name").alias("actor"))
    return tags.counts_of_actors(actors, rows, "actor_id").select("actor", "tags", "labels")


@query(None, "select n_name actor from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 3)")
def actors_without_jurisdiction(spark, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"))
    return tags.without_jurisdiction(table(spark, sf_dir, "nation"), known, "n_regionkey").select(F.col("n_name").alias("actor"))


@query(Ledger, "select distinct cluster_id, n_name actor from clusters join ids using (address_id) join customer on 'C' || c_custkey = address join nation on n_nationkey = c_nationkey")
def actors_of_clusters(x: Ledger) -> DataFrame:
    people = table(x.spark, x.sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("address"), "c_nationkey")
    named = people.join(table(x.spark, x.sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("address", F.col("n_name").alias("actor"))
    return tags.actors_of(x.clusters.join(x.ids, "address_id"), named)
