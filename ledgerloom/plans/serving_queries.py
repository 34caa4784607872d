"""Point questions, searches, heuristics and incremental updates, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import heuristics, serving, utxo
from ..plans.stage import cut, new_folder
from ..sources.lake import partition_audit
from ..sources.projection import Ledger, table
from ..streaming import delta
from .utxo_queries import LEDGER_SQL

QUERIES, SQL = {}, {}
CENTS = "cast(round(value * 100) as bigint)"


def query(sql: str | None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, made=None: f(made or Ledger(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql if plain else LEDGER_SQL + sql
        return f

    return add


@query("select address, total_received - total_spent balance from stats join ids using (address_id) where address in ('C1', 'C7', 'S3', 'nobody')")
def address_balances(x: Ledger) -> DataFrame:
    rows = serving.lookup(x.stats.join(x.ids, "address_id"), "address", ["C1", "C7", "S3", "nobody"])
    return serving.balance(rows).select("address", "balance")


@query("select tx_id, value from ledger join ids using (address_id) where address = 'S3' and value > 0 and tx_id < 900 and block_id between 100 and 2000 order by tx_id desc limit 12")
def address_transactions_page(x: Ledger) -> DataFrame:
    rows = x.ledger.join(x.ids, "address_id")
    return serving.page(rows, "address", "S3", 12, after=900, direction="in", blocks=(100, 2000)).select("tx_id", "value")


@query("select coalesce(min(tx_id), 0) first_tx_id, coalesce(max(tx_id), -1) last_tx_id from txs where block_id between 200 and 260")
def transaction_range(x: Ledger) -> DataFrame:
    return serving.transaction_range(x.txs, 200, 260)


@query("select tx_id, k order_key, total_output from txs where block_id = (select min(block_id) from txs where block_id > 500)")
def block_transactions(x: Ledger) -> DataFrame:
    first = x.txs.filter("block_id > 500").agg(F.min("block_id").alias("block_id"))
    return x.txs.join(F.broadcast(first), "block_id", "left_semi").select("tx_id", "order_key", "total_output")  # one row


@query(
    """, busy as (select src_id from edges group by src_id order by count(*) desc, src_id limit 1)
    select dst_id neighbor_id, no_transactions, value, total_received, total_spent, (select count(*) from edges i where i.dst_id = e.dst_id)::int in_degree, (select count(*) from edges o where o.src_id = e.dst_id)::int out_degree
    from edges e join stats on address_id = dst_id where src_id = (select src_id from busy)"""
)
def neighbors_of_busiest(x: Ledger) -> DataFrame:
    edges = cut(x.edges, "edges")
    busiest = edges.groupBy("src_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_id").first()
    nodes = utxo.degrees(x.stats, edges, "address_id")
    return serving.neighbors(edges, nodes, "address_id", busiest.src_id if busiest else -1, True)


@query(
    """, pair as (select a.address src, b.address dst from reg_in a join (select distinct tx_id, address from outs) b using (tx_id) group by all order by count(*) desc, a.address, b.address limit 1)
    select a.tx_id, a.block_id, a.value input_value, sum(b.value)::bigint output_value from reg_in a join outs b using (tx_id) join pair p on p.src = a.address and p.dst = b.address group by a.tx_id, a.block_id, a.value"""
)
def links_between(x: Ledger) -> DataFrame:
    """Transactions from one address to another, of the pair that has most."""
    pairs = x.inputs.select("tx_id", F.col("address").alias("src")).join(x.outputs.select("tx_id", F.col("address").alias("dst")).distinct(), "tx_id")
    most = pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst").first()
    return serving.links(x.inputs, x.outputs, most.src if most else "", most.dst if most else "")


@query("select i.tx_id, i.address, arg_max(o.tx_id, o.tx_id * 100000 + o.n) spent_tx_id, arg_max(o.n, o.tx_id * 100000 + o.n)::int spent_n from (select distinct tx_id, address from ins) i join outs o on o.address = i.address and o.tx_id < i.tx_id group by i.tx_id, i.address")
def spending_references(x: Ledger) -> DataFrame:
    return serving.spending(x.txs, x.outputs)


@query("select address from ids where lower(address) like 'c1%' and address like '%5' order by address limit 10")
def search_addresses(x: Ledger) -> DataFrame:
    return serving.search_prefix(x.ids, "address", "c1", "5", 10, fold=True)


@query("select case when k % 3 = 0 then 'a' when k % 3 = 1 then 'b' else 'c' end network, count(*) no_txs, count(distinct block_id) no_blocks, sum(total_output)::bigint as value from txs group by k % 3 union all select 'overall', count(*), count(distinct block_id), sum(total_output)::bigint from txs")
def graph_summary(x: Ledger) -> DataFrame:
    kind = F.when(F.col("order_key") % 3 == 0, "a").when(F.col("order_key") % 3 == 1, "b").otherwise("c")
    return serving.graph_summary(x.txs, kind)


@query(
    """, best as (select *, row_number() over (partition by src_id order by no_transactions desc, dst_id) nth from edges where src_id <> dst_id), e as (select * from best where nth <= 4),
    l1 as (select distinct dst_id node_id, src_id parent_id from e where src_id = (select address_id from ids where address = 'C7')),
    l2 as (select dst_id node_id, min(src_id) parent_id from e where src_id in (select node_id from l1) and dst_id not in (select node_id from l1) and dst_id <> (select address_id from ids where address = 'C7') group by dst_id)
    select node_id, 1 depth, parent_id from l1 join stats on address_id = node_id where total_received > 100000 union all select node_id, 2, parent_id from l2 join stats on address_id = node_id where total_received > 100000"""
)
def search_neighbors(x: Ledger) -> DataFrame:
    edges = cut(x.edges, "edges")
    start = x.ids.filter("address = 'C7'").first()
    return serving.search_neighbors(edges, x.stats, "address_id", start.address_id if start else -1, 2, 4, F.col("total_received") > 100_000)


@query(
    """, tagged as (select 'C' || c_custkey address from customer where c_custkey % 3 = 0), tc as (select distinct cluster_id from clusters join ids using (address_id) where address in (select address from tagged))
    select cluster_id, address_id, address, total_received, cluster_id in (select cluster_id from tc) cluster_tagged from stats join ids using (address_id) join clusters using (address_id)
    where address not in (select address from tagged) order by total_received desc, address_id limit 20"""
)
def top_untagged(x: Ledger) -> DataFrame:
    rows = x.stats.join(x.ids, "address_id").join(x.clusters, "address_id")
    tagged = table(x.spark, x.sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("address"))
    clusters = x.clusters.join(x.ids.join(tagged, "address", "left_semi"), "address_id").select("cluster_id")
    return serving.top_untagged(rows, tagged, clusters, "total_received", 20)


@query("select count(*) addresses, count(*) filter (where address like 'C%' and try_cast(substr(address, 2) as int) % 3 = 0) tagged, count(*) filter (where address like 'C%' and try_cast(substr(address, 2) as int) % 3 = 0) / count(*) share from ids")
def tag_coverage(x: Ledger) -> DataFrame:
    tagged = table(x.spark, x.sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("address"))
    return serving.tag_coverage(x.ids, tagged)


@query("select 'k' || (c_custkey // 3) pubkey, array_to_string(list_sort(list(distinct 'net' || (c_nationkey % 2))), ',') networks from customer group by 1 having count(distinct c_nationkey % 2) >= 2", plain=True)
def cross_network_keys(x: Ledger) -> DataFrame:
    keys = table(x.spark, x.sf_dir, "customer").select(F.concat(F.lit("k"), F.expr("c_custkey div 3")).alias("pubkey"), F.concat(F.lit("net"), F.col("c_nationkey") % 2).alias("network"))
    return serving.cross_network(keys).withColumn("networks", F.array_join("networks", ","))


@query(
    """, f as (select tx_id, count(distinct address) = count(*) distinct_out, count(*) n_out from outs group by tx_id), fr as (select tx_id, value, count(*) c, min(n) n from outs group by all),
    tw as (select tx_id, count(*) twos, min(value) d from fr where c = 2 group by tx_id), ot as (select o.tx_id, count(distinct o.value) kinds, count(*) c from outs o join tw using (tx_id) where o.value <> d group by o.tx_id),
    jm as (select tx_id, arg_max(c, c * 100000 - n) c, arg_max(value, c * 100000 - n) d from fr where value > 2730 group by tx_id)
    select tx_id, n_out in (3, 4) and n_in >= 2 and distinct_out and coalesce(twos, 0) = 1 and coalesce(d0 >= 5000, false) and (n_out <> 4 or coalesce(kinds, 0) = 2) stonewall,
        coalesce(jc >= n_out / 2 and jc between 3 and senders and distinct_out and kinds_all > 1, false) joinmarket
    from txs join (select tx_id, distinct_out from f) using (tx_id) left join (select tx_id, twos, d d0 from tw) using (tx_id) left join (select tx_id, kinds from ot) using (tx_id) left join (select tx_id, c jc from jm) using (tx_id)
        join (select tx_id, senders from shape) using (tx_id) join (select tx_id, count(distinct value) kinds_all from outs group by tx_id) using (tx_id) where not coinbase"""
)
def mixing_heuristics(x: Ledger) -> DataFrame:
    return heuristics.mixing(x.txs).select("tx_id", "stonewall", "joinmarket")


CHANGE_SQL = """, known as (select a.*, block_id first_block from (select address, cluster_id, no_incoming_txs, no_outgoing_txs, first_tx_id from stats join ids using (address_id) join clusters using (address_id)) a join base on tx_id = first_tx_id),
    o as (select outs.*, n_out, coinbase from outs join txs using (tx_id) where not coinbase), direct as (select tx_id, n, address, 'direct_change' rule, 100 confidence from o where (tx_id, address) in (select tx_id, address from ins)),
    spent as (select distinct tx_id, cluster_id from ins join known using (address)), multi as (select o.tx_id, n, o.address, 'multi_input_change', 50 from o join known using (address) join spent s on s.tx_id = o.tx_id and s.cluster_id = known.cluster_id),
    kinds as (select tx_id, count(distinct address_type) k, min(address_type) t, min(value) least from ins group by tx_id),
    per as (select o.tx_id, o.address, count(*) times, min(n) n, bool_or(k = 1 and t <> 0 and t = o.address_type and o.value % 1000 <> 0 and o.value < least and not (coalesce(no_incoming_txs, 0) > 1 or coalesce(no_outgoing_txs, 0) > 1 or coalesce(first_block, 1000000) < o.block_id)) fits
        from o join kinds using (tx_id) left join known using (address) where n_out between 2 and 10 group by o.tx_id, o.address),
    one as (select tx_id, min(n) n, min(address) address, 'one_time_change', 50 from per where fits and times = 1 group by tx_id having count(*) = 1)"""


@query(CHANGE_SQL + "select tx_id, n::int n, address, rule, confidence from (select * from direct union all select * from multi union all select * from one)")
def change_heuristics(x: Ledger) -> DataFrame:
    return heuristics.change(x.txs, _known(x)).withColumn("n", F.col("n").cast("int"))


def _known(x: Ledger) -> DataFrame:
    first = x.txs.select(F.col("tx_id").alias("first_tx_id"), F.col("block_id").alias("first_block"))
    return x.stats.join(x.ids, "address_id").join(x.clusters, "address_id").join(first, "first_tx_id")


def _traits(x: Ledger) -> DataFrame:
    kinds = F.array_sort(F.array_distinct(F.transform("inputs", lambda i: i["address_type"])))
    lock = F.when(F.col("order_key") % 4 == 0, 0).when(F.col("order_key") % 4 == 1, F.col("block_id") - 3).otherwise(F.col("block_id") + 5)
    return x.txs.select(
        "tx_id",
        F.array_join(F.transform(kinds, lambda k: k.cast("string")), ",").alias("script_type"),
        F.when(F.col("order_key") % 11 != 0, F.col("order_key") % 2 == 0).alias("witness_present"),
        (1 + F.col("order_key") % 2).alias("tx_version"),
        (F.col("order_key") % 3 == 0).alias("rbf"),
        heuristics.locktime_class(lock, F.col("block_id")).alias("locktime_pattern"),
        heuristics.sorted_outputs(F.col("outputs")).alias("bip69_outputs_sorted"),
    )


@query(
    """, kinds as (select tx_id, string_agg(distinct address_type::varchar, ',' order by address_type::varchar) s from ins group by tx_id), sorted as (select tx_id, bool_and(ok) b from (select tx_id, coalesce(lag((value, address)) over (partition by tx_id order by n) <= (value, address), true) ok from outs) group by tx_id),
    tr as (select tx_id, s, case when k % 11 <> 0 then k % 2 = 0 end w, k % 2 v, k % 3 = 0 r, case when k % 4 = 0 or (k % 4 = 1 and block_id = 3) then 'zero' when k % 4 = 1 and block_id > 3 then 'anti' else 'other' end l, b from txs join kinds using (tx_id) join sorted using (tx_id)),
    pr as (select a.tx_id left_id, b.tx_id right_id, a.s = b.s s, a.w = b.w w, a.v = b.v v, a.r = b.r r, a.l = b.l l, a.b = b.b b from tr a join tr b on b.tx_id = a.tx_id + 1),
    sc as (select left_id, right_id, (case when s then 5 else 0 end + case when coalesce(w, false) then 3 else 0 end + case when v then 5 else 0 end + case when r then 3 else 0 end + case when l then 4 else 0 end + case when b then 2 else 0 end)::bigint matched,
        (case when s then 0 else -80 end + case when coalesce(w, true) then 0 else -20 end + case when v then 0 else -30 end + case when r then 0 else -25 end + case when l then 0 else -15 end + case when b then 0 else -10 end)::bigint mismatched from pr),
    cl as (select distinct i.tx_id, cluster_id from ins i join ids using (address) join clusters using (address_id))
    select left_id, right_id, matched, mismatched, shared, case when shared and mismatched > -60 then 'likely_linked' when mismatched <= -60 then 'likely_unlinked' when mismatched < -30 then 'potential_unlink' else 'inconclusive' end verdict
    from (select sc.*, exists (select 1 from cl a join cl b on a.cluster_id = b.cluster_id where a.tx_id = left_id and b.tx_id = right_id) shared from sc)"""
)
def transaction_comparison(x: Ledger) -> DataFrame:
    traits = cut(_traits(x), "traits")
    pairs = traits.select(F.col("tx_id").alias("left_id"), (F.col("tx_id") + 1).alias("right_id"))
    member = x.txs.select("tx_id", F.explode("inputs").alias("i")).select("tx_id", F.explode("i.address").alias("address")).join(x.ids.hint("merge"), "address").join(x.clusters.hint("merge"), "address_id").select("tx_id", "cluster_id").distinct()
    a, b = member.select(F.col("tx_id").alias("left_id"), "cluster_id"), member.select((F.col("tx_id") - 1).alias("left_id"), F.col("tx_id").alias("right_id"), "cluster_id")
    shared = a.join(b.hint("merge"), ["left_id", "cluster_id"]).select("left_id", "right_id")
    return heuristics.verdicts(heuristics.compare(traits, pairs), shared)


@query("select address_id, cluster_id from clusters")
def incremental_clusters(x: Ledger) -> DataFrame:
    """Clusters of the first half of the transactions, kept up to date with the second half."""
    txs = cut(x.txs, "txs")
    half = txs.agg(F.floor(F.max("tx_id") / 2)).first()[0]
    known = cut(utxo.address_clusters(txs.filter(F.col("tx_id") <= half), x.ids), "clusters")
    return delta.merged_clusters(known, utxo.co_spends(txs.filter(F.col("tx_id") > half), x.ids))


def _events_stream(x: Ledger, files: int) -> DataFrame:
    """The events as a stream of files in the order of their ids, one file a micro-batch."""
    events = table(x.spark, x.sf_dir, "events")
    path = new_folder(x.spark, "events")
    events.repartitionByRange(files, "event_id").write.parquet(path)
    return x.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _state(x: Ledger, name: str) -> tuple[delta.State, str]:
    base = new_folder(x.spark, name)
    return delta.State(x.spark, f"{base}/state"), f"{base}/checkpoint"


@query(f"select user_id, count(*) no_events, sum({CENTS})::bigint cents, min(event_id) first_event, max(event_id) last_event from events group by user_id", plain=True)
def streaming_entity_state(x: Ledger) -> DataFrame:
    """State of each user, folded from micro-batches."""

    def to_delta(batch: DataFrame) -> DataFrame:
        rows = batch.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
        return rows.groupBy("user_id").agg(F.count("*").alias("no_events"), F.sum("cents").alias("cents"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))

    state, checkpoint = _state(x, "entities")
    measures = {"no_events": "sum", "cents": "sum", "first_event": "min", "last_event": "max"}
    return delta.run(_events_stream(x, 4), state, to_delta, ["user_id"], measures, checkpoint)


@query(f"select event_id, user_id address, event_type side, {CENTS} / 1.0 as value from events where (user_id % 5 = 0 and event_type = 'purchase' and {CENTS} > 1000) or (user_id % 5 = 1 and {CENTS} > 9000)", plain=True)
def streaming_watchlist(x: Ledger) -> DataFrame:
    """Events of watched users, found in micro-batches."""
    users = table(x.spark, x.sf_dir, "events").select("user_id").distinct()
    watchlist = users.filter("user_id % 5 < 2").select(F.col("user_id").alias("address"), F.when(F.col("user_id") % 5 == 0, "purchase").alias("direction"), F.when(F.col("user_id") % 5 == 0, 1000).otherwise(9000).alias("value_gt"))
    watchlist = cut(watchlist, "watchlist")
    state, checkpoint = _state(x, "alerts")

    def to_delta(batch: DataFrame) -> DataFrame:
        flows = batch.select("event_id", F.col("user_id").alias("address"), F.col("event_type").alias("side"), (F.round(F.col("value") * 100) / 1.0).alias("value"))
        return delta.watched(flows, watchlist)

    return delta.run(_events_stream(x, 3), state, to_delta, ["event_id", "address", "side"], {"value": "max"}, checkpoint)


@query(f"select date_trunc('hour', ts) hour_start, event_type, count(*) n, sum({CENTS})::bigint cents from events group by all", plain=True)
def streaming_windows(x: Ledger) -> DataFrame:
    """Tumbling hours by event type, as a streaming aggregate. The files of a batch writer come in any order, so rows may be 60 days late."""
    rows = _events_stream(x, 3).withColumns({"ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")})
    counted = delta.windowed(rows, "ts", "1 hour", "60 days", F.col("event_type")).select(F.col("w.start").alias("hour_start"), "event_type", "n", "cents")
    state, checkpoint = _state(x, "windows")
    return delta.latest(counted, state, ["hour_start", "event_type"], checkpoint).withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("select tx_id, block_id, address, 'out' side, value / 1.0 as value from ins union all select tx_id, block_id, address, 'in', value / 1.0 from outs")
def transaction_flows(x: Ledger) -> DataFrame:
    return delta.flows(x.txs)


@query("select cast(json_extract(props, '$.k') as int) k, count(*) n, sum(case when event_type = 'error' then 1 else 0 end)::bigint errors from events group by 1", plain=True)
def event_properties(x: Ledger) -> DataFrame:
    rows = table(x.spark, x.sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))


@query("select count(*) as rows, count(distinct o_custkey) keys from orders", plain=True)
def partition_audit_totals(x: Ledger) -> DataFrame:
    orders = table(x.spark, x.sf_dir, "orders").repartition(4, "o_custkey")
    return partition_audit(orders, "o_custkey").agg(F.sum("rows").alias("rows"), F.sum("keys").alias("keys"))


_OUTPUTS = "select tx_id, string_agg(n || ':' || address || ':' || value, ',' order by n) io from outs group by tx_id"


@query(_OUTPUTS)
def transaction_outputs(x: Ledger) -> DataFrame:
    each = x.outputs.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("n", "address", "value"))).alias("io"))
    shown = F.transform("io", lambda o: F.concat_ws(":", o["n"].cast("string"), o["address"], o["value"].cast("string")))
    return each.select("tx_id", F.array_join(shown, ",").alias("io"))


@query("select o_custkey, o_orderkey, rn::int rn from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn <= 2", plain=True)
def top_transactions_per_node(x: Ledger) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(x.spark, x.sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(order))
    return rows.filter("rn <= 2").select("o_custkey", "o_orderkey", "rn")
