"""Tables kept up to date from batches of blocks, with SQL over all transactions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import heuristics, utxo
from ..plans.stage import cut, new_folder
from ..sources.account_projection import AccountLedger
from ..sources.projection import Ledger, table
from ..streaming import update
from ..streaming.delta import contiguous
from .account_queries import ACCOUNT_SQL
from .serving_queries import CHANGE_SQL, _known
from .utxo_queries import LEDGER_SQL

QUERIES, SQL, KINDS = {}, {}, {}
BATCHES = 3


def query(kind, sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, made=None: f(made or kind(spark, sf_dir))
        KINDS[f.__name__] = kind
        SQL[f.__name__] = {Ledger: LEDGER_SQL, AccountLedger: ACCOUNT_SQL}[kind] + sql
        return f

    return add


def _in_batches(rows: DataFrame, name: str, keys: list[str], measures: dict[str, str], to_delta: Callable[[DataFrame], DataFrame], checks: dict[str, str] | None = None) -> DataFrame:
    """``rows`` of blocks in BATCHES runs of blocks, each folded into buckets; the second batch is run twice, as after a crash."""
    low, high = rows.agg(F.min("block_id"), F.max("block_id")).first()
    if low is None:
        return to_delta(rows).select(*keys, *measures)
    state = update.Buckets(rows.sparkSession, new_folder(rows.sparkSession, name), keys, measures, 8)
    step = -(-(high - low + 1) // BATCHES)
    for number in (0, 1, 1, 2):
        batch = rows.filter(F.col("block_id").between(low + number * step, low + (number + 1) * step - 1))
        state.apply(number, to_delta(batch), checks)
    return state.read()


@query(Ledger, "select address_id, first_tx_id, last_tx_id, no_incoming_txs::bigint no_incoming_txs, no_outgoing_txs::bigint no_outgoing_txs, total_received, total_spent from stats")
def utxo_delta_entities(x: Ledger) -> DataFrame:
    txs, id_table = cut(x.txs, "txs"), cut(x.ids, "ids")
    return _in_batches(txs, "entities", ["address_id"], update.ENTITY, lambda batch: update.utxo_batch(batch, id_table)[0], update.ENTITY_CHECKS)


@query(Ledger, "select src_id, dst_id, no_transactions::bigint no_transactions, value from edges")
def utxo_delta_relations(x: Ledger) -> DataFrame:
    txs, id_table = cut(x.txs, "txs"), cut(x.ids, "ids")
    return _in_batches(txs, "relations", ["src_id", "dst_id"], update.RELATION, lambda batch: update.utxo_batch(batch, id_table)[1])


@query(
    AccountLedger,
    """select address_id, currency, min(tx_id) first_tx_id, max(tx_id) last_tx_id, count(*) filter (where not outgoing) no_incoming_txs, count(*) filter (where outgoing) no_outgoing_txs,
    coalesce(sum(value) filter (where not outgoing), 0)::bigint total_received, coalesce(sum(value) filter (where outgoing), 0)::bigint total_spent from sides group by address_id, currency""",
)
def account_delta_entities(x: AccountLedger) -> DataFrame:
    columns = ("block_id", "tx_id", "src_id", "dst_id", "value")
    both = x.encoded.select(*columns, F.lit("coin").alias("currency")).union(x.encoded_tokens.select(*columns, F.col("ticker")))
    return _in_batches(cut(both, "transfers"), "account", ["address_id", "currency"], update.ENTITY, update.account_delta, update.ENTITY_CHECKS)


@query(
    Ledger,
    """select cluster_id, min(first_tx_id) first_tx_id, max(last_tx_id) last_tx_id, sum(no_incoming_txs)::bigint no_incoming_txs, sum(no_outgoing_txs)::bigint no_outgoing_txs,
    sum(total_received)::bigint total_received, sum(total_spent)::bigint total_spent from stats join clusters using (address_id) group by cluster_id""",
)
def cluster_stats_fold(x: Ledger) -> DataFrame:
    """Cluster sums of the first half, folded into the clusters that the second half merges, with the sums of its own rows."""
    half = x.txs.agg(F.floor(F.max("tx_id") / 2)).first()[0] or 0
    first, second = x.ledger.filter(F.col("tx_id") <= half), x.ledger.filter(F.col("tx_id") > half)
    before = utxo.address_clusters(x.txs.filter(F.col("tx_id") <= half), x.ids)
    state = cut(update.relabelled(update.entity_delta(first), before, "address_id", "cluster_id", update.ENTITY), "clusters")
    now = x.clusters
    moved = update.relabelled(state, now.select(F.col("address_id").alias("cluster_id"), F.col("cluster_id").alias("into")), "cluster_id", "into", update.ENTITY)
    added = update.relabelled(update.entity_delta(second), now, "address_id", "cluster_id", update.ENTITY)
    both = moved.withColumnRenamed("into", "cluster_id").unionByName(added)
    return both.groupBy("cluster_id").agg(*[update.MERGE[how](c).alias(c) for c, how in update.ENTITY.items()])


@query(Ledger, "select case when min_tx > (select max(tx_id) // 2 from txs) then 'new' else 'changed' end change, count(*) n, sum(spent)::bigint spent from (select address_id, min(tx_id) min_tx, max(tx_id) max_tx, -sum(case when value < 0 then value else 0 end) spent from ledger group by address_id) where max_tx > (select max(tx_id) // 2 from txs) group by 1")
def utxo_planned_changes(x: Ledger) -> DataFrame:
    """What the second half of the transactions would change, without writing it; a plan that breaks a check isn't made."""
    half = x.txs.agg(F.floor(F.max("tx_id") / 2)).first()[0] or 0
    state = update.entity_delta(x.ledger.filter(F.col("tx_id") <= half))
    plan = cut(update.planned(state, update.entity_delta(x.ledger.filter(F.col("tx_id") > half)), ["address_id"], update.ENTITY), "plan")
    contiguous(x.txs.select(F.col("tx_id").alias("block_id")), None)
    if wrong := update.refused(plan, update.ENTITY_CHECKS).first():
        raise ValueError(f"the plan breaks {wrong.broken}")
    return plan.groupBy("change").agg(F.count("*").alias("n"), F.sum("total_spent").alias("spent"))


@query(Ledger, "select address, address_id from ids where address <> 'coinbase'")
def utxo_new_ids(x: Ledger) -> DataFrame:
    """Ids given in two batches: addresses that the second half brings are numbered after those of the first."""
    half = x.txs.agg(F.floor(F.max("tx_id") / 2)).first()[0] or 0

    def parts(test) -> tuple[DataFrame, DataFrame]:
        return x.inputs.filter(test), x.outputs.filter(test)

    known = cut(utxo.address_ids(*parts(F.col("tx_id") <= half)), "known")
    ins, outs = parts(F.col("tx_id") > half)
    seen = ins.select("address", "tx_id", F.lit(-1).alias("n")).union(outs.select("address", "tx_id", "n")).filter("address <> 'coinbase'")
    first = seen.groupBy("address").agg(F.min(F.struct("tx_id", "n")).alias("first"))
    added = update.new_ids(first, known, ["first.tx_id", "first.n", "address"]).select("address", "address_id")
    return known.union(added).filter("address <> 'coinbase'")


@query(
    Ledger,
    CHANGE_SQL
    + """, fnd as (select * from direct union all select * from multi union all select * from one), e as (select tx_id, address, max(confidence) confidence, array_to_string(list_sort(list(distinct rule)), ',') rules from fnd group by tx_id, address)
    select tx_id, address, confidence, rules from (select *, max(confidence) over (partition by tx_id) m from e) where confidence = m""",
)
def change_consensus(x: Ledger) -> DataFrame:
    return heuristics.change_consensus(heuristics.change(x.txs, _known(x))).withColumn("rules", F.array_join("rules", ","))


@query(Ledger, "select distinct tx_id from ins where address in (select 'C' || c_custkey from customer where c_custkey % 3 = 0)")
def exchange_input_veto(x: Ledger) -> DataFrame:
    exchanges = table(x.spark, x.sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("address"))
    return heuristics.exchange_inputs(x.txs, exchanges)
