"""Updating graph tables batch by batch: deltas of a batch, their merge, checks, and writing of touched buckets.

A delta is made by the same transforms as the whole tables, from the batch's transactions
alone. Its rows merge with stored ones by sums, minima and maxima, so any split into batches
gives the tables that one run over all transactions gives.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ids, utxo
from ..plans.stage import files
from .delta import MERGE

ENTITY = {"first_tx_id": "min", "last_tx_id": "max", "no_incoming_txs": "sum", "no_outgoing_txs": "sum", "total_received": "sum", "total_spent": "sum"}
RELATION = {"no_transactions": "sum", "value": "sum"}


def entity_delta(ledger: DataFrame, key: str = "address_id") -> DataFrame:
    """What a batch of ledger rows (tx_id, net value) adds to each entity; a net of nothing touches it, but adds to neither side."""
    incoming, outgoing, zero = F.col("value") > 0, F.col("value") < 0, F.lit(0).cast("long")
    return ledger.groupBy(key).agg(
        F.min("tx_id").alias("first_tx_id"),
        F.max("tx_id").alias("last_tx_id"),
        F.count(F.when(incoming, 1)).alias("no_incoming_txs"),
        F.count(F.when(outgoing, 1)).alias("no_outgoing_txs"),
        F.coalesce(F.sum(F.when(incoming, F.col("value"))), zero).cast("long").alias("total_received"),
        F.coalesce(F.sum(F.when(outgoing, -F.col("value"))), zero).cast("long").alias("total_spent"),
    )


def relation_delta(plain: DataFrame) -> DataFrame:
    """What a batch of plain relations adds to each edge."""
    return plain.groupBy("src_id", "dst_id").agg(F.count("*").alias("no_transactions"), F.sum("estimated_value").cast("long").alias("value"))


def utxo_batch(txs: DataFrame, id_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity delta, relation delta) of a batch of transactions; ``id_table`` knows all its addresses."""
    inputs, outputs = utxo.regular_inputs(txs), utxo.regular_outputs(txs)
    ledger = utxo.address_transactions(inputs, outputs, id_table)
    return entity_delta(ledger), relation_delta(utxo.plain_relations(txs, inputs, ledger))


def account_delta(transfers: DataFrame) -> DataFrame:
    """What a batch of transfers (tx_id, src_id, dst_id, currency, value) adds to each (address_id, currency).

    A null side has no entity. Transfers to oneself count on both sides.
    """
    sides = [transfers.select(F.col(mine).alias("address_id"), "currency", "tx_id", (F.col("value") * sign).alias("value"), F.lit(sign).alias("sign")) for mine, sign in (("src_id", -1), ("dst_id", 1))]
    rows = sides[0].union(sides[1]).filter("address_id is not null")
    into, out = F.col("sign") == 1, F.col("sign") == -1
    return rows.groupBy("address_id", "currency").agg(
        F.min("tx_id").alias("first_tx_id"),
        F.max("tx_id").alias("last_tx_id"),
        F.count(F.when(into, 1)).alias("no_incoming_txs"),
        F.count(F.when(out, 1)).alias("no_outgoing_txs"),
        F.coalesce(F.sum(F.when(into, F.col("value"))), F.lit(0)).cast("long").alias("total_received"),
        F.coalesce(-F.sum(F.when(out, F.col("value"))), F.lit(0)).cast("long").alias("total_spent"),
    )


def new_ids(seen: DataFrame, known: DataFrame, order: list, name: str = "address_id") -> DataFrame:
    """Ids for values of ``seen`` that ``known`` lacks, from the one after the highest on, in ``order``."""
    highest = known.agg(F.max(name)).first()[0]
    value = next(c for c in known.columns if c != name)
    return ids.dense_ids(seen.join(known.select(value), value, "left_anti"), order, name, (highest if highest is not None else -1) + 1)


def relabelled(delta: DataFrame, mapping: DataFrame, key: str, to: str, measures: dict[str, str]) -> DataFrame:
    """A delta of entities as one of the groups that ``mapping`` (key, to) puts them in; unmapped ones are their own group."""
    rows = delta.join(mapping.select(key, to), key, "left").withColumn(to, F.coalesce(to, key))
    return rows.groupBy(to).agg(*[MERGE[how](c).alias(c) for c, how in measures.items()])


def planned(state: DataFrame | None, delta: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """The rows of ``delta`` as they will be stored, with what was there (old_*) and change: new or changed."""
    if state is None:
        return delta.select(*keys, *measures, *[F.lit(None).cast(dict(delta.dtypes)[c]).alias(f"old_{c}") for c in measures], F.lit("new").alias("change"))
    old = state.select(*keys, *[F.col(c).alias(f"old_{c}") for c in measures], F.lit(True).alias("_had"))
    joined = delta.join(old, keys, "left")

    def merge(c: str, how: str) -> Column:
        both = {"sum": F.col(c) + F.col(f"old_{c}"), "min": F.least(c, f"old_{c}"), "max": F.greatest(c, f"old_{c}")}[how]
        return F.coalesce(both, F.col(c)).alias(c)

    change = F.when(F.col("_had"), "changed").otherwise("new").alias("change")
    return joined.select(*keys, *[merge(c, how) for c, how in measures.items()], *[f"old_{c}" for c in measures], change)


def refused(plan: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows of a plan that break a check, with the names of those broken; ``checks`` maps a name to a condition that must hold (null holds)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    return plan.withColumn("broken", broken).filter(F.size("broken") > 0)


#: What every change of an entity has to keep.
ENTITY_CHECKS = {
    "order": "first_tx_id <= last_tx_id",
    "no_step_back": "last_tx_id >= old_last_tx_id and first_tx_id <= old_first_tx_id",
    "counts": "no_incoming_txs >= coalesce(old_no_incoming_txs, 0) and no_outgoing_txs >= coalesce(old_no_outgoing_txs, 0)",
    "totals": "total_received >= coalesce(old_total_received, 0) and total_spent >= coalesce(old_total_spent, 0)",
}


class Buckets:
    """A table in buckets by a hash of its key; a batch rewrites the buckets that it touches.

    Each batch writes its buckets under its number and then a manifest, which says for every
    bucket the batch that wrote it last. A batch counts from the moment its manifest is
    there, so one that stops half-way changes nothing and can be run again; one that is run
    again after it counted starts from the manifest before it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], measures: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.keys, self.measures, self.buckets = spark, path.rstrip("/"), keys, measures, buckets

    def _manifest(self, before: int | None = None) -> dict[str, int]:
        fs, root = files(self.spark, f"{self.path}/manifests")
        if not fs.exists(root):
            return {}
        names = (status.getPath().getName() for status in fs.listStatus(root))
        done = [int(n) for n in names if n.isdigit() and fs.exists(files(self.spark, f"{self.path}/manifests/{n}/_SUCCESS")[1])]
        done = [n for n in done if before is None or n < before]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{max(done)}").first()[0]) if done else {}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table after the last batch (before one), or some buckets of it."""
        held = {int(b): n for b, n in self._manifest(before).items() if only is None or int(b) in only}
        return self.spark.read.parquet(*[f"{self.path}/data/{n}/bucket={b}" for b, n in sorted(held.items())]) if held else None

    def apply(self, number: int, delta: DataFrame, checks: dict[str, str] | None = None) -> int:
        """Merge a batch's delta, one row a key, and return how many buckets were rewritten; raises if a check is broken."""
        from ..plans.stage import cut, discard

        placed = cut(delta.select(*self.keys, *self.measures).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), "delta")
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # a bucket each, of a fixed number
        state = self.read(number, touched)
        rows = placed.drop("bucket")
        if checks and (wrong := refused(planned(state, rows, self.keys, self.measures), checks).first()):
            raise ValueError(f"batch {number} breaks {wrong.broken}: {wrong.asDict()}")
        both = rows if state is None else state.select(*rows.columns).unionByName(rows)
        merged = both.groupBy(*self.keys).agg(*[MERGE[how](c).alias(c) for c, how in self.measures.items()])
        merged = merged.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{number}")
        held = self._manifest(number) | {str(b): number for b in touched}
        self.spark.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{number}")
        discard(placed)
        return len(touched)
