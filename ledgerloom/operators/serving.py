"""Questions about single nodes, edges and transactions, and searches from them.

Parameters come from a caller, so lists of them are bounded by the request. Filters are
plain predicates on keys, which reach the scan of a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut
from .carry import carried


def node(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def lookup(table: DataFrame, key: str, values: list) -> DataFrame:
    """Many nodes at once; values that aren't there give no row."""
    return table.filter(F.col(key).isin(values))


def balance(addresses: DataFrame) -> DataFrame:
    return addresses.select("address_id", "address", (F.col("total_received") - F.col("total_spent")).alias("balance"))


def page(ledger: DataFrame, key: str, value, limit: int, after: int | None = None, direction: str | None = None, blocks: tuple | None = None, descending: bool = True) -> DataFrame:
    """One page of a node's transactions in the order of their ids.

    ``after`` is the last id of the page before; ``direction`` is in or out; ``blocks`` the
    first and last block. Only ``limit`` rows of each task are ordered.
    """
    rows = ledger.filter(F.col(key) == value)
    if direction:
        rows = rows.filter(F.col("is_outgoing") if direction == "out" else ~F.col("is_outgoing"))
    if blocks:
        rows = rows.filter(F.col("block_id").between(*blocks))
    if after is not None:
        rows = rows.filter(F.col("tx_id") < after if descending else F.col("tx_id") > after)
    return rows.orderBy(F.desc("tx_id") if descending else F.asc("tx_id")).limit(limit)


def transaction_range(txs: DataFrame, first: int, last: int) -> DataFrame:
    """Least and greatest transaction id of a range of blocks; 0 and -1 if it has none."""
    found = txs.filter(F.col("block_id").between(first, last)).agg(F.min("tx_id").alias("a"), F.max("tx_id").alias("b"))
    return found.select(F.coalesce("a", F.lit(0)).alias("first_tx_id"), F.coalesce("b", F.lit(-1)).alias("last_tx_id"))


def neighbors(edges: DataFrame, nodes: DataFrame, key: str, value: int, outgoing: bool, only: list[int] | None = None) -> DataFrame:
    """A node's edges with the statistics of the node at the other end."""
    mine, other = ("src_id", "dst_id") if outgoing else ("dst_id", "src_id")
    rows = edges.filter(F.col(mine) == value)
    if only is not None:
        rows = rows.filter(F.col(other).isin(only))
    stats = nodes.select(F.col(key).alias("neighbor_id"), "total_received", "total_spent", "in_degree", "out_degree")
    return rows.select(F.col(other).alias("neighbor_id"), "no_transactions", "value").join(stats, "neighbor_id")


def links(inputs: DataFrame, outputs: DataFrame, source: str, target: str) -> DataFrame:
    """Transactions with ``source`` among the inputs and ``target`` among the outputs, by raw membership, not netted."""
    a = inputs.filter(F.col("address") == source).select("tx_id", "block_id", F.col("value").alias("input_value"))
    b = outputs.filter(F.col("address") == target).groupBy("tx_id").agg(F.sum("value").alias("output_value"))
    return a.join(b, "tx_id")


def spending(txs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tx_id, address, spent_tx_id, spent_n): for each input the latest earlier output to its address.

    Inputs and outputs of an address are ordered together once, in blocks of transactions,
    with the latest output seen carried along, instead of joining every input with all
    earlier outputs. A transaction's own outputs come after its inputs.
    """
    ins = txs.select("tx_id", F.explode("inputs").alias("i")).select("tx_id", F.explode("i.address").alias("address")).distinct()
    marks = ins.select("address", "tx_id", F.lit(0).alias("kind"), F.lit(None).cast("struct<tx_id: bigint, n: int>").alias("seen"))
    made = outputs.select("address", "tx_id", F.lit(1).alias("kind"), F.struct("tx_id", F.col("n").cast("int").alias("n")).alias("seen"))
    both = marks.union(made).withColumn("nth", F.coalesce("seen.n", F.lit(-1)))
    rows = carried(both, "address", "tx_id", ["kind", "nth"], "seen", 1_000_000, before=True).filter("kind = 0 and seen is not null")
    return rows.select("tx_id", "address", F.col("seen.tx_id").alias("spent_tx_id"), F.col("seen.n").alias("spent_n"))


def search_prefix(table: DataFrame, column: str, start: str, end: str = "", limit: int = 10, fold: bool = False) -> DataFrame:
    """Values with a given beginning (and end), in order."""
    text = F.lower(column) if fold else F.col(column)
    match = text.startswith(start.lower() if fold else start)
    if end:
        match &= text.endswith(end.lower() if fold else end)
    return table.filter(match).select(column).distinct().orderBy(column).limit(limit)


def graph_summary(txs: DataFrame, network: Column) -> DataFrame:
    """Transactions, blocks and value by network, and over all networks in one pass."""
    rows = txs.withColumn("network", network)
    out = rows.rollup("network").agg(F.count("*").alias("no_txs"), F.count_distinct("block_id").alias("no_blocks"), F.sum("total_output").alias("value"), F.grouping("network").alias("overall"))
    return out.withColumn("network", F.when(F.col("overall") == 1, "overall").otherwise(F.col("network"))).drop("overall")


def asset_flows(transfers: DataFrame, tx_id: int, assets: list[str] | None = None, with_zero: bool = True) -> DataFrame:
    """Transfers of a transaction, in the coin and in tokens, in their order."""
    rows = transfers.filter(F.col("tx_id") == tx_id)
    if not with_zero:
        rows = rows.filter("value <> 0")
    return rows.filter(F.col("ticker").isin(assets)) if assets else rows


def search_neighbors(edges: DataFrame, nodes: DataFrame, key: str, start: int, depth: int, breadth: int, match: Column, outgoing: bool = True, skip_above: int | None = None) -> DataFrame:
    """(node_id, depth, parent_id): nodes that satisfy ``match``, found by going along edges.

    From every node of a level the ``breadth`` edges of most transactions (ties: least id)
    are followed; each node is entered once, from its least parent. A level has at most
    breadth**level nodes; it is written out before the next starts.
    """
    mine, other = ("src_id", "dst_id") if outgoing else ("dst_id", "src_id")
    spark = edges.sparkSession
    usable = edges.filter("src_id <> dst_id")
    if skip_above is not None:
        small = nodes.filter(F.col("in_degree") + F.col("out_degree") <= skip_above).select(F.col(key).alias(other))
        usable = usable.join(small, other, "left_semi")
    level = spark.createDataFrame([(start, 0, None)], "node_id long, depth int, parent_id long")
    seen = level
    for d in range(1, depth + 1):
        best = Window.partitionBy(mine).orderBy(F.desc("no_transactions"), other)
        step = usable.join(level.select(F.col("node_id").alias(mine)), mine, "left_semi").withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= breadth)
        reached = step.groupBy(F.col(other).alias("node_id")).agg(F.min(mine).alias("parent_id"))
        level = cut(reached.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(d).alias("depth"), "parent_id"), "level")
        seen = seen.union(level)
    return seen.filter("depth > 0").join(nodes.withColumnRenamed(key, "node_id"), "node_id").filter(match).select("node_id", "depth", "parent_id")


def top_untagged(addresses: DataFrame, tagged: DataFrame, tagged_clusters: DataFrame, metric: str, k: int, pool: int = 10) -> DataFrame:
    """The ``k`` addresses of the highest ``metric`` without a tag, and whether their cluster has one.

    Tags are first probed for the top ``pool`` * k alone; if that leaves fewer than k, all
    addresses are probed, so the result doesn't depend on the pool.
    """
    order = [F.desc_nulls_last(metric), F.asc("address_id")]
    some = addresses.select("address_id", "address", "cluster_id", metric).orderBy(*order).limit(pool * k)
    free = cut(some.join(tagged.select("address").distinct(), "address", "left_anti").orderBy(*order).limit(k), "untagged")
    if free.count() < k:
        free = addresses.select("address_id", "address", "cluster_id", metric).join(tagged.select("address").distinct(), "address", "left_anti").orderBy(*order).limit(k)
    flagged = tagged_clusters.select("cluster_id").distinct().withColumn("cluster_tagged", F.lit(True))
    return free.join(flagged, "cluster_id", "left").withColumn("cluster_tagged", F.coalesce("cluster_tagged", F.lit(False)))


def tag_coverage(addresses: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: addresses, those with a tag, and their share."""
    marked = addresses.select("address").join(tagged.select("address").distinct().withColumn("t", F.lit(1)), "address", "left")
    return marked.agg(F.count("*").alias("addresses"), F.count("t").alias("tagged"), (F.count("t") / F.count("*")).alias("share"))


def cross_network(keys: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """(pubkey, networks): keys seen in two networks or more, without those already recorded."""
    found = keys.groupBy("pubkey").agg(F.array_sort(F.collect_set("network")).alias("networks")).filter(F.size("networks") >= 2)
    return found.join(already.select("pubkey"), "pubkey", "left_anti") if already is not None else found


def related_by_key(keys: DataFrame, address: str) -> DataFrame:
    """Other addresses that share a public key with one."""
    mine = keys.filter(F.col("address") == address).select("pubkey").distinct()
    return keys.join(mine, "pubkey", "left_semi").filter(F.col("address") != address).select("network", "address").distinct()
