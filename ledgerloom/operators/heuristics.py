"""Who gets the change of a transaction, and which transactions mix coins.

All tests are column expressions over a transaction's own arrays, or joins of exploded
outputs with address statistics; nothing gathers transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the mixing protocols.
POOLS = ((100_000, 5_000), (1_000_000, 50_000), (5_000_000, 175_000), (50_000_000, 1_750_000))
POOL_FEE_LOW, POOL_FEE_HIGH, PREMIX_MOST = 100, 110_000, 70
COORDINATOR_LOW, COORDINATOR_HIGH = 0.5, 3
TENTH, TENTH_WINDOW, PER_PERSON = 10_000_000, 500_000, 7
ROUND_INPUTS, ROUND_PEOPLE, SMALL_ROUND, SPLIT_REST, TOP_SHARE = 10, 3, 20, 0.0001, 0.1
LARGE_INPUTS, LARGE_PER_PERSON, LARGE_LEAST, LARGE_REPEATS, LARGE_TIERS = 20, 10, 5_000, 2, 3
DUST, MAKERS, MAKERS_CONFIDENCE, MAKERS_LARGE, MAKERS_FAN_IN, MAKERS_OUTPUTS = 2730, 3, 49, 50, 20, 1.7
PAIR_LEAST = 5_000

#: Confidence of each rule for change.
CONFIDENCE = {"one_time_change": 50, "direct_change": 100, "multi_input_change": 50}


def _first(x: Column) -> Column:
    return F.get(x["address"], F.lit(0))


def _addressed(column: str) -> Column:
    return F.filter(F.coalesce(F.col(column), F.array().cast("array<struct<address: array<string>, value: bigint, address_type: int>>")), lambda x: x.isNotNull() & (F.size(x["address"]) > 0))


def _frequency(values: Column) -> Column:
    """(n, v) of each distinct value, n of them."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), v.alias("v")))


def _top(values: Column) -> Column:
    """The most frequent value and its count; of ties the one that stands first."""
    ranked = F.transform(_frequency(values), lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("i"), x["v"].alias("v")))
    return F.array_max(ranked)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def mixing(txs: DataFrame) -> DataFrame:
    """One row a transaction: which mixing protocols its shape fits.

    Columns: stonewall (a shape that only vetoes others), joinmarket, wasabi_10, wasabi_11,
    wasabi_20, whirlpool and whirlpool_tx0 as booleans, with the participants, denomination
    and confidence of those that fit. Coinbase transactions fit none.
    """
    rows = txs.filter(~F.coalesce("coinbase", F.lit(False))).select("tx_id", _addressed("inputs").alias("i"), _addressed("outputs").alias("o"), F.col("outputs").alias("all_o"))
    i, o = F.col("i"), F.col("o")
    rows = rows.withColumns(
        {
            "n_in": F.size(i),
            "n_out": F.size(o),
            "scripts_in": F.size(F.array_distinct(F.transform(i, _first))),
            "distinct_out": F.size(F.array_distinct(F.transform(o, _first))) == F.size(o),
            "values": F.transform(o, lambda x: x["value"]),
            "paid": F.transform(i, lambda x: x["value"]),
            "top_sender": _top(F.transform(i, _first))["n"],
        }
    )
    v = F.col("values")
    rows = rows.withColumns({"freq": _frequency(v), "total": _sum(v), "any_top": _top(v)})
    n_in, n_out, scripts, total = (F.col(c) for c in ("n_in", "n_out", "scripts_in", "total"))

    # A payment cut in equal parts isn't a round: small rounds whose total is a multiple of the commonest value are refused.
    parts = F.round(total / F.col("any_top.v"))
    even = (n_in < SMALL_ROUND) & (total > 0) & (F.col("any_top.v") > 0) & (parts > 0) & (F.abs(total - parts * F.col("any_top.v")) / total <= SPLIT_REST)
    spread = F.col("top_sender") / n_in <= TOP_SHARE

    twice = F.transform(F.filter("freq", lambda x: x["n"] == 2), lambda x: x["v"])
    others = F.filter(v, lambda x: x != F.get(twice, F.lit(0)))
    stonewall = (
        n_out.isin(3, 4) & (n_in >= 2) & F.col("distinct_out") & (F.size(twice) == 1) & (F.get(twice, F.lit(0)) >= PAIR_LEAST) & ((n_out != 4) | (F.get(others, F.lit(0)) != F.get(others, F.lit(1))))
    )

    jm = _top(F.filter(v, lambda x: x > DUST))
    large = (n_in < MAKERS_LARGE) | ((n_in / jm["n"] <= MAKERS_FAN_IN) & (n_out / jm["n"] >= MAKERS_OUTPUTS))
    joinmarket = (jm["n"] >= n_out / 2) & jm["n"].between(MAKERS, scripts) & F.col("distinct_out") & F.exists(v, lambda x: x != jm["v"]) & large

    near = _top(F.filter(v, lambda x: F.abs(x - TENTH) <= TENTH_WINDOW))
    wasabi_10 = (n_in >= ROUND_INPUTS) & spread & (near["n"] >= ROUND_PEOPLE) & (near["n"] >= (n_out - 1) / 2) & scripts.between(near["n"], PER_PERSON * near["n"]) & F.col("distinct_out") & ~even

    # Levels of 0.1 coin times powers of two; 2**40 of them exceed all coins there can be.
    level = lambda k: F.size(F.filter(v, lambda x: F.abs(x - TENTH * F.pow(F.lit(2.0), k)) <= TENTH_WINDOW * F.pow(F.lit(2.0), k)))
    reach = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: TENTH * F.pow(F.lit(2.0), k) <= F.array_max(v))
    levels = F.filter(F.transform(reach, lambda k: F.struct(level(k).alias("n"), k.alias("k"))), lambda x: x["n"] >= 2)
    rows = rows.withColumn("levels", levels)
    people, mixed = F.array_max(F.transform("levels", lambda x: x["n"])), _sum(F.transform("levels", lambda x: x["n"].cast("long")))
    majority, sums = mixed >= (n_out - 1) / 2, mixed >= n_out - scripts - 1
    wasabi_11 = (n_in >= ROUND_INPUTS) & spread & (people >= ROUND_PEOPLE) & scripts.between(people, PER_PERSON * people) & (majority | sums) & F.col("distinct_out") & ~even
    tight = (50 + 50 * (people / scripts - 1 / PER_PERSON) / (1 - 1 / PER_PERSON)).cast("int")

    tiers = F.transform(F.filter("freq", lambda x: x["n"] >= LARGE_REPEATS), lambda x: x["v"])
    tiered = F.size(F.filter(v, lambda x: F.array_contains(tiers, x)))
    wasabi_20 = (n_in >= LARGE_INPUTS) & spread & (F.array_min(v) >= LARGE_LEAST) & F.col("distinct_out") & (F.size(tiers) >= LARGE_TIERS) & (tiered >= (n_out - 1) / 2) & (tiered < n_out)

    pool = F.coalesce(*[F.when(F.forall(v, lambda x: x == d) & F.forall("paid", lambda x: (x == d) | x.between(d + POOL_FEE_LOW, d + POOL_FEE_HIGH)), F.lit(d)) for d, _ in POOLS])
    entrants = F.size(F.filter("paid", lambda x: x > pool))
    whirlpool = n_in.between(5, 8) & (n_out == n_in) & (scripts == n_in) & F.col("distinct_out") & pool.isNotNull() & entrants.between(1, 4)

    def tx0(d: int, fee: int) -> Column:
        inside = _frequency(F.filter(v, lambda x: x.between(d + POOL_FEE_LOW, d + POOL_FEE_HIGH)))
        most = F.array_max(inside)["n"]
        fees = F.size(F.filter(v, lambda x: x.between(COORDINATOR_LOW * fee, COORDINATOR_HIGH * fee)))
        return F.when(most.between(1, PREMIX_MOST) & (most >= n_out - 2) & (fees == 1), F.lit(d))

    bare = F.size(F.filter("all_o", lambda x: x.isNotNull() & (F.coalesce(F.size(x["address"]), F.lit(0)) <= 0)))
    premix = F.when((bare == 1) & (n_out >= 2), F.coalesce(*[tx0(d, f) for d, f in POOLS]))

    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "tx_id",
        no(stonewall).alias("stonewall"),
        no(joinmarket).alias("joinmarket"),
        F.when(no(joinmarket), jm["n"]).alias("joinmarket_participants"),
        no(wasabi_10).alias("wasabi_10"),
        no(wasabi_11).alias("wasabi_11"),
        F.when(no(wasabi_11), F.when(majority & sums, tight).otherwise(F.floor(tight / 2))).cast("int").alias("wasabi_11_confidence"),
        no(wasabi_20).alias("wasabi_20"),
        F.when(no(wasabi_20), F.greatest(F.floor(scripts / LARGE_PER_PERSON), F.lit(1))).cast("int").alias("wasabi_20_participants"),
        no(whirlpool).alias("whirlpool"),
        F.when(no(whirlpool), pool).alias("whirlpool_pool"),
        premix.isNotNull().alias("whirlpool_tx0"),
        premix.alias("whirlpool_tx0_pool"),
    )


def change(txs: DataFrame, addresses: DataFrame) -> DataFrame:
    """(tx_id, n, address, rule, confidence): outputs that look like change.

    direct_change: the address is also an input. multi_input_change: it is in the cluster of
    an input. one_time_change: in transactions of 2 to 10 outputs, the single address that
    has the inputs' script type, a value that isn't in thousands and is below every input,
    no earlier or repeated use, and one output. ``addresses`` has address, cluster_id,
    no_incoming_txs, no_outgoing_txs and first_block.
    """
    usual = txs.filter(~F.coalesce("coinbase", F.lit(False)))
    ins = usual.select("tx_id", F.explode(_addressed("inputs")).alias("i")).select("tx_id", _first(F.col("i")).alias("address")).distinct()
    each = usual.select("tx_id", "block_id", _addressed("inputs").alias("i"), F.size("outputs").alias("n_out"), F.posexplode("outputs").alias("n", "o")).filter("o is not null and size(o.address) > 0")
    types = F.array_distinct(F.transform("i", lambda x: x["address_type"]))
    same_type = (F.size(types) == 1) & (F.get(types, F.lit(0)) != 0) & (F.get(types, F.lit(0)) == F.col("o.address_type"))
    least = F.array_min(F.transform("i", lambda x: x["value"]))
    outs = each.select("tx_id", "block_id", "n", "n_out", F.get("o.address", F.lit(0)).alias("address"), (same_type & (F.col("o.value") % 1000 != 0) & (F.col("o.value") < least)).alias("fits"))
    known = outs.join(addresses.select("address", "cluster_id", "no_incoming_txs", "no_outgoing_txs", "first_block"), "address", "left")

    direct = known.join(ins, ["tx_id", "address"], "left_semi").select("tx_id", "n", "address", F.lit("direct_change").alias("rule"))
    spent = ins.join(addresses.select("address", "cluster_id"), "address").select("tx_id", "cluster_id").distinct()
    multi = known.join(spent, ["tx_id", "cluster_id"], "left_semi").select("tx_id", "n", "address", F.lit("multi_input_change").alias("rule"))

    reused = F.coalesce((F.col("no_incoming_txs") > 1) | (F.col("no_outgoing_txs") > 1) | (F.col("first_block") < F.col("block_id")), F.lit(False))
    per = known.filter(F.col("n_out").between(2, 10)).groupBy("tx_id", "address").agg(F.count("*").alias("times"), F.bool_or(F.coalesce("fits", F.lit(False)) & ~reused).alias("fits"), F.min("n").alias("n"))
    fitting = per.filter("fits and times = 1")
    one = fitting.groupBy("tx_id").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("address").alias("address")).filter("c = 1")
    one = one.select("tx_id", "n", "address", F.lit("one_time_change").alias("rule"))
    found = direct.union(multi).union(one)
    confidence = F.coalesce(*[F.when(F.col("rule") == r, F.lit(c)) for r, c in CONFIDENCE.items()])
    return found.withColumn("confidence", confidence)


def change_consensus(found: DataFrame) -> DataFrame:
    """(tx_id, address, confidence, rules): the addresses of a transaction with its highest confidence."""
    each = found.groupBy("tx_id", "address").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("rule")).alias("rules"))
    best = each.groupBy("tx_id").agg(F.max("confidence").alias("confidence"))
    return each.join(best, ["tx_id", "confidence"])


def exchange_inputs(txs: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Ids of transactions that an address of ``exchanges`` (address) pays into."""
    ins = txs.select("tx_id", F.explode(_addressed("inputs")).alias("i")).select("tx_id", F.explode("i.address").alias("address"))
    return ins.join(exchanges, "address", "left_semi").select("tx_id").distinct()


#: Weight of a match and of a mismatch, and whether a mismatch tells wallets apart by itself.
SIGNALS = {
    "script_type": (5, -80, "discriminator"),
    "witness_present": (3, -20, "score"),
    "tx_version": (5, -30, "discriminator"),
    "rbf": (3, -25, "discriminator"),
    "locktime_pattern": (4, -15, "discriminator"),
    "bip69_outputs_sorted": (2, -10, "score"),
}


def locktime_class(locktime: Column, height: Column) -> Column:
    """zero, anti_sniping (a height up to 100 blocks back) or other."""
    recent = (locktime > 0) & (locktime < 500_000_000) & (locktime <= height) & (height - locktime <= 100)
    return F.when(locktime == 0, "zero").when(recent, "anti_sniping").when(locktime.isNotNull(), "other")


def sorted_outputs(outputs: Column) -> Column:
    """Whether outputs stand in ascending order of value, then address."""
    keys = F.transform(outputs, lambda x: F.struct(x["value"], F.get(x["address"], F.lit(0))))
    return keys == F.array_sort(keys)


def compare(traits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, signal, verdict, weight) for pairs of transactions.

    ``traits`` has tx_id and a column for each signal; a null trait is inconclusive. Few
    values repeated over all transactions are small on disk and large in memory, so the
    joins are shuffled whatever the files' size promises.
    """
    names = list(SIGNALS)
    a = traits.select(F.col("tx_id").alias("left_id"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = traits.select(F.col("tx_id").alias("right_id"), *[F.col(n).alias(f"b_{n}") for n in names])
    joined = pairs.join(a.hint("merge"), "left_id").join(b.hint("merge"), "right_id")
    each = []
    for name, (match, miss, _) in SIGNALS.items():
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        known, same = x.isNotNull() & y.isNotNull(), x == y
        verdict = F.when(~known, "inconclusive").when(same, "match").otherwise("mismatch")
        each.append(F.struct(F.lit(name).alias("signal"), verdict.alias("verdict"), F.when(~known, 0).when(same, match).otherwise(miss).alias("weight")))
    return joined.select("left_id", "right_id", F.explode(F.array(*each)).alias("s")).select("left_id", "right_id", "s.*")


def verdicts(signals: DataFrame, shared_cluster: DataFrame) -> DataFrame:
    """(left_id, right_id, matched, mismatched, verdict): weights summed, with the pairs that share a cluster."""
    sums = signals.groupBy("left_id", "right_id").agg(
        F.coalesce(F.sum(F.when(F.col("verdict") == "match", F.col("weight"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "mismatch", F.col("weight"))), F.lit(0)).alias("mismatched"),
    )
    known = sums.join(shared_cluster.distinct().withColumn("shared", F.lit(True)).hint("merge"), ["left_id", "right_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    low = F.col("mismatched")
    verdict = F.when(F.col("shared") & (low > -60), "likely_linked").when(low <= -60, "likely_unlinked").when(low < -30, "potential_unlink").otherwise("inconclusive")
    return known.withColumn("verdict", verdict)
