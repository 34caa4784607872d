"""Operators on small fixtures: golden cases, edge cases, and two ways that have to agree."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, evm, money
from ledgerloom.functions.text import normalized, similarity
from ledgerloom.operators import account, heuristics, ids, rates, reshape, serving, swaps, tags, utxo
from ledgerloom.operators.components import connected_components, mapping_min
from ledgerloom.plans.stage import StageCache
from ledgerloom.sources import lake, scan
from ledgerloom.streaming import delta

TX = "tx_id long, block_id int, timestamp long, coinbase boolean, coinjoin boolean, total_input long, total_output long, inputs array<struct<address: array<string>, value: bigint, address_type: int>>, outputs array<struct<address: array<string>, value: bigint, address_type: int>>"


def txs_of(spark, rows):
    """rows: (tx_id, [(address, value)], [(address, value)]); block = tx_id."""
    io = lambda side: [((a if isinstance(a, list) else [a]), v, 1) for a, v in side]
    return spark.createDataFrame([(i, i, i * 600, False, False, sum(v for _, v in a), sum(v for _, v in b), io(a), io(b)) for i, a, b in rows], TX)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dense_ids_are_in_order_and_without_gaps(spark):
    numbers = random.Random(1).sample(range(10_000), 3000)
    out = ids.dense_ids(spark.createDataFrame([(n,) for n in numbers], "n long").repartition(7), ["n"], "id", 5)
    assert values(out, "n", "id") == [(n, i + 5) for i, n in enumerate(sorted(numbers))]
    assert ids.dense_ids(spark.createDataFrame([], "n long"), ["n"], "id").count() == 0


def test_netting_statistics_and_shares(spark):
    txs = txs_of(spark, [(0, [("a", 60), ("b", 40)], [("c", 70), ("a", 30)]), (1, [("c", 70)], [("c", 70)]), (2, [(["x", "y"], 5), ("c", 10)], [("d", 15)])])
    i, o = utxo.regular_inputs(txs), utxo.regular_outputs(txs)
    table = utxo.address_ids(i, o)
    assert values(table, "address", "address_id") == [("a", 1), ("b", 2), ("c", 3), ("coinbase", 0), ("d", 4)]
    ledger = utxo.address_transactions(i, o, table)
    assert values(ledger, "tx_id", "address_id", "value") == [(0, 1, -30), (0, 2, -40), (0, 3, 70), (1, 3, 0), (2, 3, -10), (2, 4, 15)]
    plain = utxo.plain_relations(txs, i, ledger)
    # a and b net 70 of 100; the rest went back to a. In the last, 5 of 15 came from an input of two addresses.
    assert values(plain, "tx_id", "src_id", "dst_id", "estimated_value") == [(0, 1, 3, 30), (0, 2, 3, 40), (2, 3, 4, 10)]
    rated = spark.createDataFrame([(0, [100.0, 200.0])], "block_id int, fiat_values array<double>")
    stats = {r.address_id: r for r in utxo.statistics(ledger, rated, "address_id").collect()}
    assert (stats[3].no_incoming_txs, stats[3].no_outgoing_txs, stats[3].total_received, stats[3].total_spent, stats[3].last_tx_id) == (1, 1, 70, 10, 2)


def test_clusters_use_all_addresses_and_skip_mixing(spark):
    txs = txs_of(spark, [(0, [("a", 1), ("b", 1)], [("z", 2)]), (1, [(["b", "c"], 1)], [("z", 1)]), (2, [("d", 1), ("e", 1)], [("z", 2)])])
    mixed = txs.withColumn("coinjoin", F.when(F.col("tx_id") == 2, True).when(F.col("tx_id") == 1, F.lit(None)).otherwise(False))
    names = spark.createDataFrame([(c, i) for i, c in enumerate("abcdez", 1)], "address string, address_id long")
    assert values(utxo.address_clusters(mixed, names), "address_id", "cluster_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert (5, 4) in values(utxo.address_clusters(mixed, names, skip_coinjoin=False), "address_id", "cluster_id")


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    used = {v for a, b in edges if a != b for v in (a, b)}
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert dict(values(found, "node", "component")) == {v: find(v) for v in used}
    assert all(n != 0 for n, _ in values(mapping_min(found), "node", "component"))


def test_cluster_tables_leave_out_flows_to_itself(spark):
    plain = spark.createDataFrame([(0, 0, 1, 2, 10), (0, 0, 1, 3, 5), (1, 1, 3, 1, 7)], "block_id int, tx_id long, src_id long, dst_id long, estimated_value long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "address_id long, cluster_id long")
    rated = spark.createDataFrame([], "block_id int, fiat_values array<double>")
    edges = utxo.cluster_relations(utxo.plain_cluster_relations(plain, clusters), rated)
    assert sorted((r.src_id, r.dst_id, r.value, r.value_adj) for r in edges.collect()) == [(1, 1, 10, None), (1, 3, 5, 5), (3, 1, 7, 7)]
    ledger = spark.createDataFrame([(1, 0, 0, -15), (3, 0, 0, 5), (1, 1, 1, 7)], "cluster_id long, tx_id long, block_id int, value long")
    out = {r.cluster_id: r for r in utxo.clusters_table(utxo.statistics(ledger, rated, "cluster_id"), clusters, edges).collect()}
    assert (out[1].no_addresses, out[1].in_degree, out[1].out_degree, out[1].total_received_adj, out[1].total_spent_adj) == (2, 2, 2, 7, 5)


def test_coinjoin_flag(spark):
    def flag(ins, outs):
        return utxo_flag(spark, ins, outs)

    def utxo_flag(spark, ins, outs):
        return txs_of(spark, [(0, ins, outs)]).select(utxo.coinjoin_flag(F.col("inputs"), F.col("outputs"))).first()[0]

    two = [("a", 5), ("b", 5)]
    assert flag(two, [("c", 4), ("d", 4), ("e", 1)]) is True
    assert flag(two, [("c", 546), ("d", 546), ("e", 1)]) is False
    assert flag([("a", 5), ("a", 5)], [("c", 4), ("d", 4), ("e", 1)]) is False
    assert flag(two, [("c", 4), ("d", 3), ("e", 1)]) is False
    assert flag(two[:1], [("c", 4), ("d", 4), ("e", 1)]) is False


def whirl(entrants):
    return [(f"i{k}", 1_000_000 + (300 if k < entrants else 0)) for k in range(5)], [(f"o{k}", 1_000_000) for k in range(5)]


def test_mixing_heuristics(spark):
    people = 12
    wasabi = ([(f"i{k}", 11_000_000 + k) for k in range(25)], [(f"o{k}", 10_000_000) for k in range(people)] + [(f"c{k}", 900_000 + 37 * k * k) for k in range(people)])
    levels = ([(f"i{k}", 50_000_000 + k) for k in range(25)], [(f"o{k}", 10_000_000) for k in range(8)] + [(f"p{k}", 20_000_000) for k in range(6)] + [(f"c{k}", 1_100_000 + 37 * k) for k in range(5)])
    tiers = ([(f"i{k}", 90_000 + k) for k in range(30)], [(f"o{k}", 10_000 * (1 + k % 4)) for k in range(20)] + [("c", 7_777)])
    maker = ([(f"i{k}", 100_000) for k in range(4)], [(f"o{k}", 70_000) for k in range(3)] + [(f"c{k}", 20_000 + k) for k in range(3)])
    tx0 = ([("a", 9_000_000)], [(f"p{k}", 1_000_300) for k in range(6)] + [("fee", 50_000), ("rest", 2_900_000), ([], 0)])
    cases = [whirl(2), whirl(0), ([("a", 9), ("b", 9)], [("c", 6000), ("d", 6000), ("e", 5)]), wasabi, levels, tiers, maker, tx0]
    out = {r.tx_id: r for r in heuristics.mixing(txs_of(spark, [(i, a, b) for i, (a, b) in enumerate(cases)])).collect()}
    assert out[0].whirlpool and out[0].whirlpool_pool == 1_000_000 and not out[1].whirlpool
    assert out[2].stonewall and not out[2].joinmarket
    assert out[3].wasabi_10 and out[3].wasabi_11
    assert out[4].wasabi_11 and out[4].wasabi_11_confidence > 0 and not out[0].wasabi_11
    assert out[5].wasabi_20 and out[5].wasabi_20_participants == 3 and not out[3].wasabi_20
    assert out[6].joinmarket and out[6].joinmarket_participants == 3
    assert out[7].whirlpool_tx0 and out[7].whirlpool_tx0_pool == 1_000_000 and not out[6].whirlpool_tx0


def test_change_and_consensus(spark):
    txs = txs_of(spark, [(5, [("a", 9001), ("b", 8001)], [("shop", 15_000), ("new", 1003)]), (6, [("a", 10)], [("x", 5), ("a", 5)])])
    known = spark.createDataFrame([("a", 1, 3, 2, 0), ("b", 1, 1, 1, 0), ("shop", 7, 9, 0, 0), ("new", 8, 1, 0, 5), ("x", 1, 1, 0, 6)], "address string, cluster_id long, no_incoming_txs int, no_outgoing_txs int, first_block int")
    found = heuristics.change(txs, known)
    assert values(found, "tx_id", "address", "rule") == [(5, "new", "one_time_change"), (6, "a", "direct_change"), (6, "a", "multi_input_change"), (6, "x", "multi_input_change"), (6, "x", "one_time_change")]
    best = heuristics.change_consensus(found)
    assert [(r.tx_id, r.address, r.confidence) for r in best.orderBy("tx_id").collect()] == [(5, "new", 50), (6, "a", 100)]


def test_compared_transactions(spark):
    schema = "tx_id long, script_type string, witness_present boolean, tx_version int, rbf boolean, locktime_pattern string, bip69_outputs_sorted boolean"
    traits = spark.createDataFrame([(1, "0", True, 1, True, "zero", True), (2, "0", True, 1, True, "zero", True), (3, "1", None, 2, False, "other", False)], schema)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id long, right_id long")
    out = {r.right_id: r for r in heuristics.verdicts(heuristics.compare(traits, pairs), pairs.filter("right_id = 2")).collect()}
    assert (out[2].matched, out[2].mismatched, out[2].verdict) == (22, 0, "likely_linked")
    assert (out[3].mismatched, out[3].verdict) == (-80 - 30 - 25 - 15 - 10, "likely_unlinked")


def test_rates_gaps_and_as_of(spark):
    daily = spark.createDataFrame([("1970-01-01", {"EUR": 1.0, "USD": 2.0}), ("1970-01-04", {"EUR": 3.0, "USD": 4.0})], "date string, fiat_values map<string,double>")
    assert money.fiat_names(daily) == ["EUR", "USD"]
    assert [r.fiat_values["EUR"] for r in rates.filled(daily).orderBy("date").collect()] == [1.0, 1.0, 1.0, 3.0]
    blocks = spark.createDataFrame([(0, 5), (1, 86_400), (2, 3 * 86_400), (3, 4 * 86_400)], "block_id int, timestamp long")
    assert values(rates.block_rates(blocks, daily, ["EUR", "USD"]), "block_id", "fiat_values") == [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])]
    rows = spark.createDataFrame([("t", 1), ("t", 5), ("t", 7), ("u", 9)], "k string, b int")
    quotes = spark.createDataFrame([("t", 5, 50.0), ("t", 6, 60.0)], "k string, b int, rate double")
    assert values(rates.as_of(rows, quotes, "k", "b", "rate").na.fill(-1.0), "k", "b", "rate") == [("t", 1, -1.0), ("t", 5, 50.0), ("t", 7, 60.0), ("u", 9, -1.0)]
    wrong = daily.union(spark.createDataFrame([("1970-01-05", {"EUR": 1.0})], daily.schema))
    with pytest.raises(ValueError):
        money.fiat_names(wrong)


def test_pegs_and_zero_rates(spark):
    df = spark.createDataFrame([("usd", [2.0, 4.0]), ("eur", [2.0, 4.0]), ("native", [2.0, 4.0]), (None, [2.0, 4.0]), ("usd", [0.0, 0.0])], "peg string, native array<double>")
    own = F.lit(None).cast("array<double>")
    assert [r[0] for r in df.select(money.pegged_rates(F.col("native"), own, F.col("peg"))).collect()] == [[0.5, 1.0], [1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [0.0, 1.0]]
    assert [r[0] for r in spark.range(1).select(money.utxo_fiat(F.lit(10**8 + 5 * 10**5), F.array(F.lit(1.0), F.lit(0.0)))).collect()] == [[1.01, 0.0]]
    both = spark.createDataFrame([("k", [1, 2]), ("k", [3, 4]), ("j", [5, 6])], "k string, v array<long>")
    assert values(money.sum_by_place(both, ["k"], "v"), "k", "v") == [("j", [5, 6]), ("k", [4, 6])]


def test_transfers_and_odd_logs(spark):
    pad = lambda x: x.rjust(64, "0")
    rows = [
        (1, "C0FFEE", [evm.TRANSFER, pad("aa" * 20), pad("bb" * 20)], pad("ff")),
        (2, "c0ffee", [evm.TRANSFER, pad("aa" * 20)], pad("1")),
        (3, "c0ffee", [evm.TRANSFER, pad("aa" * 20), pad("bb" * 20)], "f" * 64),
        (4, "c0ffee", ["00", pad("aa" * 20), pad("bb" * 20)], pad("1")),
        (5, "beef", [evm.TRANSFER, pad("aa" * 20), pad("bb" * 20)], pad("1")),
        (6, "c0ffee", [evm.TRANSFER, pad("aa" * 20), pad("bb" * 20)], ""),
    ]
    logs = spark.createDataFrame(rows, "log int, address string, topics array<string>, data string")
    known = spark.createDataFrame([("c0ffee", "TKN")], "contract string, ticker string")
    assert values(evm.decode_transfers(logs, known), "log", "from_address", "to_address", "value", "ticker") == [(1, "aa" * 20, "bb" * 20, 255, "TKN")]
    assert sorted(r.log for r in evm.undecodable(logs, known).collect()) == [2, 3, 6]
    big = spark.createDataFrame([(hex(10**37)[2:],), ("0",), ("xyz",)], "d string").select(evm.uint(F.col("d"))).collect()
    assert [r[0] for r in big] == [10**37, 0, None]


def test_balances_fees_and_valueless_calls(spark):
    coin = spark.createDataFrame([("a", "b", 10, None), ("a", "b", 99, "delegatecall"), (None, "a", 50, "call")], "from_address string, to_address string, value long, call_type string")
    tokens = spark.createDataFrame([("b", "a", 3, "TKN")], "from_address string, to_address string, value long, ticker string")
    fees = spark.createDataFrame([("a", "m", 6, 2)], "payer string, miner string, fee long, burnt long")
    out = {(r.address, r.currency): int(r.balance) for r in account.balances(coin, tokens, fees).collect()}
    assert out == {("a", "coin"): 34, ("b", "coin"): 10, ("m", "coin"): 4, ("a", "TKN"): 3, ("b", "TKN"): -3}


def test_failed_traces_take_their_calls_along(spark):
    rows = [("t", [], 1), ("t", [0], 0), ("t", [0, 0], 1), ("t", [1], 1), ("u", [0, 0], 1)]
    out = evm.failed_by_parent(spark.createDataFrame(rows, "tx_hash string, trace_address array<int>, status int"))
    assert values(out, "tx_hash", "trace_address", "status") == [("t", [], 1), ("t", [0], 0), ("t", [0, 0], 0), ("t", [1], 1), ("u", [0, 0], 1)]


def test_withdrawals_and_contract_rows(spark):
    blocks = spark.createDataFrame([(7, [("aa", 3), ("bb", 4)])], "block_id int, withdrawals array<struct<address: string, amount: bigint>>")
    assert [(r.trace_index, int(r.value)) for r in evm.withdrawals(blocks).collect()] == [(10**9, 3 * 10**9), (10**9 + 1, 4 * 10**9)]
    traces = spark.createDataFrame([("create_1", 1, "c"), ("call_1", 1, "d"), ("create_2", 0, "e")], "trace_id string, status int, to_address string")
    table = spark.createDataFrame([("c", 3), ("d", 4), ("e", 5)], "address string, address_id long")
    assert [r[0] for r in account.contracts(traces, table).collect()] == [3]
    txs = spark.createDataFrame([(1, None, "new", 1), (2, "x", None, 1), (3, None, None, 0)], "n int, to_address string, receipt_contract_address string, receipt_status int")
    assert [r.to_address for r in account.with_created_address(account.successful(txs)).orderBy("n").collect()] == ["new", "x"]
    assert [r.n for r in account.value_txs(txs).collect()] == [2]


def test_codecs_round_trip_and_known_values():
    assert codecs.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert codecs.keccak256(b"Transfer(address,address,uint256)").hex() == evm.TRANSFER
    rng = random.Random(3)
    for n in (0, 1, 20, 21, 33):
        raw = bytes(rng.randrange(256) for _ in range(n))
        assert codecs.base58_decode(codecs.base58_encode(b"\0\0" + raw)) == b"\0\0" + raw
        assert n == 0 or codecs.base58check_decode(codecs.base58check_encode(raw)) == raw
    for version, size in ((0, 20), (0, 32), (1, 32)):
        program = bytes(rng.randrange(256) for _ in range(size))
        assert codecs.segwit_decode(codecs.segwit_encode("bc", version, program)) == ("bc", version, program)
    assert codecs.segwit_decode("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5") is None
    assert codecs.tron_to_evm(codecs.evm_to_tron("0x" + "5a" * 20)) == "0x" + "5a" * 20
    kinds = {"1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa": "p2pkh", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy": "p2sh", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed": "evm", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAeD": None, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb": None}
    assert {a: codecs.valid_address(a) for a in kinds} == kinds


def test_codecs_as_columns_and_scan(spark):
    df = spark.createDataFrame([(1, "see 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa, 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb and again 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"), (2, None)], "k int, t string")
    assert values(scan.addresses_in(df, "k", "t"), "k", "address", "kind") == [(1, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "p2pkh")]
    raw = spark.createDataFrame([(b"\xff" * 32,), (None,)], "b binary").select(codecs.uint256_text(F.col("b"))).collect()
    assert [r[0] for r in raw] == [str(2**256 - 1), None]
    scripts = {"76a914" + "00" * 20 + "88ac": "p2pkh", "a914" + "11" * 20 + "87": "p2sh", "5120" + "22" * 32: "p2tr", "6aff": "nulldata", "51" + "21" + "33" * 33 + "51ae": "multisig", "00": "nonstandard"}
    out = spark.createDataFrame([(s,) for s in scripts], "s string").select("s", codecs.script_type(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in out} == scripts


def test_lake_appends_overwrites_and_discards(spark, tmp_path):
    store = lake.Lake(spark, f"file://{tmp_path}/lake")
    rows = lambda a, b, v: spark.createDataFrame([(i // 10, i, v) for i in range(a, b)], "partition int, block_id int, v string")
    assert store.highest_block("t") is None
    store.merge_new("t", rows(0, 25, "a"), ["block_id"], "partition")
    store.merge_new("t", rows(20, 30, "b").union(rows(29, 30, "b")), ["block_id"], "partition")
    assert store.highest_block("t") == 29 and store.read("t").count() == 30
    assert values(store.read("t", 23, 26, ["block_id", "v"]), "block_id", "v") == [(23, "a"), (24, "a"), (25, "b"), (26, "b")]
    store.overwrite_partitions("t", rows(10, 12, "c"), "partition")
    assert store.read("t").count() == 22
    store.discard_above("t", 10, "partition")
    assert sorted(r.block_id for r in store.read("t").collect()) == list(range(11))
    assert [r.block_id for r in store.items("t", [3, 99], 10).collect()] == [3]
    store.append("t", rows(40, 41, "d").withColumn("extra", F.lit(1)), "partition")
    assert {r.extra for r in store.read("t").collect()} == {None, 1}
    store.compact("t", "partition", 0)
    assert store.read("t").count() == 12 and lake.divergence(store, ["t"]) == {"t": 40}


def test_ranges_audit_and_oversized_keys(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 7, 9, 10, 10)], "v long")
    assert values(lake.processed_ranges(df, "v"), "range_start", "range_end") == [(1, 3), (7, 7), (9, 10)]
    assert values(lake.missing_ranges(df, "v"), "gap_start", "gap_end") == [(4, 6), (8, 8)]
    small, large = lake.oversized_keys(df, ["v"], 1)
    assert (small.count(), large.count()) == (5, 2)
    assert lake.partition_audit(df.repartition(3, "v"), "v").agg(F.sum("rows")).first()[0] == 7
    assert lake.salted(df, ["v"], 4).count() == 7


def test_aligned_and_flat_columns(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    df = spark.createDataFrame([(1, (2, (3,)))], "blockId int, s struct<aB: int, c: struct<d: int>>")
    out = lake.aligned(df, StructType([StructField("block_id", StringType()), StructField("more", LongType())]))
    assert out.collect() == [("1", None)]
    assert reshape.flat(df).columns == ["blockId", "s_aB", "s_c_d"]


def test_stage_cache_reuses_and_refuses(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    root = f"file://{tmp_path}/stages"
    assert StageCache(spark, root, {"end": 5}).get("a", compute).count() == 3
    assert StageCache(spark, root, {"end": 5}).get("a", compute).count() == 3 and made == [1]
    with pytest.raises(ValueError):
        StageCache(spark, root, {"end": 6})


def test_raw_transaction_ids_and_inputs(spark):
    rng = random.Random(2)
    keys = sorted({(rng.randrange(40_000), rng.randrange(5)) for _ in range(500)})
    shuffled = rng.sample(keys, len(keys))
    out = reshape.transaction_ids(spark.createDataFrame(shuffled, "block_id int, index int"), start=10)
    assert values(out, "block_id", "index", "tx_id") == [(b, i, n + 10) for n, (b, i) in enumerate(keys)]
    ins = spark.createDataFrame([(b"\x01", 0), (b"\x02", 9)], "spent_tx_hash binary, spent_output_index int")
    outs = spark.createDataFrame([(b"\x01", 0, "a", "t", 5)], "tx_hash binary, index int, address string, type string, value long")
    assert sorted(r.value or 0 for r in reshape.resolved_inputs(ins, outs, strict=False).collect()) == [0, 5]
    with pytest.raises(Exception, match="no output 9"):
        reshape.resolved_inputs(ins, outs).collect()
    logs = spark.createDataFrame([([b"\x05"],), ([],), (None,)], "topics array<binary>")
    assert [bytes(r.topic0) for r in reshape.prepared_logs(logs).collect()] == [b"\x05", b"", b""]


def test_skewed_groups_are_cut(spark):
    rows = [(0, i) for i in range(1000)] + [(g, g * 10 + i) for g in range(1, 9) for i in range(10)]
    out = ids.skewed_secondary_ids(spark.createDataFrame(rows, "g int, k long"), "g", "k")
    assert {r.g: r.p for r in out.groupBy("g").agg(F.count_distinct("secondary_group").alias("p")).collect()} == {0: 40, **{g: 1 for g in range(1, 9)}}
    assert values(ids.secondary_lookup(out, "g"), "g", "max_secondary_id") == [(0, 39)]
    wide = spark.createDataFrame([(2**31 * 10 + 5,)], "v long").select(ids.wrapped_group(F.col("v"), 10).alias("w"), ids.saturated(F.col("v")).alias("s")).first()
    assert (wide.w, wide.s) == (-(2**31), 2**31 - 1)


def test_swaps_and_balance_of_flows(spark):
    rows = [(1, "me", "me", "pool", "A", 5), (1, "me", "pool", "me", "B", 7), (2, "me", "me", "x", "A", 5), (3, "me", "me", "p", "A", 5), (3, "me", "p", "me", "A", 1), (3, "me", "p", "me", "B", 1)]
    flows = spark.createDataFrame(rows, "tx_id int, sender string, source string, target string, asset string, amount long")
    assert values(swaps.swaps(flows), "tx_id", "asset_in", "amount_in", "asset_out", "amount_out") == [(1, "A", 5, "B", 7), (3, "A", 4, "B", 1)]
    assert values(swaps.balanced(flows), "tx_id", "eulerian") == [(1, True), (2, False), (3, False)]


def test_trigram_similarity_and_labels(spark):
    row = spark.range(1).select(similarity(F.lit("word"), F.lit("two words")), similarity(F.lit(""), F.lit("")), normalized(F.lit("  A--b_c!! D ")))
    a, b, c = row.first()
    assert (round(a, 6), b, c) == (0.363636, 0.0, "a b_c d")


TAG = "tag_id long, network string, identifier string, label string, actor string, confidence int, is_cluster_definer boolean, concepts array<string>, acl_group string, source string, creator string"


def test_tag_digest_prefers_the_actor_and_breaks_ties(spark):
    rows = [(1, "n", "x", "Big Shop", "acme", 50, True, ["exchange"], "public", "s", "c"), (2, "n", "x", "other thing", None, 90, False, [], "public", "s", "c"), (3, "n", "y", "b", None, 0, None, None, "public", "s", "c"), (4, "n", "y", "a", " ", None, None, [], "private", "s", "c")]
    table = spark.createDataFrame(rows, TAG)
    out = {r.identifier: r for r in tags.digest(table, "identifier").collect()}
    assert (out["x"].best_actor, out["x"].best_label, out["x"].broad_concept, out["x"].nr_tags) == ("acme", "Big Shop", "exchange", 2)
    assert (out["y"].best_actor, out["y"].best_label, out["y"].broad_concept) == (None, "a", "entity")
    assert {r.tag_id: r.label for r in tags.obfuscated(table).collect()}[4] is None


def test_quality_counts_pairs_of_repeated_labels(spark):
    rows = [(i, "n", "x", label, None, 1, None, [], "public", "s", "c") for i, label in enumerate(["same", "same", "same", "zzzz"])]
    out = tags.quality(spark.createDataFrame(rows, TAG)).first()
    assert (out.n_tags, out.n_dif_tags, out.q1, out.q4, out.total_pairs) == (4, 2, 3, 3, 6) and abs(out.quality - (1 - (3 * 0.25 + 3) / 6)) < 1e-12


def test_mapping_versions_and_concepts(spark):
    old = spark.createDataFrame([("n", "a", 1, 1), ("n", "b", 2, 1)], "network string, address string, cluster_id long, v int")
    new = spark.createDataFrame([("n", "a", 9, 2)], old.schema)
    assert values(tags.latest_mapping(old, new, "v"), "address", "cluster_id") == [("a", 9), ("b", 2)]
    tree = spark.createDataFrame([("root", None), ("kid", "root"), ("leaf", "kid")], "id string, parent string")
    assert values(tags.concept_paths(tree), "id", "root", "depth") == [("kid", "root", 1), ("leaf", "root", 2), ("root", "root", 0)]


def test_searches_from_a_node(spark):
    edges = spark.createDataFrame([(1, 2, 9, 1), (1, 3, 8, 1), (1, 4, 7, 1), (2, 5, 1, 1), (3, 5, 1, 1), (5, 1, 1, 1), (5, 6, 1, 1)], "src_id long, dst_id long, no_transactions int, value long")
    nodes = spark.createDataFrame([(i, 10 * i, 0, 1, 1) for i in range(1, 7)], "address_id long, total_received long, total_spent long, in_degree int, out_degree int")
    out = serving.search_neighbors(edges, nodes, "address_id", 1, 3, 2, F.col("total_received") > 20)
    assert values(out, "node_id", "depth", "parent_id") == [(3, 1, 1), (5, 2, 2), (6, 3, 5)]
    none = serving.search_neighbors(edges, nodes, "address_id", 1, 3, 2, F.lit(True), skip_above=1)
    assert none.count() == 0
    assert values(serving.neighbors(edges, nodes, "address_id", 5, False, [3]), "neighbor_id", "value") == [(3, 1)]


def test_top_untagged_doesnt_depend_on_the_pool(spark):
    rows = spark.createDataFrame([(i, f"a{i}", i % 3, 100 - i) for i in range(50)], "address_id long, address string, cluster_id long, m int")
    tagged = spark.createDataFrame([(f"a{i}",) for i in range(30)], "address string")
    none = spark.createDataFrame([(1,)], "cluster_id long")
    for pool in (1, 10):
        out = serving.top_untagged(rows, tagged, none, "m", 3, pool)
        assert values(out, "address_id", "cluster_tagged") == [(30, False), (31, True), (32, False)]


def test_batches_of_any_size_give_the_same_state(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(5), rng.randrange(100)) for _ in range(60)]
    how = {"n": "sum", "lo": "min", "hi": "max"}
    to = lambda part: spark.createDataFrame([(k, 1, v, v) for k, v in part], "k int, n long, lo int, hi int")
    whole = delta.merged(None, to(rows), ["k"], how)
    state = None
    for at in range(0, 60, 17):
        state = delta.merged(state, to(rows[at : at + 17]), ["k"], how)
    assert values(state, "k", "n", "lo", "hi") == values(whole, "k", "n", "lo", "hi")


def test_a_repeated_batch_is_applied_once(spark, tmp_path):
    state = delta.State(spark, f"file://{tmp_path}/state")
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    assert state.read() is None
    for number in (0, 1, 1, 2):
        state.write(number, delta.merged(state.read(before=number), one, ["k"], {"n": "sum"}))
    assert values(state.read(), "k", "n") == [("a", 3)]


def test_batch_ranges_are_checked(spark):
    assert delta.import_range(10, 7, 3) == (4, 7) and delta.import_range(10, 7, 3, fill=True) == (4, 10) and delta.import_range(5, 5, 5) is None
    blocks = spark.createDataFrame([(4,), (5,)], "block_id int")
    delta.contiguous(blocks, 3)
    for last in (2, 4):
        with pytest.raises(ValueError):
            delta.contiguous(blocks, last)


def test_clusters_merge_into_the_least_id(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "address_id long, cluster_id long")
    edges = spark.createDataFrame([(2, 6), (20, 21)], "u long, v long")
    assert values(delta.merged_clusters(known, edges), "address_id", "cluster_id") == [(1, 1), (2, 1), (5, 1), (6, 1), (9, 9), (20, 20), (21, 20)]


def test_watchlist_flows_and_staleness(spark):
    flows = delta.flows(txs_of(spark, [(0, [(["a", "b"], 10)], [("c", 9)])]))
    assert values(flows, "address", "side", "value") == [("a", "out", 5.0), ("b", "out", 5.0), ("c", "in", 9.0)]
    watch = spark.createDataFrame([("a", "out", 4.0), ("b", "in", 1.0), ("c", None, 9.0)], "address string, direction string, value_gt double")
    assert values(delta.watched(flows, watch), "address", "value") == [("a", 5.0)]
    assert delta.stale(spark.createDataFrame([(0, 3600)], "block_id int, timestamp long"), 3600 * 8, 6).first() == (7.0, True)


def test_pubkeys_in_two_networks(spark):
    keys = spark.createDataFrame([("k", "btc", "a"), ("k", "ltc", "b"), ("j", "btc", "c")], "pubkey string, network string, address string")
    assert values(serving.cross_network(keys), "pubkey", "networks") == [("k", ["btc", "ltc"])]
    assert serving.cross_network(keys, keys.filter("pubkey = 'k'")).count() == 0
    assert values(serving.related_by_key(keys, "a"), "network", "address") == [("ltc", "b")]


def test_long_abi_values_and_broken_ones(spark):
    from ledgerloom.functions import abi

    word = lambda n: f"{n:064x}"
    text = "grüße".encode()
    body = word(32) + word(len(text)) + text.hex().ljust(64, "0")
    cases = {
        "text": (body, "string", "grüße"),
        "empty": (word(32) + word(0), "string", ""),
        "bytes": (word(32) + word(2) + "ABcd".ljust(64, "0"), "bytes", "abcd"),
        "list": (word(32) + word(2) + word(7) + word(2**100), "uint256[]", f'["7","{2**100}"]'),
        "no entries": (word(32) + word(0), "uint256[]", "[]"),
        "long count": (word(32) + word(3) + word(7), "uint256[]", None),
        "long text": (word(32) + word(33) + text.hex().ljust(64, "0"), "string", None),
        "far": (word(2**40) + word(0), "string", None),
        "farther": (word(2**200) + word(0), "bytes", None),
        "not text": (word(32) + word(1) + "ff".ljust(64, "0"), "string", None),
        "nothing": ("", "string", None),
        "null": (None, "uint256[]", None),
    }
    for name, (data, kind, want) in cases.items():
        got = spark.createDataFrame([(data,)], "data string").select(abi.long_value(kind, F.col("data"), 0)).first()[0]
        assert got == want, name


def test_comparisons_of_all_transactions_are_not_broadcast(spark):
    from ledgerloom.operators import heuristics
    from ledgerloom.plans.stage import cut

    same = [F.lit(None).cast("boolean").alias(name) for name in heuristics.SIGNALS]  # nothing on disk, a row each in memory
    traits = cut(spark.range(1000).select(F.col("id").alias("tx_id"), *same), "traits")
    pairs = traits.select(F.col("tx_id").alias("left_id"), (F.col("tx_id") + 1).alias("right_id"))
    out = heuristics.verdicts(heuristics.compare(traits, pairs), pairs.filter("left_id % 2 = 0"))
    rows = out.collect()
    assert len(rows) == 999 and sum(r.shared for r in rows) == 500
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_parameters_of_any_length_are_worked_out_once(spark):
    from ledgerloom.functions import abi

    known = {"f(string,uint256[])": {"name": "f", "params": [("text", "string"), ("list", "uint256[]")]}}
    out = abi.decode_calls(spark.createDataFrame([("",)], "input string").select(F.concat("input", F.lit("00")).alias("input")), known)
    # An offset and a length for each parameter and the word of an entry are numbers: five of them, each checked once.
    assert out.select("arguments")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 5


def test_memos_of_every_length_and_broken_scripts(spark):
    from ledgerloom.functions import memo

    data = lambda n: ("ab" * n).encode().hex()[: 2 * n]
    good = {"6a" + f"{n:02x}" + data(n): n for n in (0, 1, 75)} | {"6a4c" + f"{n:02x}" + data(n): n for n in (76, 255)} | {"6a4d2c01" + data(300): 300}
    bad = [None, "", "6a", "6a02" + data(1), "6a4c", "6a4d05", "6a4e0100000061", "76a914", "6a016", "6a01zz"]
    rows = spark.createDataFrame([(s,) for s in [*good, *bad]], "script string").select("script", memo.memo(F.col("script")).alias("m")).collect()
    assert {r.script: None if r.m is None else len(r.m) for r in rows} == good | dict.fromkeys(bad)
    parts = [tuple(r.p) if r.p else None for r in spark.createDataFrame([("=:A.B:x:9",), ("s::x",), ("+:P",), ("hello",), ("=",), (None,)], "t string").select(memo.memo_parts(F.col("t")).alias("p")).collect()]
    assert parts == [("swap", "A.B", "x", "9"), ("swap", None, "x", None), ("+", "P", None, None), None, None, None]


def test_lake_probes_marks_and_catching_up(spark, tmp_path):
    from ledgerloom.sources.lake import Lake, catch_up

    a, b = (Lake(spark, str(tmp_path / n)) for n in "ab")
    assert a.columns("t") == [] and a.partitions("t") == [] and a.is_empty("t") and a.complete_up_to("t") is None
    rows = spark.createDataFrame([(i, i // 3, i // 6) for i in range(20)], "k long, block_id long, partition long")
    a.append("t", rows, "partition")
    assert a.partitions("t") == ["partition=0", "partition=1", "partition=2", "partition=3"] and not a.is_empty("t") and set(a.columns("t")) == {"k", "block_id", "partition"}
    for block in (5, 6, 2):
        a.mark_complete("t", block)
    assert a.complete_up_to("t") == 6
    catch_up(a, b, "t", ["k"], "partition")
    catch_up(a, b, "t", ["k"], "partition")
    assert sorted(r.k for r in b.read("t").collect()) == list(range(20))
