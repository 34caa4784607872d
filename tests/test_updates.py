"""Batches, plans and buckets; components with hubs; trees of concepts; address codecs."""

from __future__ import annotations

import random

import pytest

from ledgerloom.functions import codecs
from ledgerloom.operators import components, tags
from ledgerloom.plans import stage
from ledgerloom.streaming import update

ROW = "address_id long, first_tx_id long, last_tx_id long, no_incoming_txs long, no_outgoing_txs long, total_received long, total_spent long"


def test_a_batch_counts_once_and_only_when_it_is_whole(spark, tmp_path):
    state = update.Buckets(spark, str(tmp_path), ["address_id"], update.ENTITY, 4)
    assert state.read() is None
    one = spark.createDataFrame([(i, 1, 2, 1, 1, 10, 5) for i in range(20)], ROW)
    assert state.apply(0, one, update.ENTITY_CHECKS) == 4
    two = spark.createDataFrame([(3, 5, 9, 2, 0, 7, 0), (50, 5, 5, 1, 0, 1, 0)], ROW)
    assert state.apply(1, two, update.ENTITY_CHECKS) <= 2 and state.apply(1, two) <= 2
    # A batch that stops before its manifest leaves files that nobody reads.
    one.withColumn("bucket", one.address_id % 4).write.partitionBy("bucket").parquet(f"{tmp_path}/data/2")
    got = {r.address_id: tuple(r)[1:] for r in state.read().select(*one.columns).collect()}
    assert len(got) == 21 and got[3] == (1, 9, 3, 1, 17, 5) and got[4] == (1, 2, 1, 1, 10, 5) and got[50] == (5, 5, 1, 0, 1, 0)
    back = spark.createDataFrame([(3, 1, 2, 1, 1, -1, 5)], ROW)
    with pytest.raises(ValueError, match="totals"):
        state.apply(3, back, update.ENTITY_CHECKS)
    assert state.apply(3, one.limit(0)) == 0 and state.read().count() == 21


def test_plans_say_what_is_new_and_what_was_there(spark):
    state = spark.createDataFrame([(1, 1, 2, 1, 1, 10, 5)], ROW)
    delta = spark.createDataFrame([(1, 4, 6, 1, 0, 3, 0), (2, 5, 5, 0, 1, 0, 3)], ROW)
    plan = {r.address_id: r for r in update.planned(state, delta, ["address_id"], update.ENTITY).collect()}
    assert (plan[1].change, plan[1].last_tx_id, plan[1].old_last_tx_id, plan[1].total_received) == ("changed", 6, 2, 13)
    assert (plan[2].change, plan[2].old_total_spent) == ("new", None)
    assert {r.change for r in update.planned(None, delta, ["address_id"], update.ENTITY).collect()} == {"new"}


def brute(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("kind", ["path", "random", "hub"])
def test_components_over_many_tasks(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(400)], "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(700)], "hub": [(7, i) for i in range(1000)] + [(i, 5000 + i) for i in range(300)]}[kind]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (5, None), (8, 8)], "u long, v long").repartition(7)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == brute(edges)


def test_deep_trees_and_circles_of_concepts(spark):
    rows = [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 25)] + [("x", "y"), ("y", "x")]
    got = {r.id: (r.root, r.depth) for r in tags.concept_paths(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == {f"c{i}": ("c0", i) for i in range(25)}


def test_first_witness_version_has_two_lengths():
    for size in (2, 19, 20, 21, 32, 33, 40):
        address = codecs.segwit_encode("bc", 0, bytes(size))
        assert (codecs.valid_address(address) == "segwit") == (size in (20, 32))
        assert codecs.valid_address(codecs.segwit_encode("bc", 1, bytes(size))) == "segwit"


def test_stages_are_deleted_and_need_a_shared_folder(spark, monkeypatch):
    kept = stage.cut(spark.range(3), "test")
    fs, path = stage.files(spark, kept._stage_path)
    assert fs.exists(path)
    stage.discard(kept, spark.range(1))
    assert not fs.exists(path)
    context = type("Context", (), {"master": "spark://somewhere:7077", "getConf": lambda self: {}, "applicationId": "none"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_root(type("Session", (), {"conf": {}, "sparkContext": context})())
