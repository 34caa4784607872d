"""Connected components with the least member as label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import cut, discard, ship

#: Edges that a task contracts at a time, which bounds its memory.
GATHER = 1 << 19


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node but the least ones, over the edges given."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars, GATHER at a time; stars made so far go in again with the next ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = least = 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
        size += batch.num_rows
        if size >= least + GATHER:
            held = [stars()]
            size = least = len(held[0][0])
            if least >= 4 * GATHER:
                yield rows(*held[0])
                held, size, least = [], 0, 0
    if size:
        yield rows(*stars())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v, whole numbers); the component is its least node.

    Each task first contracts the edges that it holds, wherever they lie, to stars. Rounds of
    that and of a large-star and a small-star step, each written to shared storage, move
    every edge to the least neighbour known, until no node has two lower neighbours, or
    both a lower and a higher one. Least neighbours are combined before the shuffle and
    written before they are joined, so that both sides of a join are shuffles and a hub's
    edges can be split. Nulls are no nodes; self-loops and repeats do no harm, but a
    self-loop alone doesn't make a node.
    """
    ship(edges.sparkSession)
    plain = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u is not null and v is not null and u != v")
    now = cut(plain.mapInArrow(_contract, "u long, v long"), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        below = F.when(F.col("v") < F.col("u"), F.col("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.min(below).alias("a"), F.max(below).alias("b"), F.max("v").alias("top"))
        least = cut(least.select("u", F.least("u", "m").alias("m"), ((F.col("a") < F.col("b")) | (F.col("a") < F.col("u")) & (F.col("top") > F.col("u"))).alias("open")), "least")
        if least.filter("open").isEmpty():
            discard(now)
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), "large")
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select("u", "v", "m")
        moved = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v")
        after = cut(moved.mapInArrow(_contract, "u long, v long"), "edges")
        discard(now, least, large, lower)
        now = after


def mapping_min(components: DataFrame, skip_singletons: bool = True) -> DataFrame:
    """Components without id 0 (the coinbase), and without those of one member if asked."""
    rows = components.filter("node != 0")
    if skip_singletons:
        many = rows.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        rows = rows.join(many, "component", "left_semi")
    return rows.select("node", "component")
