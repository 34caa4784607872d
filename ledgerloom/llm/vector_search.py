"""Exact top-k by inner product with a vector-approximation file.

1. The approximation file is written: blocks of vectors with a byte for each component, the
   cell out of CELLS equal ones between the block's least and greatest component.
2. Only that file is scanned for bounds: a query's product with a vector lies between two
   numbers that follow from the cells, and a block's bounds are one product of matrices.
   Groups of queries meet shares of the file, each pair of them in a task of its own. A
   vector whose upper bound is below k lower bounds goes.
3. Exact vectors are read, by a join, in the order of their upper bounds: the first FIRST * k
   of each query, then those whose bound reaches the k-th result so far. All others are
   below it for certain.

Of equal vectors only as many are kept as can be in a result, those of the smallest ids, so
a vector that a third of all rows have costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

CELLS, BLOCK, FIRST = 64, 2048, 2
#: Bytes of queries in a group, bytes of cells in a share, and queries whose bounds are held at a time.
GROUP_BYTES, SHARE_BYTES, CHUNK = 8 << 20, 16 << 20, 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(column), n).astype(np.float64, copy=False))


def _enough(ids: np.ndarray, one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be in a result: of equal vectors 2k rows of the smallest ids, of one id k at most.

    Whatever id a query excludes, k of them are left.
    """
    order = np.lexsort((ids, two, one))
    for cap, keys in ((k, (one, two, ids)), (2 * k, (one, two))):
        start = np.ones(len(order), dtype=bool)
        start[1:] = np.any([c[order][1:] != c[order][:-1] for c in keys], axis=0)
        first = np.flatnonzero(start)
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[nth < cap]
    return np.sort(order)


def _thinned(k: int):
    """Batches without the copies of a vector that can be in no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, one, two = (batch.column(c).to_numpy() for c in ("vec_id", "tag", "tag2"))
                yield batch.take(pa.array(_enough(ids, one, two, k)))

    return run


_FILE = "n int, ids binary, tags binary, lo double, step double, cells binary"


def _approximated(k: int):
    """Blocks of cells; rows come ordered by vector, so that copies stand together."""

    def block(rows: pa.Table) -> Iterator[tuple]:
        sizes = rows.column("n").to_numpy()
        for n in np.unique(sizes):
            some = rows.take(pa.array(np.flatnonzero(sizes == n)))
            x = _matrix(some.column("v").combine_chunks(), int(n))
            lo = float(x.min(initial=np.inf)) if x.size else 0.0
            step = max(1.0, float(np.ceil((x.max(initial=lo) - lo + 1) / CELLS))) if x.size else 1.0
            cells = np.clip(np.floor((x - lo) / step), 0, CELLS - 1).astype(np.uint8)
            yield int(n), some.column("vec_id").to_numpy().tobytes(), some.column("tag").to_numpy().tobytes(), lo, step, cells.tobytes()

    def written(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.num_rows, BLOCK):
            cols = list(zip(*block(rows.slice(a, BLOCK)), strict=True))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["n", "ids", "tags", "lo", "step", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            rows = rows.take(pa.array(_enough(*(rows.column(c).to_numpy() for c in ("vec_id", "tag", "tag2")), k)))
            # What may go on in the next batch waits: the rows of the last vector, 2k at most, and what fills no block.
            tags = rows.column("tag").to_numpy()
            whole = int((tags != tags[-1]).sum()) // BLOCK * BLOCK
            if whole:
                yield from written(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield from written(rest)

    return run


def _packed(rows: pa.Table) -> pa.Table:
    """One row for a group of queries of one size."""
    n = rows.column("n")[0].as_py()
    body = _matrix(rows.column("v").combine_chunks(), n).tobytes()
    cols = [pa.array([n], pa.int32()), rows.column("g").combine_chunks()[:1], *[pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("vec_id", "tag")], pa.array([body], pa.binary())]
    return pa.Table.from_arrays(cols, names=["n", "g", "qids", "qtags", "body"])


_CANDIDATES = "query_id long, tag long, vec_id long, vec_tag long, lower double, upper double"


def _bounded(k: int):
    """Candidates of a group of queries in a share of the file: vectors that k lower bounds of the share don't rule out."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for row in queries.to_pylist():
            n = row["n"]
            own, tags = (np.frombuffer(row[c], np.int64) for c in ("qids", "qtags"))
            q = np.frombuffer(row["body"], np.float64).reshape(len(own), n)
            for a in range(0, len(own), CHUNK):
                part = slice(a, a + CHUNK)
                for found in _scan(q[part], own[part], tags[part], blocks, n, k):
                    for held, column in zip(out, found, strict=True):
                        held.append(column)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        cols = [pa.array(np.concatenate(x) if x else np.empty(0), t) for x, t in zip(out, kinds, strict=True)]
        return pa.Table.from_arrays(cols, names=["query_id", "tag", "vec_id", "vec_tag", "lower", "upper"])

    return run


def _scan(q: np.ndarray, own: np.ndarray, tags: np.ndarray, blocks: pa.Table, n: int, k: int) -> Iterator[tuple]:
    size, total = np.abs(q).sum(axis=1), q.sum(axis=1)
    plus, minus = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    # Sums of whole numbers below 2**24 are exact in 32 bits.
    kind = np.float32 if size.max(initial=0) * CELLS < 2**24 else np.float64
    narrow = q.astype(kind)
    certain = np.full((len(q), k), -np.inf)
    held = []
    for b in range(blocks.num_rows):
        ids, vec_tags = (np.frombuffer(blocks.column(c)[b].as_py(), np.int64) for c in ("ids", "tags"))
        lo, step = blocks.column("lo")[b].as_py(), blocks.column("step")[b].as_py()
        cells = np.frombuffer(blocks.column("cells")[b].as_py(), np.uint8).reshape(len(ids), n)
        base = (narrow @ cells.astype(kind).T).astype(np.float64)
        base *= step
        base += (lo * total)[:, None]
        # Doubles are exact for all but huge components; the margin covers those.
        margin = 1e-9 * size * (abs(lo) + step * (CELLS + 1))
        margin[margin < 0.25] = 0
        low = np.clip(base + ((step - 1) * minus - margin)[:, None], float(_LEAST), 2.0**63)
        up = np.clip(base + ((step - 1) * plus + margin)[:, None], float(_LEAST), 2.0**63)
        mine = np.searchsorted(np.sort(own), ids)
        for j in np.flatnonzero(np.sort(own)[np.minimum(mine, len(own) - 1)] == ids):
            rows = own == ids[j]
            low[rows, j] = up[rows, j] = -np.inf
        both = np.concatenate([certain, low], axis=1)
        certain = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        i, j = np.nonzero((up >= certain.min(axis=1)[:, None]) & (up > -np.inf))
        held.append((i, ids[j], vec_tags[j], low[i, j], up[i, j]))
    need = certain.min(axis=1)
    for i, ids, vec_tags, low, up in held:
        good = up >= need[i]
        i = i[good]
        yield own[i], tags[i], ids[good], vec_tags[good], low[good], up[good]


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of rows of whole numbers held as doubles; beyond 64 bits, the nearest 64-bit value."""
    room = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if room < 2.0**52:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([min(max(s, _LEAST), _MOST) for s in exact], dtype=np.int64)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        score = np.zeros(batch.num_rows, dtype=np.int64)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            q, x = (_matrix(batch.column(c).take(pa.array(at)), int(n)) for c in ("q", "v"))
            score[at] = _product(q, x)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "tag", "vec_id", "copies")), pa.array(score)], names=["query_id", "tag", "vec_id", "copies", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, group_bytes: int = GROUP_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows.

    ``vectors`` has vec_id and embedding; components are floor(scale * component). Queries
    are the rows where ``is_query`` holds; candidates are all rows with another vec_id and
    as many components. Ties go to the smaller vec_id. Rows with a null vec_id, a null
    vector, or a component null or not finite take no part. A query vec_id that occurs with
    several vectors is answered for each; repeated candidates count each. Scores beyond 64
    bits are held at the nearest 64-bit value. Vectors are named by two 64-bit hashes.
    Returns query_id, rank, vec_id, score and n_read, the exact vectors read for the query.
    """
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good)
    rows = rows.select("vec_id", F.size("embedding").alias("n"), F.transform("embedding", lambda c: c * F.lit(float(scale))).alias("v"), "asked")
    rows = rows.withColumns({"tag": F.xxhash64("v"), "tag2": F.xxhash64(F.lit(1), "v")})

    thin = rows.select("vec_id", "n", "v", "tag", "tag2").mapInArrow(_thinned(k), "vec_id long, n int, v array<double>, tag long, tag2 long")
    file = stored(thin.repartition("tag").sortWithinPartitions("tag", "tag2", "vec_id").mapInArrow(_approximated(k), _FILE), "cells")
    asked = stored(rows.filter("asked").select("vec_id", "n", "tag", "v").dropDuplicates(["vec_id", "tag"]), "queries")
    bytes_ = asked.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    groups = max(1, -(-bytes_ // group_bytes))
    n_blocks, bytes_ = file.agg(F.count("*"), F.sum(F.length("cells"))).first()
    shares = max(1, -(-(bytes_ or 0) // share_bytes), min(n_blocks, spark.sparkContext.defaultParallelism))

    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    grouped = asked.withColumn("g", F.pmod("tag", F.lit(groups).cast("long"))).groupBy("n", "g").applyInArrow(_packed, "n int, g long, qids binary, qtags binary, body binary")
    left = grouped.withColumn("s", each(shares))
    right = file.withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(shares).cast("long"))).withColumn("g", each(groups))
    found = left.groupBy("n", "g", "s").cogroup(right.groupBy("n", "g", "s")).applyInArrow(_bounded(k), _CANDIDATES)
    # Rows of one id and vector are one candidate that counts several times.
    found = stored(found.groupBy("query_id", "tag", "vec_id", "vec_tag", "lower", "upper").agg(F.count("*").alias("copies")), "bounds")

    query = ["query_id", "tag"]
    by_lower = Window.partitionBy(*query).orderBy(F.desc("lower"))
    need = found.select(*query, "lower").withColumn("nth", F.row_number().over(by_lower)).filter(F.col("nth") <= k).groupBy(*query).agg(F.when(F.count("*") == k, F.min("lower")).alias("need"))
    able = found.join(need, query).filter("need is null or upper >= need")
    by_upper = Window.partitionBy(*query).orderBy(F.desc("upper"), "vec_id", "vec_tag")
    able = stored(able.withColumn("nth", F.row_number().over(by_upper)), "able")

    def read(pairs: DataFrame) -> DataFrame:
        """Scores of (query, vector) pairs, from exact vectors."""
        wanted = pairs.select("vec_id", "vec_tag").distinct()
        exact = rows.select("vec_id", F.col("tag").alias("vec_tag"), "v").join(wanted, ["vec_id", "vec_tag"], "left_semi").dropDuplicates(["vec_id", "vec_tag"])
        asking = asked.select(F.col("vec_id").alias("query_id"), "tag", "n", F.col("v").alias("q"))
        joined = pairs.select(*query, "vec_id", "vec_tag", "copies").join(exact, ["vec_id", "vec_tag"]).join(asking, query)
        return joined.select(*query, "vec_id", "copies", "n", "q", "v").mapInArrow(_scored, "query_id long, tag long, vec_id long, copies long, score long")

    first = stored(read(able.filter(F.col("nth") <= FIRST * k)), "first")
    by_score = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    sure = first.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") == k).select(*query, F.col("score").alias("sure"))
    rest = able.filter(F.col("nth") > FIRST * k).join(sure, query, "left").filter("sure is null or upper >= sure")
    scored = stored(first.union(read(rest)), "scored")
    discard(file, found, able, first)

    reads = scored.groupBy(*query).agg(F.count("*").alias("n_read"))
    singles = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    ranked = singles.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.join(reads, query).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_read")
