"""Near-duplicate documents by circulant MinHash.

1. One scan makes, for every document, its set of word shingles, the set's identity and
   size, a signature (see ``minhash``), band keys and a byte sketch.
2. Documents with the same set are one class.
3. Members of a band bucket are compared with the bucket's centre. Pairs that the sketch
   doesn't rule out are confirmed on full shingle sets; links make components.
4. What is left are pairs of different components inside a bucket: members outside its
   largest component against all of it, and against each other. They are compared by
   sketch, block against block, each pair in the first band that it shares, so no task
   grows with a group, and rows grow with a group times what its centre didn't settle;
   those not ruled out are confirmed too.

A pair at the threshold is missed by every band with probability below 6e-6, and ruled
out by its sketch (512 bytes, least agreement 0.66 for a threshold of 0.75) with
probability below 2e-6. Sets are one class if two sums of 64-bit hashes over them agree,
made from different hashes of the words: wrongly with probability 2**-127. A shingle of one
document is taken for another one's with probability 2**-128, when links are confirmed; two
shingles of a document with n of them count as one with probability below n**2 * 2**-65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import discard, stored
from ..operators.components import connected_components
from .words import mix, shared_pairs, shingle_pairs, slices, words_of

#: Standard errors below the threshold at which a sketch rules a pair out; members in a block.
SLACK, BLOCK = 4.7, 256

#: Bits of a screen for each document that it is for, bits it has at most (16 MB), and bits of a page of it.
SCREEN_EACH, SCREEN_MOST, SCREEN_PAGE = 16, 1 << 27, 1 << 16


def _least_agreement(percent: int) -> int:
    s = percent / 100
    return int(minhash.COORDINATES * (s - SLACK * (s * (1 - s) / minhash.COORDINATES) ** 0.5))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), lower=True, check=True)
                ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.zeros(len(ids), dtype=np.int64)
                own = np.stack([mix(ids.view(np.uint64)), np.zeros(len(ids), np.uint64)])
                keys: list = [[]] * len(ids)
                bytes_of: list = [b""] * len(ids)
                full, found = [], []
                for d in range(len(ids)):
                    s, check = shingle_pairs(words, d, size)
                    if len(s):
                        n[d] = len(s)
                        own[0, d], own[1, d] = mix(s, 21).sum(dtype=np.uint64), mix(check, 22).sum(dtype=np.uint64) | np.uint64(1)
                        full.append(d)
                        found.append(minhash.signature(s))
                if full:
                    found = np.stack(found)
                    for d, k, b in zip(full, minhash.bands(found).view(np.int64), minhash.sketch(found), strict=True):
                        keys[d], bytes_of[d] = k, b.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(own[0].view(np.int64)), pa.array(own[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_of, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, minhash.COORDINATES) for c in ("sa", "sb"))
                keep = (a == b).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _linked(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "ta"):
                for part in slices(some, "tb"):
                    a, b = (words_of(part.column(c), lower=True, check=True) for c in ("ta", "tb"))
                    keep = np.zeros(part.num_rows, dtype=bool)
                    for i in range(part.num_rows):
                        x, y = (shingle_pairs(w, i, size) for w in (a, b))
                        both = shared_pairs(x, y)
                        keep[i] = 100 * both >= percent * (len(x[0]) + len(y[0]) - both) and len(x[0]) > 0
                    yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _across(percent: int, least: int):
    """Pairs of different components in sorted groups (key, i, j), each in the first band it shares."""

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        block, comp, n, ids = (rows.column(c).to_numpy() for c in ("block", "component", "n_shingles", "node"))
        i, j, band = (rows.column(c)[0].as_py() for c in ("i", "j", "band"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[(comp[ys] != comp[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            ys = ys[(keys[ys, :band] != keys[x, :band]).all(axis=1)] if band else ys
            ys = ys[(sketch[ys] == sketch[x]).sum(axis=1) >= least]
            found += [(ids[x], ids[y]) for y in ys]
        if found:
            at = np.sort(np.array(found, dtype=np.int64), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            named = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in named], axis=0)) + 1
            at = [0, *cuts.tolist()]
            for a, b in zip(at, at[1:], strict=False):
                if (out := compare(rows.slice(a, b - a))) is not None:
                    yield out
            rest = rows.slice(at[-1])
        if rest is not None and rest.num_rows and (out := compare(rest)) is not None:
            yield out

    return run


def _screen(keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A filter that passes all rows with a (doc_id, text_hash) of ``keys`` and, by chance, few others.

    Each task tests rows against a bitmap, so what no pair needs isn't shuffled to the join
    that decides. One of SCREEN_MOST bits passes more of them, and still all that it has to.
    """
    bits, wanted = SCREEN_PAGE, SCREEN_EACH * keys.count()
    while bits < min(wanted, SCREEN_MOST):
        bits *= 2
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits).cast("long"))

    def pack(rows: pa.Table) -> pa.Table:
        on = np.zeros(SCREEN_PAGE, dtype=np.uint8)
        on[rows.column("slot").to_numpy() % SCREEN_PAGE] = 1
        return pa.table({"page": rows.column("page").slice(0, 1), "body": pa.array([np.packbits(on).tobytes()], pa.binary())})

    slots = keys.select(slot.alias("slot")).distinct().withColumn("page", F.floor(F.col("slot") / SCREEN_PAGE))
    pages = {r.page: bytes(r.body) for r in slots.groupBy("page").applyInArrow(pack, "page long, body binary").collect()}
    shared = keys.sparkSession.sparkContext.broadcast(pages)
    held: list[np.ndarray] = []

    @F.arrow_udf("boolean")
    def may(slots: pa.Array) -> pa.Array:
        if not held:
            none = bytes(SCREEN_PAGE // 8)
            held.append(np.frombuffer(b"".join(shared.value.get(p, none) for p in range(bits // SCREEN_PAGE)), np.uint8))
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((held[0][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return lambda rows: rows.filter(may(slot))


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, group) of every row; group is null without shingles or id.

    Nodes of the graph are classes, not ids, so rows that share a doc_id stay apart. What
    is joined with a hot key is written before, so that such joins can be split.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marks = stored(docs.mapInArrow(_signatures(size), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"), "signatures")
    some = marks.filter("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("rep_hash"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "sets")  # numbers that hold once they are written
    member = some.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "text_hash", "n_shingles", "rep", "node")
    member = stored(member, "classes")
    first = classes.select("node", F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash"))

    own = ["doc_id", "text_hash"]
    held = stored(some.select(*own, "bands").join(first, own).dropDuplicates(own).select("node", "doc_id", F.posexplode("bands").alias("band", "key")), "bands")
    # The least doc_id: an original tends to come before its copies, and is nearer to each of them than they are to each other.
    centres = stored(held.groupBy("key", "band").agg(F.min_by("node", "doc_id").alias("centre"), F.count("*").alias("members")).filter("members > 1"), "centres")
    buckets = stored(held.join(centres, ["key", "band"]).select("key", "band", "node", "centre"), "buckets")
    inside = stored(buckets.select("node").distinct().join(first, "node"), "inside")
    screened = _screen(inside.select(*own))
    cards = stored(screened(some.select(*own, "n_shingles", "bands", "sketch")).join(inside, own).dropDuplicates(own).drop(*own), "cards")
    texts = stored(screened(docs.filter("doc_id is not null")).join(inside, own).dropDuplicates(own).select("node", "text"), "candidates")
    least = _least_agreement(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_linked(size, percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))

    a, b = (cards.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    spokes = buckets.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    spokes = stored(spokes.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(_alike(least), "a long, b long"), "spokes")
    links = stored(confirmed(spokes), "links")
    known = stored(connected_components(links), "components")

    placed = buckets.join(known, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    parts = placed.groupBy("key", "band", "component").agg(F.count("*").alias("n"))
    unsettled = parts.groupBy("key", "band").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("large"), (F.sum("n") - F.max("n")).alias("rest")).filter("rest > 0")
    unsettled = stored(unsettled.select("key", "band", "main", F.ceil(F.col("large") / BLOCK).alias("p"), F.ceil(F.col("rest") / BLOCK).alias("q")), "unsettled")
    # Blocks 0 to p - 1 hold the largest component, p to p + q - 1 the rest; only pairs with a block of the rest are made.
    of_main = F.col("component") == F.col("main")
    crowd = placed.join(unsettled, ["key", "band"]).withColumn("block", F.when(of_main, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))))
    crowd = crowd.select("key", "band", "node", "component", "block", F.explode(F.sequence(F.when(of_main, F.col("p")).otherwise(F.lit(0)).cast("long"), F.col("p") + F.col("q") - 1)).alias("other"))
    crowd = crowd.select("key", "band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    crowd = crowd.join(cards, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = crowd.select("key", "band", "i", "j", "block", "node", "component", "n_shingles", "bands", "sketch").mapInArrow(_across(percent, least), "a long, b long").distinct()
    more = stored(confirmed(pairs), "links")
    found = stored(connected_components(links.union(more)).join(classes.select("node", "rep"), "node"), "components")
    labels = stored(found.groupBy("component").agg(F.min("rep").alias("label")), "labels")
    final = stored(found.join(labels, "component").select("node", "component", "label"), "final")
    discard(classes, held, centres, buckets, inside, cards, texts, spokes, links, known, placed, unsettled, more, found, labels)

    judged = member.join(final, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "rep").alias("component_id"), F.coalesce("component", "node").alias("group"))
    alone = marks.filter("doc_id is null or n_shingles = 0")
    return judged.union(alone.select("doc_id", "text_hash", "n_shingles", "doc_id", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Component of near-duplicates of every document.

    Texts are lower-cased (A-Z) and cut into words; a document's set holds its distinct
    ``size``-word shingles, or its whole sequence when it has fewer words. Documents with
    ``100 * intersection >= percent * union`` are linked.

    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept
    (doc_id = component_id), one row per input row. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat a doc_id are judged each by its
    own text. A null doc_id is linked with nothing and kept. Other columns of ``docs``
    aren't read.
    """
    out = _judged(docs, size, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least doc_id, of equals any one.

    Rows are judged, not ids: of rows that share a doc_id, those with texts of their own
    stay. Rows without words or doc_id stay.
    """
    key = "_near_text_hash"
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    judged = _judged(docs, size, percent).filter("group is not null")
    best = judged.groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias(key))
    best = stored(best.select("doc_id", key).distinct(), "stay")
    repeated = stored(judged.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.col("text_hash").alias(key)), "repeated")
    # The class [\x20\x09-\x0D] written the other way round: a character outside it makes a word.
    words = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = rows.filter(words).join(best, ["doc_id", key], "left_semi")
    once = chosen.join(repeated, ["doc_id", key], "left_anti")
    one_of_many = chosen.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return rows.filter(~words).unionByName(once).unionByName(one_of_many).select(*[F.col(f"`{c}`") for c in docs.columns])
