"""Finding benchmark items in documents by SimHash of item-sized windows.

A window of as many words as an item has gets a BITS-bit SimHash of its word shingles. A
shingle that occurs c times counts as the c features (shingle, 1) to (shingle, c), so the
plain similarity of two feature sets is the weighted similarity of the shingles, and no
repeated shingle outweighs the others. At similarity t two sets have a cosine of 2t / (1 + t)
at least, whatever was changed; at 0.75 each bit of two fingerprints differs with
probability below 0.173, so 45 of 256 on average, standard deviation 6.1. RADIUS is 5.5
deviations beyond: a window at the threshold is missed with probability below 2e-7, a
more similar one with less.

Fingerprints are cut into blocks; two of them within RADIUS bits agree up to RADIUS // blocks
bits in one block at least, so looking up every block to that distance finds all of them.
The weighted similarity of each pair found, sum of least weights over sum of greatest,
decides. A window with too few shingles of any item of its size to reach the threshold isn't
fingerprinted; that loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .words import mix, slices, windows, words_of

BITS, RADIUS, BLOCK_BITS = 256, 78, 64
WITHIN = RADIUS // (BITS // BLOCK_BITS)
#: Bytes of items that a pass holds (more items take more passes), windows handled at a time, and features signed at a time.
PASS_BYTES, WINDOWS, SIGNED = 32 << 20, 1 << 10, 1 << 12


def _signs(features: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1."""
    raw = np.stack([mix(features, 31 + k) for k in range(BITS // 64)], axis=1)
    return 2 * np.unpackbits(raw.view(np.uint8), axis=1, bitorder="little").astype(np.int8) - 1


def _sums(features: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(features), SIGNED):
        total += _signs(features[k : k + SIGNED]).sum(axis=0, dtype=np.int64)
    return total


def _features(shingles: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(shingles + mix(nth.astype(np.uint64), 41))


def _blocks(sums: np.ndarray) -> np.ndarray:
    """(n, blocks) of 64-bit pieces of the fingerprints whose bit sums are given."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


def ranks(shingles: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place how often its shingle occurs in the ``span`` places that end there, and in those that begin there."""
    n = len(shingles)
    _, group = np.unique(shingles, return_inverse=True)
    key = group.astype(np.int64) * (n + span) + np.arange(n)
    held = np.sort(key)
    at = np.searchsorted(held, key)
    back = at - np.searchsorted(held, np.maximum(key - span + 1, group.astype(np.int64) * (n + span))) + 1
    ahead = np.searchsorted(held, np.minimum(key + span, (group.astype(np.int64) + 1) * (n + span))) - at
    return back, ahead


class BlockIndex:
    """Fingerprints of items of one size, looked up by blocks."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = fingerprints
        self.tables = [np.unique(fingerprints[:, b], return_inverse=True) for b in range(fingerprints.shape[1])]

    def near(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``some``, member) of every pair within RADIUS."""
        left, right = [], []
        room = max(1, (1 << 18) // max(1, len(self.fingerprints)))
        for k in range(0, len(some), room):
            part = some[k : k + room]
            hit = np.zeros((len(part), len(self.fingerprints)), dtype=bool)
            for b, (values, of) in enumerate(self.tables):
                hit |= (np.bitwise_count(part[:, b, None] ^ values) <= WITHIN)[:, of]
            x, y = np.nonzero(hit)
            good = np.bitwise_count(part[x] ^ self.fingerprints[y]).sum(axis=1, dtype=np.int64) <= RADIUS
            left.append(x[good] + k)
            right.append(y[good])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Items:
    """Items of one pass. ``at[(size, shingle size)]`` indexes the items with that many words."""

    ids: list[int]
    weights: list[tuple[np.ndarray, np.ndarray]]  # shingles of each item and how often it has them
    length: np.ndarray
    at: dict[tuple[int, int], tuple[np.ndarray, BlockIndex]]
    lookup: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by shingle size: sorted shingles, the sizes of their items, where these begin


def items_of(ids: list[int], texts: list[str], size: int) -> Items:
    words = words_of(pa.array(texts, pa.string()), lower=True)
    length = np.diff(words.first)
    keep = np.flatnonzero(length > 0)
    weights, sums, pairs, by = [], [], {}, {}
    for place, i in enumerate(keep):
        n = int(length[i])
        k = min(size, n)
        shingles = windows(words.hash[words.first[i] : words.first[i + 1]], k)
        weights.append(np.unique(shingles, return_counts=True))
        sums.append(_sums(_features(shingles, ranks(shingles, len(shingles))[0])))
        pairs.setdefault(k, []).append((weights[-1][0], np.full(len(weights[-1][0]), n)))
        by.setdefault((n, k), []).append(place)
    fingerprints = _blocks(np.array(sums)) if len(keep) else np.empty((0, BITS // BLOCK_BITS), np.uint64)
    at = {key: (np.array(places), BlockIndex(fingerprints[places])) for key, places in by.items()}
    lookup = {}
    for k, found in pairs.items():
        both = np.unique(np.concatenate([np.stack([s, n.astype(np.uint64)]) for s, n in found], axis=1), axis=1)
        values, first = np.unique(both[0], return_index=True)
        lookup[k] = (values, both[1].astype(np.int64), np.append(first, both.shape[1]))
    return Items([ids[i] for i in keep], weights, length[keep], at, lookup)


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive numbers, WINDOWS at most."""
    cuts = [0, *(np.flatnonzero(np.diff(starts) > 1) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for lo in range(int(starts[a]), int(starts[b - 1]) + 1, WINDOWS):
            yield lo, min(lo + WINDOWS, int(starts[b - 1]) + 1)


def _overlaps(shingles: np.ndarray, back: np.ndarray, ahead: np.ndarray, span: int, n: int, item: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of least weights of an item and each of the ``n`` windows of ``span`` shingles.

    What enters a window as its r-th counts if the item has r of it, and so does what leaves.
    """
    at = np.minimum(np.searchsorted(item[0], shingles), len(item[0]) - 1)
    have = np.where(item[0][at] == shingles, item[1][at], 0)
    gain, loss = (back <= have).astype(np.int64), (ahead <= have).astype(np.int64)
    return gain[:span].sum() + np.concatenate([[0], np.cumsum(gain[span : span + n - 1] - loss[: n - 1])])


def _matches(hashes: np.ndarray, hits: dict[int, np.ndarray], items: Items, threshold: float) -> list[dict]:
    """Best window of a document for each item that it matches; hits: places of item shingles, by shingle size."""
    best: dict[int, tuple[float, int]] = {}
    for k, where in hits.items():
        values, sizes, first = items.lookup[k]
        shingles = windows(hashes, k)
        at = np.searchsorted(values, shingles[where])
        for n in np.unique(np.concatenate([sizes[first[v] : first[v + 1]] for v in np.unique(at)])).tolist():
            wanted = n - k + 1  # shingles of an item
            span = min(wanted, len(shingles))  # shingles of a window
            need = threshold * (span + wanted) / (1 + threshold) - 1e-9
            if len(where) < need:
                continue
            held = np.zeros(len(shingles) + 1, dtype=np.int32)
            held[where + 1] = 1
            np.cumsum(held, out=held)
            starts = np.flatnonzero(held[span:] - held[: len(held) - span] >= need)
            del held
            members, index = items.at[n, k]
            for lo, hi in _runs(starts) if len(starts) else ():
                part = shingles[lo : hi - 1 + span]
                back, ahead = ranks(part, span)
                moves = _signs(_features(part[span:], back[span:])).astype(np.int32) - _signs(_features(part[: hi - lo - 1], ahead[: hi - lo - 1]))
                whole = _sums(_features(part[:span], back[:span])).astype(np.int32)
                prints = _blocks(np.concatenate([whole[None], whole + np.cumsum(moves, axis=0, dtype=np.int32)]))
                window, member = index.near(prints)
                for m in np.unique(member).tolist():
                    item = int(members[m])
                    near = window[member == m]
                    both = _overlaps(part, back, ahead, span, hi - lo, items.weights[item])[near]
                    similarity = both / (span + wanted - both)
                    top = int(similarity.argmax())
                    if similarity[top] >= threshold and (item not in best or similarity[top] > best[item][0]):
                        best[item] = (float(similarity[top]), lo + int(near[top]))
    return [{"item_id": items.ids[i], "start": s, "similarity": sim} for i, (sim, s) in best.items()]


def _one_each(found: list[dict]) -> list[dict]:
    """The most similar of the hits of each item_id, the first of equals, in the order of ids."""
    best: dict[int, dict] = {}
    for hit in sorted(found, key=lambda h: (-h["similarity"], h["start"])):
        best.setdefault(hit["item_id"], hit)
    return [best[i] for i in sorted(best)]


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("similarity", pa.float64())]))


def _found(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for k, (values, _, _) in items.lookup.items():
            seen[k] = np.zeros(1 << 20, dtype=bool)
            seen[k][(values >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), lower=True)
                hits: dict[int, dict[int, np.ndarray]] = {}
                for k, (values, _, _) in items.lookup.items():
                    shingles = windows(words.hash, k)
                    some = np.flatnonzero(seen[k][(shingles >> np.uint64(44)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(values, shingles[some]), len(values) - 1)
                    some = some[values[at] == shingles[some]]
                    del shingles
                    doc = np.searchsorted(words.first, some, side="right") - 1
                    inside = some + k <= words.first[doc + 1]
                    some, doc = some[inside], doc[inside]
                    cuts = np.searchsorted(doc, np.unique(doc))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=False):
                        hits.setdefault(int(doc[a]), {})[k] = some[a:b] - words.first[doc[a]]
                rows = part.column("hits").to_pylist()
                for d, of in hits.items():
                    rows[d] = _one_each((rows[d] or []) + _matches(words.hash[words.first[d] : words.first[d + 1]], of, items, threshold))
                cols = [pa.array(rows, HITS) if c == "hits" else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.75, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with hits: the items (item_id) that a window of the text matches, as an array.

    Texts are lower-cased (A-Z) and cut into words. An item matches where a window of its
    number of words (the whole document, if that is shorter) has a weighted similarity of
    ``threshold`` (0.75 or more) over ``size``-word shingles; start is the first word of the best
    window, the first of equals. Items below ``size`` words count as one shingle; items null
    or without words match nothing, nor do null and empty texts: hits is empty then. Rows of
    ``benchmark`` that repeat an item_id are one item with several texts, the best of which
    counts. Every input row comes back once, with its columns, but for one called hits.
    Texts aren't moved. A document takes memory for its words, not for words times bits.
    """
    if threshold < 0.75:
        raise ValueError("the radius is made for a similarity of 0.75 or more")
    docs = without(docs, "hits").withColumn("text", F.col("text").cast("string"))
    out = docs.withColumn("hits", F.array().cast("array<struct<item_id: bigint, start: bigint, similarity: double>>"))
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    bytes_ = known.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = -(-bytes_ // pass_bytes)
    for k in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).distinct().collect()
        rows.sort()
        out = out.mapInArrow(_found(items_of([r.item_id for r in rows], [r.text for r in rows], size), threshold), out.schema)
    return out
