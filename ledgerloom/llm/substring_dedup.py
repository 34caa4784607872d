"""Removing repeated passages by anchors at the positions of a difference cover.

For two equal runs of ``window`` words, at whatever positions i and j, some shift below
the period puts both i + shift and j + shift on the cover, because the cover's differences
give every residue. So equal runs hold equal anchors (hashes of ``anchor`` words, with
``period - 1 + anchor <= window``) at the same place within the run.

1. Anchors at cover positions are dealt to buckets by hash; each document learns which of
   its anchors another document holds.
2. Such an anchor is extended to every run of ``window`` words around it. Their hashes are
   dealt out likewise; each document learns which runs start in a smaller doc_id too.
3. Words covered by such runs go.

Runs are compared by two hashes of 64 bits each, made from different hashes of their words
(see ``words``): two different runs are taken for equal with probability 2**-128, N of them
anywhere with probability below N**2 * 2**-129 (1e-12 for 1e13 runs). An answer names a run
of its own document by the first hash, so n runs of one document are mixed up with
probability below n**2 * 2**-65. Anchors have one hash; a wrong one costs work, not words.

Before each shuffle a task settles what it can among its own documents and sends every
hash once, so a passage that a third of all documents hold costs a row for each task's
batch. Buckets get more as the corpus grows; no task sees more than a bucket of hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import Words, slices, windows, words_of

#: A perfect difference set: every residue modulo the period is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Hashes that a task gathers before it sends them, and hashes meant for a bucket.
GATHER, BUCKET = 1 << 19, 1 << 20
_KNOWN = np.uint32(0xFFFFFFFF)


@dataclass
class Found:
    """Hashes with the second hash of each (or none has one) and the document it is from."""

    hash: np.ndarray
    check: np.ndarray | None
    doc: np.ndarray

    @staticmethod
    def joined(parts: list[Found]) -> Found:
        check = None if parts[0].check is None else np.concatenate([p.check for p in parts])
        return Found(np.concatenate([p.hash for p in parts]), check, np.concatenate([p.doc for p in parts]))

    def __getitem__(self, at: np.ndarray) -> Found:
        return Found(self.hash[at], None if self.check is None else self.check[at], self.doc[at])

    def ordered(self) -> np.ndarray:
        return np.lexsort((self.doc, self.hash) if self.check is None else (self.doc, self.check, self.hash))

    def differs(self) -> np.ndarray:
        """Whether each hash isn't that of the row before; the first does."""
        out = np.ones(len(self.hash), dtype=bool)
        out[1:] = self.hash[1:] != self.hash[:-1]
        if self.check is not None:
            out[1:] |= self.check[1:] != self.check[:-1]
        return out


def _pack(found: Found, known: np.ndarray) -> bytes:
    """Hashes with their documents, in the order of documents; known: no answer is wanted."""
    order = np.lexsort((found.hash, found.doc))
    table, at = np.unique(found.doc[order], return_inverse=True)
    at = np.where(known[order], _KNOWN, at.astype(np.uint32))
    check = b"" if found.check is None else found.check[order].tobytes()
    return struct.pack("<qqq", len(order), len(table), bool(check)) + table.tobytes() + found.hash[order].tobytes() + check + at.tobytes()


def _unpack(body: bytes) -> tuple[Found, np.ndarray]:
    n, m, checked = struct.unpack_from("<qqq", body)
    table, place = np.frombuffer(body, np.int64, m, 24), 24 + 8 * m
    hashes = np.frombuffer(body, np.uint64, n, place)
    check = np.frombuffer(body, np.uint64, n, place + 8 * n) if checked else None
    at = np.frombuffer(body, np.uint32, n, place + 8 * n * (1 + checked))
    known = at == _KNOWN
    return Found(hashes, check, table[np.where(known, 0, at)]), known


def _groups(found: Found) -> tuple[Found, np.ndarray]:
    """Distinct rows in order, and the group of each by hash."""
    found = found[found.ordered()]
    new = found.differs()
    new[1:] |= found.doc[1:] != found.doc[:-1]
    found = found[new]
    return found, np.cumsum(found.differs()) - 1


def _by_doc(found: Found) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(found.doc, kind="stable")
    hashes, docs = found.hash[order], found.doc[order]
    cuts = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(docs[a]), hashes[a:b].tobytes()


def _dealt(buckets: int, earlier: bool, hashes_of: Callable[[pa.RecordBatch], Iterator[Found]]):
    """Rows (bucket, doc_id, body): without doc_id hashes to settle, with doc_id hashes settled here."""

    def flush(parts: list[Found]) -> Iterator[pa.RecordBatch]:
        found, group = _groups(Found.joined(parts))
        first = np.concatenate([[True], group[1:] != group[:-1]])
        several = np.bincount(group) > 1
        rows = [(int(doc % buckets), doc, body) for doc, body in _by_doc(found[~first] if earlier else found[several[group]])]
        known = np.zeros(int(first.sum()), dtype=bool) if earlier else several
        found = found[first]
        at = ((found.hash >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        rows += [(int(at[a]), None, _pack(found[a:b], known[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        for k in range(0, len(rows), 256):
            part = list(zip(*rows[k : k + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], names=["bucket", "doc_id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for found in hashes_of(part):
                    if len(found.hash):
                        held.append(found)
                        size += len(found.hash)
                if size >= GATHER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _settled(earlier: bool):
    """One row (doc_id, hash) for each answer: rows grow with the answers, not with documents times buckets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows[rows["doc_id"].notna()]
        docs = [np.repeat(done["doc_id"].to_numpy().astype(np.int64), [len(b) // 8 for b in done["body"]])]
        hashes = [np.frombuffer(b"".join(done["body"]), np.uint64)]
        parts = [_unpack(b) for b in rows.loc[rows["doc_id"].isna(), "body"]]
        if parts:
            found, known = Found.joined([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = found.ordered()
            found, known = found[order], known[order]
            h, d, start = found.hash, found.doc, np.flatnonzero(found.differs())
            size = np.diff(np.append(start, len(h)))
            if earlier:
                answer = d > np.repeat(d[start], size)
            else:
                several = (np.maximum.reduceat(d, start) != d[start]) | np.logical_or.reduceat(known, start)
                answer = np.repeat(several, size) & ~known
            docs.append(d[answer])
            hashes.append(h[answer])
        return pd.DataFrame({"doc_id": np.concatenate(docs), "hash": np.concatenate(hashes).view(np.int64)})

    return run


def _answers(rows: DataFrame, buckets: int, earlier: bool, hashes_of) -> DataFrame:
    """(doc_id, hashes): the hashes of each document that another, or with ``earlier`` a smaller one, has too."""
    dealt = rows.mapInArrow(_dealt(buckets, earlier, hashes_of), "bucket long, doc_id long, body binary")
    settled = dealt.groupBy("bucket").applyInPandas(_settled(earlier), "doc_id long, hash long")
    return settled.groupBy("doc_id").agg(F.collect_list("hash").alias("hashes"))


def _each(part: pa.RecordBatch, check: bool = False) -> Iterator[tuple[int, int, Words, slice]]:
    """(row, doc_id, words of the whole part, those of the row)."""
    words = words_of(part.column("text"), check=check)
    for i, doc in enumerate(part.column("doc_id").to_pylist()):
        yield i, doc, words, slice(words.first[i], words.first[i + 1])


def _held(hashes: pa.Scalar) -> np.ndarray:
    return np.unique(hashes.values.to_numpy().view(np.uint64))


def _anchors(window: int):
    size, cover = window - PERIOD + 1, np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(part: pa.RecordBatch) -> Iterator[Found]:
        for _, doc, words, own in _each(part):
            if own.stop - own.start >= window:
                found = windows(words.hash[own], size, 3)
                found = found[cover[np.arange(len(found)) % PERIOD]]
                yield Found(found, None, np.full(len(found), doc, dtype=np.int64))

    return run


def _extended(window: int):
    size, cover = window - PERIOD + 1, np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(part: pa.RecordBatch) -> Iterator[Found]:
        for i, doc, words, own in _each(part, check=True):
            starts = own.stop - own.start - window + 1
            if starts > 0:
                found = windows(words.hash[own], size, 3)
                at = np.flatnonzero(cover[np.arange(len(found)) % PERIOD])
                at = at[np.isin(found[at], _held(part.column("hashes")[i]))]
                marks = np.zeros(starts + 1, dtype=np.int64)
                lo, hi = np.maximum(at + size - window, 0), np.minimum(at, starts - 1) + 1
                np.add.at(marks, lo[lo < hi], 1)
                np.add.at(marks, hi[lo < hi], -1)
                some = np.cumsum(marks[:-1]) > 0
                yield Found(windows(words.hash[own], window, 4)[some], windows(words.check[own], window, 5)[some], np.full(int(some.sum()), doc, dtype=np.int64))

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"))
            sums = [hashlib.sha256(words.text(np.arange(words.first[i], words.first[i + 1]))).hexdigest() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(sums, pa.string())], names=["doc_id", "n_words", "whole_sha256"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for i, doc, words, own in _each(part):
                    flagged = np.isin(windows(words.hash[own], window, 4), _held(part.column("hashes")[i]))
                    marks = np.zeros(own.stop - own.start + 1, dtype=np.int64)
                    marks[: len(flagged)] += flagged
                    marks[window : window + len(flagged)] -= flagged
                    gone = np.cumsum(marks[:-1]) > 0
                    at = np.arange(own.start, own.stop)
                    rows.append((doc, hashlib.sha256(words.text(at)).hexdigest(), int(gone.sum()), words.text(at[~gone]).decode()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["doc_id", "whole_sha256", "n_removed", "kept"])

    return run


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """Documents without the words of ``window``-word runs that also start in a smaller doc_id.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; a run lies in one document. Runs
    are judged on the input. Returns doc_id, n_words, n_removed, whole_sha256 (of all words
    joined by a space) and kept, the words left joined by a space, or null where nothing was
    removed (the text's own words). One row per input row. Null and blank texts have no
    words; documents below ``window`` words lose nothing. Rows that repeat a doc_id don't
    remove each other's words; a null doc_id neither loses nor removes any.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = _answers(named, max(least, -(-(size // 6 * len(COVER) // PERIOD) // BUCKET)), False, _anchors(window))
    candidates = stored(named.join(near, "doc_id"), "candidates")
    # Runs around repeated anchors can be as many as the words of the documents that hold them.
    size = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = _answers(candidates, max(least, -(-(size // 6) // BUCKET)), True, _extended(window))
    cut = candidates.drop("hashes").join(runs, "doc_id").mapInArrow(_cut(window), "doc_id long, whole_sha256 string, n_removed long, kept string")
    cut = cut.dropDuplicates(["doc_id", "whole_sha256"])
    whole = docs.mapInArrow(_whole, "doc_id long, n_words long, whole_sha256 string")
    out = whole.join(cut, ["doc_id", "whole_sha256"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "whole_sha256", "kept")
