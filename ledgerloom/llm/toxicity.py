"""Toxicity by multiple-instance learning.

Only documents have labels. A document is toxic if a sentence is: sentence scores are
combined by noisy-or, ``1 - prod(1 - p)``, and the sentence model is trained through that
from document labels. A sentence is scored by the n-grams (4 to 6 bytes, inside a word or
with the blank before it) that set toxic documents of the sample apart; one without any
scores 0, so length alone makes nothing toxic. Sentences end at ``. ! ?`` and line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import held_out, without
from .grams import LETTERS, PIECE, gram_ids, sample_ids, stream
from .words import slices

SIZES, BITS = range(4, 7), 20
#: Rows that the model is fitted on at most, features kept at most, rounds, and penalty.
SAMPLE, FEATURES, ROUNDS, PENALTY = 3000, 4000, 300, 1e-4
#: A sentence is reported from this score on.
OFFENDING = 0.5
_END = np.zeros(256, dtype=bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Model:
    weights: np.ndarray  # by feature id; 0 for features that the model doesn't use
    used: np.ndarray
    bias: float


def _sentences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sentence of every byte, numbered over all texts; an end belongs to what it ends."""
    new = np.zeros(len(data) + 1, dtype=bool)
    new[1:] = _END[data]
    new[offsets[offsets < len(data)]] = True
    return np.cumsum(new[: len(data)], dtype=np.int32) - 1


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, feature id) of every n-gram that lies in one word, or starts at the blank before it."""
    back = SIZES.stop  # how far a piece looks back for the blank before a word; farther ones bound no n-gram
    for a in range(0, len(data), PIECE):
        lo, hi = max(0, a - back), a + PIECE + SIZES.stop - 2
        letters = LETTERS[data[lo:hi]]
        at = np.arange(lo, lo + len(letters))
        last = np.maximum.accumulate(np.where(letters == 0x20, at, 0))
        some = offsets[np.searchsorted(offsets, lo, side="right") - 1 : np.searchsorted(offsets, lo + len(letters))]
        bound = np.maximum(last, np.repeat(some, np.diff(np.append(np.maximum(some, lo), lo + len(letters)))))
        for n, ids in gram_ids(letters, SIZES, BITS):
            start = at[: len(ids)]
            good = np.flatnonzero((bound[n - 1 :] <= start) & (start >= a) & (start < a + PIECE))
            yield start[good], ids[good]


def fit(texts: list[str], labels: list[int]) -> Model:
    labels = np.array(labels, dtype=np.int64)
    counts = np.zeros((2, 1 << BITS))
    for text, label in zip(texts, labels, strict=True):
        seen = [ids for _, ids in _features(*stream(pa.array([text], pa.string())))]
        if seen:
            counts[label, np.unique(np.concatenate(seen))] += 1
    totals = np.maximum(np.bincount(labels, minlength=2), 1)[:, None]
    rate = (counts + 0.5) / (totals + 1)
    gain = (rate[1] - rate[0]) * np.log(rate[1] / rate[0])
    good = (counts[1] >= 3) & (rate[1] > 4 * rate[0])
    chosen = np.flatnonzero(good)
    chosen = chosen[np.argsort(-gain[chosen], kind="stable")][:FEATURES]
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool), 0.0)
    model.used[chosen] = True
    if not len(chosen) or labels.min() == labels.max():
        model.used[:] = False
        return model
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    feature, instance, bag = [], [], []
    for doc, text in enumerate(texts):
        data, offsets = stream(pa.array([text], pa.string()))
        where = _sentences(data, offsets)
        found = [np.stack([where[at], place[ids]]) for at, ids in _features(data, offsets)]
        pairs = np.unique(np.concatenate([f[:, f[1] >= 0] for f in found], axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        own, at = np.unique(pairs[0], return_inverse=True)
        instance.append(at + sum(map(len, bag)))
        feature.append(pairs[1])
        bag.append(np.full(len(own), doc))
    feature, instance, bag = np.concatenate(feature), np.concatenate(instance), np.concatenate(bag)
    return _descend(model, chosen, feature, instance, bag, labels)


def _descend(model: Model, chosen: np.ndarray, feature: np.ndarray, instance: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> Model:
    """Adam on the log loss of noisy-or document scores."""
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    x = np.zeros(len(chosen) + 1)
    x[-1] = -2.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(x[-1] + np.bincount(instance, x[feature], minlength=len(bag)))))
        p = np.clip(p, 1e-7, 1 - 1e-7)
        clean = np.exp(np.bincount(bag, np.log1p(-p), minlength=len(labels)))
        # d loss / d logit of an instance: p for bags that are clean, -p * clean / (1 - clean) for toxic ones.
        toxic = -clean / np.maximum(1 - clean, 1e-7)
        slope = (weight * np.where(labels == 1, toxic, 1.0))[bag] * p
        grad = np.append(np.bincount(feature, slope[instance], minlength=len(chosen)), slope.sum()) + PENALTY * np.append(x[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights[chosen], model.bias = x[:-1], float(x[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out third, as many of either label."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "toxic").distinct()
    ids = sample_ids(known, "toxic", sample)
    if not ids:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool), 0.0)
    of = {}
    for r in known.filter(F.col("doc_id").isin(ids)).collect():  # two rows an id at most
        of[r.doc_id] = max(of.get(r.doc_id, 0), int(r.toxic))
    # An id that occurs with several texts has the first of them, so that the sample is the same in every run.
    found = docs.filter(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in found], [of[r.doc_id] for r in found])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = stream(part.column("text"))
                where = _sentences(data, offsets)
                at, ids = [], []
                for positions, features in _features(data, offsets):
                    hit = model.used[features]
                    at.append(positions[hit])
                    ids.append(features[hit])
                at, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, ids))
                pairs = np.unique(where[at].astype(np.int64) << BITS | ids)  # a feature counts once a sentence
                sentence, own = np.unique(pairs >> BITS, return_inverse=True)
                p = 1 / (1 + np.exp(-(model.bias + np.bincount(own, model.weights[pairs & ((1 << BITS) - 1)], minlength=len(sentence)))))
                # Keys of the array's own type: of another one, the whole array would be converted.
                begin, end = (np.searchsorted(where, sentence.astype(where.dtype), side=side) for side in ("left", "right"))
                text = np.searchsorted(offsets, begin, side="right") - 1
                score = 1 - np.exp(np.bincount(text, np.log1p(-np.clip(p, 0, 1 - 1e-12)), minlength=part.num_rows))
                spans: list = [[] for _ in range(part.num_rows)]
                bad = np.flatnonzero(p >= OFFENDING)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for k in bad:
                        a, b = int(begin[k]), int(end[k])
                        zero = points[offsets[text[k]]]
                        spans[text[k]].append({"start": int(points[a] - zero), "end": int(points[b] - zero), "score": float(p[k])})
                cols = [part.column(c) for c in part.schema.names]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.clip(score, 0, 1)), pa.array(spans, kind)], names=[*part.schema.names, "score", "offending"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, higher: toxic likelier) and offending, from text alone.

    offending lists the sentences that score OFFENDING or more as start, end (code points,
    end exclusive) and score. Null, empty and blank texts, and all texts under a model that
    learnt nothing, score 0. Whole texts are read; input columns with the names added are
    replaced, all others kept.
    """
    docs = without(docs, "score", "offending").withColumn("text", F.col("text").cast("string"))
    span = StructType().add("start", "long").add("end", "long").add("score", "double")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("offending", ArrayType(span))])
    return docs.mapInArrow(_scored(model), schema)
