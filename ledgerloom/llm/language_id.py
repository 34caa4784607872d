"""Language identification with blended-spectrum presence kernels.

A text's features are the n-grams (1 to 4 bytes of its letters) that occur in it, hashed
to BITS bits. The kernel of two texts is the share of features in common, scaled so that a
text has 1 with itself. Landmark texts give a Nyström map; one-versus-rest ridge
regression in that map gives a score for each language. As the scores of a batch are
``(presence @ landmarks.T) @ coefficients``, the last two factors are multiplied once,
when the model is fitted, and a batch is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out, without
from .grams import LETTERS, PIECE, gram_ids, owner, sample_ids, stream
from .words import slices

SIZES, BITS = range(1, 5), 14
#: Rows that the model is fitted on at most, landmarks among them, the ridge, and texts in a matrix product.
SAMPLE, LANDMARKS, RIDGE, BLOCK = 1200, 256, 1e-3, 256
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages), landmarks and coefficients multiplied


def presence(texts: pa.Array) -> np.ndarray:
    """(texts, features) of 0 and 1."""
    data, offsets = stream(texts)
    owners = owner(offsets)
    out = np.zeros((len(offsets) - 1, 1 << BITS), dtype=bool)
    flat = out.reshape(-1)
    for a in range(0, len(data), PIECE):
        b = a + PIECE + SIZES.stop - 2  # the n-grams that start in this piece end in the next one
        letters, text = LETTERS[data[a:b]], owners[a:b]
        base = text.astype(np.int64) << BITS
        for n, ids in gram_ids(letters, SIZES, BITS):
            whole = slice(None) if n == 1 else text[: len(ids)] == text[n - 1 :]
            flat[(base[: len(ids)] + ids)[whole]] = True
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    x = _scaled(np.concatenate([presence(pa.array([t], pa.string())) for t in texts]))
    y = np.array([[float(name == one) for one in languages] for name in labels])
    by = {one: [i for i, name in enumerate(labels) if name == one] for one in languages}
    each = max(1, LANDMARKS // len(languages))
    z = x[np.array([i for one in languages for i in by[one][:each]])]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = (x @ z.T).astype(np.float64) @ whiten
    beta = np.linalg.solve(mapped.T @ mapped + RIDGE * len(x) * np.eye(mapped.shape[1]), mapped.T @ y)
    return Model(languages, (z.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on text and non-null lang of at most ``sample`` rows outside the held-out third."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    ids = sample_ids(rows, "lang", sample)
    # An id that occurs with several languages or texts has the first of them, so that the sample is the same in every run.
    found = rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*").collect() if ids else []
    found.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in found], [r.lang for r in found])


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                for k in range(0, some.num_rows, BLOCK):
                    part = some.slice(k, BLOCK)
                    texts = part.column("text")
                    names, best = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                    if model.languages:
                        scores = _scaled(presence(texts)) @ model.weights
                        at = scores.argmax(axis=1)
                        ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
                        for i in range(part.num_rows):
                            if ascii_letter[i] or any(c.isalpha() for c in texts[i].as_py() or ""):
                                names[i], best[i] = model.languages[at[i]], min(1.0, max(0.0, float(scores[i, at[i]])))
                    cols = [part.column(c) for c in part.schema.names]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from text alone.

    lang_pred is ``und`` and score 0 where text is null, empty or has no letter, and
    everywhere if the model has no language. Whole texts are read; input columns with the
    names added are replaced, all others kept.
    """
    docs = without(docs, "lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_predicted(model), schema)
