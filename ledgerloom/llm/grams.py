"""Byte n-grams of the letters of texts, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ASCII letters in lower case and every byte of other characters; all else is a blank.
LETTERS = np.full(256, 0x20, dtype=np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose n-grams are made at a time, which bounds the memory that a long text takes.
PIECE = 1 << 19


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each text begins and the last ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text of every byte."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def gram_ids(letters: np.ndarray, sizes: range, bits: int):
    """(n, id of the n-gram at each byte) for each n; the last n - 1 bytes start none."""
    packed = np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, sizes.stop):
        if len(letters) < n:
            return
        packed = (packed[: len(letters) - n + 1] << np.uint64(8)) | letters[n - 1 :]
        if n in sizes:
            yield n, ((packed + (np.uint64(n) << np.uint64(56))) * _ODD >> np.uint64(64 - bits)).astype(np.int64)


def sample_ids(rows: DataFrame, label: str, total: int) -> list[int]:
    """Ids of at most ``total`` rows, as many of each label, in the order of a hash of the id.

    Rows are counted by label first, and of a frequent label only those with a hash in the
    lowest share that holds enough of them are ranked, so a task ranks a few times
    ``total`` rows, however many there are of a label. With fewer rows than asked for, all are taken.
    """
    counts = [r for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(total).collect()]
    if not counts:
        return []
    each = max(1, total // len(counts))
    # Twice as many as wanted, and 50 more: fewer than wanted are left with probability below 1e-9.
    lowest = rows.sparkSession.createDataFrame([(r[label], min(1.0, (2 * each + 50) / r.n)) for r in counts], f"{label} {dict(rows.dtypes)[label]}, share double")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.select("doc_id", label).join(F.broadcast(lowest), label).filter(unit < F.col("share"))  # ``total`` rows at most
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = some.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= each)
    return [r.doc_id for r in ranked.select("doc_id").orderBy("doc_id").limit(total).collect()]
