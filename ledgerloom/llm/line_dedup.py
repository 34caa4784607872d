"""Dropping lines that many documents hold, by a sharded minimal perfect hash.

Distinct line hashes are counted with partial sums before the shuffle. Those that reach
the threshold are cut into shards by hash; each shard is a minimal perfect hash that
indexes an array of fingerprints and one of document counts. Documents probe these arrays
with their own line hashes: lines are never joined with lines, and texts aren't moved.

Hashes have 128 bits: 64 address the perfect hash, the other 64, of another seed (Spark
chains its arguments, so the constant comes first), also are the fingerprint, so a line outside the index is taken for one inside with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without
from .perfect_hash import Shard

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys in a shard, bytes of index that tasks may load whole, and probes in a task beyond that.
SHARD_KEYS, LOADED_BYTES, TASK_PROBES = 1 << 18, 32 << 20, 1 << 20


def _keys(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER))


def _hashes(keys: Column, least: int) -> Column:
    """A (h1, h2) for each line; null where the key is too short to count."""
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= least, pair(k)))


def frequent_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n) of keys found in ``min_docs`` rows at least; ``hashed`` has the column hashes."""
    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null")
    return each.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)


def build_index(frequent: DataFrame) -> DataFrame:
    """(shard, shards, body): one row a shard."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        body = Shard.build(h1, h2, rows["n"].to_numpy()).dump()
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "shards": [rows["shards"].iloc[0]], "body": [body]})

    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    keyed = frequent.withColumn("shards", F.lit(shards).cast("long")).withColumn("shard", F.pmod("h1", "shards"))
    return keyed.groupBy("shard", "shards").applyInPandas(build, "shard long, shards long, body binary")


def _probe(index: dict[int, Shard], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), dtype=np.int64)
    at = np.mod(h1, shards)
    for shard, held in index.items():
        which = np.flatnonzero(at == shard)
        if len(which):
            out[which] = held.counts(h1[which].view(np.uint64), h2[which].view(np.uint64))
    return out


def _flags_loaded(hashed: DataFrame, bodies: list, min_docs: int) -> DataFrame:
    """Adds drop (array of boolean) by an index of bounded size that every task loads."""
    shared = hashed.sparkSession.sparkContext.broadcast([(r.shard, r.shards, bytes(r.body)) for r in bodies])
    loaded: dict[int, Shard] = {}

    @F.arrow_udf("array<boolean>")
    def drop(hashes: pa.Array) -> pa.Array:
        if not loaded and shared.value:
            loaded.update({shard: Shard.load(body) for shard, _, body in shared.value})
        shards = shared.value[0][1] if shared.value else 1
        sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = hashes.flatten()
        here = flat.is_valid().to_numpy(zero_copy_only=False)
        h1, h2 = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        flags = here & (_probe(loaded, shards, h1, h2) >= min_docs)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flags))

    return hashed.withColumn("drop", drop("hashes"))


def _flags_routed(hashed: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """Adds drop when the index is too large for one task: hashes travel to their shards.

    A text is named by its own hash, so copies probe once. Shards are salted by text until
    a task has about TASK_PROBES probes, however frequent one line is.
    """
    named = hashed.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    probes = named.select("t1", "t2", F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null").select("t1", "t2", "h.h1", "h.h2").distinct()
    shards = index.select(F.max("shards")).first()[0] or 1
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(shards).cast("long")))
    most = probes.groupBy("shard").agg(F.count("*").alias("n")).select(F.max("n")).first()[0] or 0
    salts = max(1, -(-most // TASK_PROBES))
    probes = probes.withColumn("salt", F.pmod("t1", F.lit(salts).cast("long")))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["t1", "t2", "h1", "h2"]]
        held = Shard.load(bytes(right["body"].iloc[0]))
        counts = held.counts(*(left[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")))
        return left[counts >= min_docs][["t1", "t2", "h1", "h2"]]

    hits = probes.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, "t1 long, t2 long, h1 long, h2 long")
    of_text = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))
    joined = named.join(of_text, ["t1", "t2"], "left")
    flag = F.transform("hashes", lambda h: F.coalesce(h.isNotNull() & F.array_contains("hits", h), F.lit(False)))
    return joined.withColumn("drop", flag).drop("t1", "t2", "hits")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, loaded_bytes: int = LOADED_BYTES) -> DataFrame:
    """``docs`` with the lines that ``min_docs`` rows or more hold taken out of ``text``.

    Lines end at \\n. A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at
    both ends and with A-Z lower-cased; keys shorter than ``min_chars`` code points always
    stay. Counts are taken before anything is dropped, one for each row that holds the key,
    however often it does; rows that repeat a doc_id count as rows. A null or empty text is
    one empty line and comes back as the empty text. Adds n_lines (before dropping) and
    n_dropped; input columns of these names (in any case) are replaced, all others kept.
    """
    docs = without(docs, "n_lines", "n_dropped", "lines", "hashes", "drop", "t1", "t2", "hits")
    lined = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    lined = lined.withColumn("lines", F.split("text", "\n", -1))
    hashed = lined.withColumn("hashes", _hashes(_keys(F.col("lines")), min_chars))
    index = stored(build_index(stored(frequent_lines(hashed, min_docs), "lines")), "index")
    size = index.agg(F.sum(F.length("body"))).first()[0] or 0
    if size <= loaded_bytes:
        flagged = _flags_loaded(hashed, index.collect(), min_docs)
    else:
        flagged = _flags_routed(hashed, index, min_docs)
    kept = F.filter(F.arrays_zip("lines", "drop"), lambda x: ~x["drop"])
    out = flagged.withColumn("kept", F.transform(kept, lambda x: x["lines"]))
    out = out.withColumns({"n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("kept")).cast("long"), "text": F.array_join("kept", "\n")})
    return out.select(*docs.columns, "n_lines", "n_dropped")
