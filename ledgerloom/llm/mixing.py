"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document of a source with target rate r is repeated k times, k drawn from a Poisson
distribution of mean r by inverting it at a number in [0, 1) that a hash of seed and
doc_id fixes. The draw needs nothing but the document and its source's rate, so it can be
repeated anywhere; copies are then shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without

#: Rates above this are drawn as the sum of several draws. Sources that are broadcast at most.
PART, BROADCAST = 32.0, 5000


def _unit(*parts) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... until the rest is below 2**-52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): target share times ``total`` documents over the source's documents.

    Shares follow ``weights``, sources not named there get none; without weights they
    follow the square roots of the sources' sizes. ``total`` is the number of documents
    that there are, unless given. A null source is a source.
    """
    sizes = stored(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        # The weights are an argument of the caller, so their number is bounded by it.
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("n"), F.sum("weight")).first()
    rows, weight = sums[0] or 0, sums[1] or 1.0
    return weighed.select("source", (F.col("weight") / F.lit(weight) * F.lit(float(rows if total is None else total)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 0) -> DataFrame:
    """Documents repeated to the sources' target rates and shuffled.

    Adds replica (from 1) and shuffle_key, a hash of seed, doc_id and replica; partitions
    hold a random part each and are sorted by the key. Rows with the same doc_id in a source
    are drawn alike; a null doc_id counts as empty. A source without weight goes. No
    documents give none. Columns with the names added are replaced, all others kept.
    """
    docs = without(docs, "replica", "shuffle_key", "mix_source", "mix_parts", "mix_sums", "mix_count")
    plan = rates(docs, weights, total)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART))).cast("int")
    plan = plan.select(F.col("source").alias("mix_source"), parts.alias("mix_parts"), F.col("rate"))
    plan = plan.select("mix_source", "mix_parts", _cumulative(F.col("rate") / F.col("mix_parts")).alias("mix_sums"))
    plan = stored(plan, "rates")
    # The plan has a row for each source: broadcast if counted to be few, else an equi-join that the runtime splits when skewed.
    plan = F.broadcast(plan) if plan.count() <= BROADCAST else plan
    drawn = docs.join(plan, docs.source.eqNullSafe(plan.mix_source))
    each = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda part: _unit(F.lit(seed), F.col("doc_id"), part))
    count = F.aggregate(each, F.lit(0), lambda a, u: a + F.size(F.filter("mix_sums", lambda c: c <= u)))
    counted = drawn.withColumn("mix_count", count).filter("mix_count > 0")
    copies = counted.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    key = F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("replica").cast("string")).cast("binary"))
    out = copies.select(*[docs[f"`{c}`"] for c in docs.columns], "replica", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
