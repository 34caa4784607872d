"""Attribution tags: counts, best tags, digests, quality.

A tag has tag_id, network, identifier, label, actor, confidence (level 0 to 100),
is_cluster_definer, concepts (array), creator, source, acl_group and lastmod; a mapping row
has network, address, cluster_id and cluster_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import THRESHOLD, normalized, similarity, trigrams
from ..plans.stage import cut

#: Words that say nothing about a label, and concepts that count more or less than 1.
COMMON_WORDS = ("to", "in", "the", "by", "of", "at", "", "vault")
CONCEPT_WEIGHTS = {"defi": 0.5, "exchange": 1.1, "dark_web": 0.1, "unknown": 0.1}


def _mapped(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    return tags.join(mapping.withColumnRenamed("address", "identifier"), ["network", "identifier"])


def statistics(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """By network: tags, labels, tagged identifiers, and the addresses of all mapped clusters."""
    explicit = tags.groupBy("network").agg(F.count("*").alias("nr_tags"), F.count_distinct("label").alias("nr_labels"), F.count_distinct("identifier").alias("nr_identifiers_explicit"))
    sizes = mapping.groupBy("network", "cluster_id").agg(F.max("cluster_size").alias("n"))
    implicit = sizes.groupBy("network").agg(F.sum("n").alias("i"))
    return explicit.join(implicit, "network", "left").withColumn("nr_identifiers_implicit", F.coalesce("i", "nr_identifiers_explicit")).drop("i")


def count_by_cluster(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    return _mapped(tags, mapping).groupBy("network", "cluster_id", "acl_group").agg(F.count("*").alias("count"))


def cluster_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """(network, cluster_id, tag_id): tags that define their cluster, and for clusters of one address its other tags."""
    defines = F.coalesce("is_cluster_definer", F.lit(False))
    rows = _mapped(tags, mapping)
    return rows.filter(defines | (F.col("cluster_size") == 1)).select("network", "cluster_id", "tag_id").distinct()


def best_cluster_tag(tags: DataFrame, mapping: DataFrame, groups: list[str]) -> DataFrame:
    """For each cluster the visible tag of highest confidence; of equals the least tag_id."""
    visible = tags.filter(F.col("acl_group").isin(groups)).select("network", "tag_id", "label", "confidence")
    rows = cluster_tags(tags, mapping).join(visible, ["network", "tag_id"])
    best = F.max_by(F.struct("tag_id", "label", "confidence"), F.struct("confidence", -F.col("tag_id")))
    return rows.groupBy("network", "cluster_id").agg(best.alias("b")).select("network", "cluster_id", "b.*")


def of_subjects(tags: DataFrame, identifiers: list[str], groups: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """Visible tags of some identifiers, the most confident first."""
    rows = tags.filter(F.col("identifier").isin(identifiers) & F.col("acl_group").isin(groups))
    return rows.orderBy(F.desc("confidence"), "tag_id").offset(offset).limit(limit)


def clusters_with_concept(tags: DataFrame, mapping: DataFrame, concept: str) -> DataFrame:
    having = tags.filter(F.array_contains("concepts", concept)).select("tag_id")
    return cluster_tags(tags, mapping).join(having, "tag_id", "left_semi").select("network", "cluster_id").distinct()


def composition(tags: DataFrame, *by: str) -> DataFrame:
    return tags.groupBy(*by).agg(F.count_distinct("label").alias("labels"), F.count("*").alias("tags"))


def actor_collisions(tags: DataFrame) -> DataFrame:
    """Identifiers that are said to belong to several actors."""
    found = tags.filter("actor is not null").groupBy("network", "identifier").agg(F.array_sort(F.collect_set("actor")).alias("actors"))
    return found.filter(F.size("actors") > 1)


def labels_without_actor(tags: DataFrame, limit: int) -> DataFrame:
    return tags.filter("actor is null").groupBy("label").agg(F.count("*").alias("tags")).orderBy(F.desc("tags"), "label").limit(limit)


def duplicates(tags: DataFrame, keys: tuple = ("network", "identifier", "label", "source")) -> DataFrame:
    """Tags that repeat another but for case and white space; the one of the greatest id isn't among them."""
    norm = [F.lower(F.trim(F.coalesce(F.col(k), F.lit("")))) for k in keys]
    latest = Window.partitionBy(*norm).orderBy(F.desc("tag_id"))
    return tags.withColumn("_nth", F.row_number().over(latest)).filter("_nth > 1").drop("_nth")


def first_per_network(mapping: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest clusters of each network."""
    order = Window.partitionBy("network").orderBy(F.desc("cluster_size"), "cluster_id")
    each = mapping.select("network", "cluster_id", "cluster_size").distinct()
    return each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def staleness(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Share of stored mappings whose cluster has changed, by network and over all."""
    joined = stored.join(now.select("network", "address", F.col("cluster_id").alias("now_id")), ["network", "address"], "left")
    moved = F.when(F.col("cluster_id").eqNullSafe(F.col("now_id")), 0).otherwise(1)
    out = joined.rollup("network").agg(F.count("*").alias("rows"), F.sum(moved).alias("moved"), F.grouping("network").alias("all"))
    return out.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("network")).alias("network"), "rows", "moved", (F.col("moved") / F.col("rows")).alias("rate"))


def latest_mapping(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Both tables with one row for each (network, address): the one of the greatest ``version``."""
    rows = old.unionByName(new)
    others = [c for c in rows.columns if c not in ("network", "address")]
    best = rows.groupBy("network", "address").agg(F.max_by(F.struct(*others), F.col(version)).alias("_r"))
    return best.select("network", "address", "_r.*")


def fuzzy(table: DataFrame, column: str, expression: str, limit: int) -> DataFrame:
    """Values similar to an expression, the most similar first."""
    score = similarity(F.col(column), F.lit(expression))
    return table.select(column).distinct().withColumn("similarity", score).filter(F.col("similarity") >= THRESHOLD).orderBy(F.desc("similarity"), column).limit(limit)


def similar_labels(labels: DataFrame) -> DataFrame:
    """(a, b, s): all pairs a < b of distinct labels that share a trigram, with their similarity; that of other pairs is 0."""
    sets = labels.select("label").distinct().withColumn("t", trigrams(F.col("label")))
    grams = sets.select("label", F.size("t").alias("n"), F.explode("t").alias("gram"))
    a, b = (grams.select("gram", F.col("label").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    shared = a.join(b, "gram").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("both"))
    return shared.select("a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("s"))


def quality(tags: DataFrame) -> DataFrame:
    """Agreement of the labels of each identifier that has several.

    All pairs of its tags are sorted by label similarity into four bins, up to 0.25, 0.5,
    0.75 and above, weighed 0.25 to 1; quality is 1 less the mean weight. Pairs are counted
    between distinct labels and multiplied by how often these occur, so that many tags with
    the same few labels cost no more than the labels.
    """
    several = tags.groupBy("network", "identifier").agg(F.count("label").alias("n_tags"), F.count_distinct("label").alias("n_dif_tags")).filter("n_dif_tags > 1")
    labels = tags.filter("label is not null").groupBy("network", "identifier", "label").agg(F.count("*").alias("n")).withColumn("t", trigrams(F.col("label")))
    a, b = (labels.select("network", "identifier", *[F.col(c).alias(f"{c}{s}") for c in ("label", "n", "t")]) for s in "ab")
    pairs = several.select("network", "identifier").join(a, ["network", "identifier"]).join(b, ["network", "identifier"]).filter("labela <= labelb")
    both = F.size(F.array_intersect("ta", "tb"))
    sim = F.when(F.col("labela") == F.col("labelb"), 1.0).otherwise(F.coalesce(F.try_divide(both, F.size("ta") + F.size("tb") - both), F.lit(0.0)))
    times = F.when(F.col("labela") == F.col("labelb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("long")
    pairs = pairs.select("network", "identifier", sim.alias("sim"), times.alias("times"))
    bins = [F.col("sim") <= 0.25, (F.col("sim") > 0.25) & (F.col("sim") <= 0.5), (F.col("sim") > 0.5) & (F.col("sim") <= 0.75), F.col("sim") > 0.75]
    counts = pairs.groupBy("network", "identifier").agg(*[F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0)).alias(f"q{i + 1}") for i, c in enumerate(bins)])
    out = several.join(counts, ["network", "identifier"]).withColumn("total_pairs", F.col("q1") + F.col("q2") + F.col("q3") + F.col("q4"))
    weighed = F.col("q1") * 0.25 + F.col("q2") * 0.5 + F.col("q3") * 0.75 + F.col("q4") * 1.0
    return out.withColumn("quality", 1 - weighed / F.col("total_pairs"))


def low_quality_labels(tags: DataFrame, measured: DataFrame, threshold: float) -> DataFrame:
    low = measured.filter(F.col("quality") <= threshold).select("network", "identifier", "quality")
    return tags.join(low, ["network", "identifier"]).groupBy("network", "identifier", "quality").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def _weight(confidence: Column, exponent: float) -> Column:
    return F.pow(F.when(F.coalesce(confidence, F.lit(0)) == 0, 0.1).otherwise(confidence.cast("double")), F.lit(exponent))


def digest(tags: DataFrame, key: str, exponent: float = 2.0) -> DataFrame:
    """One row for each ``key``: number of tags, best actor, best label, broad concept.

    Labels, actors and concepts are ranked by confidence to the power ``exponent``, summed.
    The best label is the best one of the best actor, or of all if no tag has an actor;
    the broad concept is exchange if that ranks first, else entity. Ties go to the name
    that is first in order.
    """
    rows = tags.select(key, "tag_id", "confidence", "actor", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), "label", normalized(F.col("label")).alias("norm"), _weight(F.col("confidence"), exponent).alias("w"), F.coalesce("inherited", F.lit(False)).alias("inherited") if "inherited" in tags.columns else F.lit(False).alias("inherited"))
    rows = rows.withColumn("actor", F.when(F.trim("actor") != "", F.col("actor")))
    count = rows.groupBy(key).agg(F.count("*").alias("nr_tags"), F.count(F.when(F.col("inherited"), 1)).alias("nr_tags_indirect"))

    def best(df: DataFrame, name: str) -> DataFrame:
        """Of each key the name with the greatest weight."""
        top = df.groupBy(key).agg(F.max("w").alias("w"))
        return df.join(top, [key, "w"]).groupBy(key).agg(F.min(name).alias(name))

    actors = rows.filter("actor is not null").groupBy(key, "actor").agg(F.sum("w").alias("w"))
    actor = best(actors, "actor").withColumnRenamed("actor", "best_actor")
    inside = rows.join(actor, key, "left").filter("best_actor is null or actor = best_actor")
    label = best(inside.groupBy(key, "norm").agg(F.sum("w").alias("w")), "norm")
    shown = inside.join(label, [key, "norm"]).groupBy(key).agg(F.max_by("label", "tag_id").alias("best_label"))
    each = rows.select(key, "w", F.explode(F.when(F.size("concepts") > 0, F.col("concepts")).otherwise(F.array(F.lit("unknown")))).alias("concept"))
    factor = F.coalesce(*[F.when(F.col("concept") == c, F.lit(x)) for c, x in CONCEPT_WEIGHTS.items()], F.lit(1.0))
    concept = best(each.groupBy(key, "concept").agg(F.sum(F.col("w") * factor).alias("w")), "concept")
    broad = concept.select(key, F.when(F.col("concept") == "exchange", "exchange").otherwise("entity").alias("broad_concept"))
    return count.join(actor, key, "left").join(shown, key, "left").join(broad, key, "left")


def label_digest(tags: DataFrame, key: str, exponent: float = 2.0) -> DataFrame:
    """One row for each ``key`` and normalised label: tags, mean confidence, relevance.

    A label's weight is raised by the share of words that recur among the key's labels and
    are part of it; relevance is its part of the key's total.
    """
    conf = F.when(F.coalesce("confidence", F.lit(0)) == 0, 0.1).otherwise(F.col("confidence").cast("double"))
    rows = tags.select(key, "tag_id", "label", normalized(F.col("label")).alias("norm"), conf.alias("conf"), _weight(F.col("confidence"), exponent).alias("w"))
    words = rows.select(key, F.explode(F.split("norm", " ")).alias("word")).filter(~F.col("word").isin(*COMMON_WORDS))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    totals = counted.groupBy(key).agg(F.sum("n").alias("words"))
    labels = rows.groupBy(key, "norm").agg(F.count("*").alias("count"), F.avg("conf").alias("mean"), F.sum("w").alias("w"), F.max_by("label", "tag_id").alias("label"))
    recurring = labels.select(key, "norm").join(counted.filter("n > 1"), key).filter(F.contains("norm", "word")).groupBy(key, "norm").agg(F.sum("n").alias("hits"))
    raised = labels.join(recurring, [key, "norm"], "left").join(totals, key, "left")
    raised = raised.withColumn("w", F.col("w") * (1 + F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), "words"), F.lit(0.0))))
    whole = raised.groupBy(key).agg(F.sum("w").alias("whole"))
    return raised.join(whole, key).select(key, "norm", "label", "count", (F.col("mean") / 100).alias("confidence"), (F.col("w") / F.col("whole")).alias("relevance"))


def inherited(tags: DataFrame, mapping: DataFrame, groups: list[str]) -> DataFrame:
    """Tags of every mapped address: its own, and its cluster's best one if it is another's."""
    own = _mapped(tags.filter(F.col("acl_group").isin(groups)), mapping).select("network", F.col("identifier").alias("address"), "tag_id", F.lit(False).alias("inherited"))
    best = best_cluster_tag(tags, mapping, groups).select("network", "cluster_id", "tag_id")
    from_cluster = mapping.join(best, ["network", "cluster_id"]).select("network", "address", "tag_id", F.lit(True).alias("inherited"))
    new = from_cluster.join(own.select("network", "address", "tag_id"), ["network", "address", "tag_id"], "left_anti")
    return own.union(new)


def obfuscated(tags: DataFrame, public: str = "public") -> DataFrame:
    """Tags that aren't public lose what they say, not that they are there."""
    hidden = F.col("acl_group") != public
    return tags.withColumns({c: F.when(~hidden, F.col(c)) for c in ("label", "actor", "source", "creator") if c in tags.columns})


def concept_paths(concepts: DataFrame) -> DataFrame:
    """(id, root, depth) of a concept tree (id, parent), as many joins as it is deep; a concept on a circle has no root and isn't in it."""
    level = cut(concepts.filter("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")), "concepts")
    known, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = cut(concepts.join(level.select(F.col("id").alias("parent"), "root"), "parent").select("id", "root", F.lit(depth).alias("depth")), "concepts")
        known = known.union(level)
    return known


def counts_of_actors(actors: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """``actors`` with tags and labels: how many tags and distinct labels name each; 0 where none does."""
    counts = tags.groupBy(key).agg(F.count("*").alias("tags"), F.count_distinct("label").alias("labels"))
    return actors.join(counts, key, "left").fillna(0, ["tags", "labels"])


def without_jurisdiction(actors: DataFrame, jurisdictions: DataFrame, key: str) -> DataFrame:
    """Actors that no row of ``jurisdictions`` names; a null key has none."""
    return actors.join(jurisdictions, key, "left_anti")


def actors_of(members: DataFrame, named: DataFrame) -> DataFrame:
    """(cluster_id, actor): actors that a tag of any member names."""
    return members.join(named, "address").select("cluster_id", "actor").distinct()


def tags_where(tags: DataFrame, groups: list[str], actor: str | None = None, label: str | None = None, clusters: DataFrame | None = None, limit: int = 100, after: int | None = None) -> DataFrame:
    """A page of visible tags by actor, by label (whatever its case and marks) or by cluster (network, cluster_id, address)."""
    rows = tags.filter(F.col("acl_group").isin(groups))
    if actor is not None:
        rows = rows.filter(F.col("actor") == actor)
    if label is not None:
        rows = rows.filter(normalized(F.col("label")) == normalized(F.lit(label)))
    if clusters is not None:
        rows = rows.join(clusters.select("network", F.col("address").alias("identifier")).distinct(), ["network", "identifier"], "left_semi")
    rows = rows if after is None else rows.filter(F.col("tag_id") > after)
    return rows.orderBy("tag_id").limit(limit)
