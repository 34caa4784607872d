"""Queries over tags made from customers, each with SQL that computes it independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import tags as T
from ..sources.projection import Ledger, table
from .utxo_queries import LEDGER_SQL

TAG_SQL = (
    LEDGER_SQL
    + """
, tags as (
    select c_custkey tag_id, 'net' || (c_custkey // 2 % 3) network, 'C' || (c_custkey // 2 * 2) identifier, c_mktsegment || ' ' || n_name as label,
        case when c_nationkey % 5 <> 0 then n_name end actor, (c_custkey % 10 * 10)::int confidence, c_custkey % 4 = 0 definer,
        list_concat(case when c_custkey % 3 = 0 then []::varchar[] else [lower(c_mktsegment)] end, case when c_nationkey % 4 = 0 then ['exchange'] else []::varchar[] end) concepts,
        'creator' || (c_custkey % 6) creator, case when c_custkey % 2 = 0 then 'public' else 'private' end acl_group, 'src' || c_nationkey as source
    from customer join nation on n_nationkey = c_nationkey
), mapping as (
    select 'net' || (substr(address, 2)::int // 2 % 3) network, address, cluster_id, count(*) over (partition by cluster_id) cluster_size from clusters join ids using (address_id) where address like 'C%'
), mapped as (select t.*, cluster_id, cluster_size from tags t join mapping m on m.network = t.network and m.address = t.identifier
), cluster_tags as (select distinct network, cluster_id, tag_id from mapped where definer or cluster_size = 1
), best as (
    select network, cluster_id, tag_id, label, confidence from (
        select c.*, label, confidence, row_number() over (partition by c.network, cluster_id order by confidence desc, c.tag_id) r from cluster_tags c join tags t using (network, tag_id) where acl_group = 'public') where r = 1
), words_of as (
    select label, list_distinct(flatten([[substr('  ' || w || ' ', i::int, 3) for i in range(1, len(w) + 2)] for w in string_split_regex(lower(label), '[^0-9a-z]+') if w <> ''])) t from (select distinct label from tags)
), weighed as (
    select *, pow(case when confidence = 0 then 0.1 else confidence::double end, 2.0) w, case when confidence = 0 then 0.1 else confidence::double end conf,
        regexp_replace(regexp_replace(lower(trim(label)), '[^0-9a-zA-Z_ ]+', ' ', 'g'), ' +', ' ', 'g') norm from tags
)
"""
)

QUERIES, SQL = {}, {}


class Tags:
    def __init__(self, spark, sf_dir: str, ledger: Ledger | None = None):
        self.ledger = ledger or Ledger(spark, sf_dir)
        rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        key, pair = F.col("c_custkey"), F.expr("c_custkey div 2")
        none = F.array().cast("array<string>")
        self.tags = rows.select(
            key.alias("tag_id"),
            F.concat(F.lit("net"), pair % 3).alias("network"),
            F.concat(F.lit("C"), pair * 2).alias("identifier"),
            F.concat_ws(" ", "c_mktsegment", "n_name").alias("label"),
            F.when(F.col("c_nationkey") % 5 != 0, F.col("n_name")).alias("actor"),
            (key % 10 * 10).cast("int").alias("confidence"),
            (key % 4 == 0).alias("is_cluster_definer"),
            F.concat(F.when(key % 3 == 0, none).otherwise(F.array(F.lower("c_mktsegment"))), F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("exchange"))).otherwise(none)).alias("concepts"),
            F.concat(F.lit("creator"), key % 6).alias("creator"),
            F.when(key % 2 == 0, "public").otherwise("private").alias("acl_group"),
            F.concat(F.lit("src"), "c_nationkey").alias("source"),
        )

    @property
    def mapping(self) -> DataFrame:
        sizes = self.ledger.clusters.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
        rows = self.ledger.clusters.join(sizes, "cluster_id").join(self.ledger.ids, "address_id").filter("address like 'C%'")
        return rows.select(F.concat(F.lit("net"), F.expr("cast(substring(address, 2) as int) div 2 % 3")).alias("network"), "address", "cluster_id", "cluster_size")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, made=None: f(made or Tags(spark, sf_dir))
        SQL[f.__name__] = TAG_SQL + sql
        return f

    return add


@query(
    """select network, count(*) nr_tags, count(distinct label) nr_labels, count(distinct identifier) nr_identifiers_explicit,
    (select sum(s) from (select cluster_id, max(cluster_size) s from mapping m where m.network = tags.network group by cluster_id))::bigint nr_identifiers_implicit from tags group by network"""
)
def tag_statistics(x: Tags) -> DataFrame:
    return T.statistics(x.tags, x.mapping)


@query("select network, cluster_id, acl_group, count(*) as count from mapped group by all")
def tag_count_by_cluster(x: Tags) -> DataFrame:
    return T.count_by_cluster(x.tags, x.mapping)


@query("select network, cluster_id, tag_id, label, confidence from best")
def tag_best_of_cluster(x: Tags) -> DataFrame:
    return T.best_cluster_tag(x.tags, x.mapping, ["public"])


@query("select tag_id, identifier, label, confidence from tags where identifier in ('C2', 'C10', 'C44', 'C120') and acl_group in ('public', 'private') order by confidence desc, tag_id limit 5 offset 1")
def tags_by_subjects(x: Tags) -> DataFrame:
    return T.of_subjects(x.tags, ["C2", "C10", "C44", "C120"], ["public", "private"], 5, 1).select("tag_id", "identifier", "label", "confidence")


@query("select distinct network, cluster_id from cluster_tags join tags using (network, tag_id) where list_contains(concepts, 'exchange')")
def tag_clusters_with_concept(x: Tags) -> DataFrame:
    return T.clusters_with_concept(x.tags, x.mapping, "exchange")


@query("select creator, acl_group, network, count(distinct label) labels, count(*) tags from tags group by all")
def tag_composition(x: Tags) -> DataFrame:
    return T.composition(x.tags, "creator", "acl_group", "network")


@query("select network, identifier, array_to_string(list_sort(list(distinct actor)), ',') actors from tags where actor is not null group by network, identifier having count(distinct actor) > 1")
def tag_actor_collisions(x: Tags) -> DataFrame:
    return T.actor_collisions(x.tags).withColumn("actors", F.array_join("actors", ","))


@query("select label, count(*) tags from tags where actor is null group by label order by tags desc, label limit 8")
def tag_labels_without_actor(x: Tags) -> DataFrame:
    return T.labels_without_actor(x.tags, 8)


@query("select tag_id from (select tag_id, row_number() over (partition by network, lower(label) order by tag_id desc) r from tags) where r > 1")
def tag_duplicates(x: Tags) -> DataFrame:
    return T.duplicates(x.tags, ("network", "label")).select("tag_id")


@query("select network, cluster_id, cluster_size, nth::int nth from (select *, row_number() over (partition by network order by cluster_size desc, cluster_id) nth from (select distinct network, cluster_id, cluster_size from mapping)) where nth <= 3")
def tag_mapping_sample(x: Tags) -> DataFrame:
    return T.first_per_network(x.mapping, 3)


@query(
    """select coalesce(network, 'overall') network, count(*) as rows, sum(case when cluster_id % 3 = 0 then 1 else 0 end)::bigint moved, sum(case when cluster_id % 3 = 0 then 1 else 0 end) / count(*) rate
    from mapping group by rollup (network)"""
)
def tag_mapping_staleness(x: Tags) -> DataFrame:
    now = x.mapping.withColumn("cluster_id", F.when(F.col("cluster_id") % 3 == 0, F.col("cluster_id") + 1).otherwise(F.col("cluster_id")))
    return T.staleness(x.mapping, now)


@query(
    """, q as (select list_distinct(flatten([[substr('  ' || w || ' ', i::int, 3) for i in range(1, len(w) + 2)] for w in ['machinry', 'nation_7', 'nation', '7'] if w <> 'nation_7'])) e)
    select label, similarity from (select label, len(list_intersect(t, e)) / (len(t) + len(e) - len(list_intersect(t, e))) similarity from words_of, q) where similarity >= 0.3 order by similarity desc, label limit 10"""
)
def tag_fuzzy_search(x: Tags) -> DataFrame:
    return T.fuzzy(x.tags, "label", "machinry NATION_7", 10)


@query(
    """, several as (select network, identifier, count(label) n_tags, count(distinct label) n_dif_tags from tags group by all having count(distinct label) > 1),
    pairs as (select a.network, a.identifier, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) sim from tags a join tags b on a.network = b.network and a.identifier = b.identifier and a.tag_id < b.tag_id
        join words_of x on x.label = a.label join words_of y on y.label = b.label join several s on s.network = a.network and s.identifier = a.identifier)
    select network, identifier, any_value(n_tags) n_tags, any_value(n_dif_tags) n_dif_tags, count(*) filter (where sim <= 0.25) q1, count(*) filter (where sim > 0.25 and sim <= 0.5) q2,
        count(*) filter (where sim > 0.5 and sim <= 0.75) q3, count(*) filter (where sim > 0.75) q4, count(*) total_pairs,
        1 - (count(*) filter (where sim <= 0.25) * 0.25::double + count(*) filter (where sim > 0.25 and sim <= 0.5) * 0.5::double + count(*) filter (where sim > 0.5 and sim <= 0.75) * 0.75::double + count(*) filter (where sim > 0.75)) / count(*) quality
    from pairs join several using (network, identifier) group by network, identifier"""
)
def tag_quality(x: Tags) -> DataFrame:
    return T.quality(x.tags)


@query(
    """, actors as (select identifier, actor, sum(w) w from weighed where actor is not null group by all), best_actor as (select identifier, min(actor) actor from (select *, max(w) over (partition by identifier) m from actors) where w = m group by identifier),
    inside as (select t.*, b.actor best_actor from weighed t left join best_actor b using (identifier) where b.actor is null or t.actor = b.actor),
    norms as (select identifier, norm, sum(w) w, arg_max(label, tag_id) as label from inside group by all), best_norm as (select identifier, min(norm) norm from (select *, max(w) over (partition by identifier) m from norms) where w = m group by identifier),
    cs as (select identifier, unnest(case when len(concepts) > 0 then concepts else ['unknown'] end) c, w from weighed), cw as (select identifier, c, sum(w * case c when 'exchange' then 1.1::double when 'unknown' then 0.1::double else 1.0 end) w from cs group by all),
    bc as (select identifier, min(c) c from (select *, max(w) over (partition by identifier) m from cw) where w = m group by identifier)
    select t.identifier, count(*) nr_tags, 0::bigint nr_tags_indirect, any_value(b.actor) best_actor, any_value(n.label) best_label, any_value(case when bc.c = 'exchange' then 'exchange' else 'entity' end) broad_concept
    from weighed t left join best_actor b using (identifier) join best_norm bn using (identifier) join norms n on n.identifier = t.identifier and n.norm = bn.norm join bc on bc.identifier = t.identifier group by t.identifier"""
)
def tag_digest(x: Tags) -> DataFrame:
    return T.digest(x.tags, "identifier")


@query(
    """, ws as (select identifier, unnest(string_split(norm, ' ')) word from weighed), wc as (select identifier, word, count(*) n from ws where word not in ('to', 'in', 'the', 'by', 'of', 'at', '', 'vault') group by all),
    tot as (select identifier, sum(n) words from wc group by identifier), ls as (select identifier, norm, count(*) c, avg(conf) m, sum(w) w, arg_max(label, tag_id) as label from weighed group by all),
    hit as (select l.identifier, norm, sum(n) hits from ls l join wc using (identifier) where n > 1 and contains(norm, word) group by all), up as (select l.*, w * (1 + coalesce(coalesce(hits, 0) / words, 0)) r from ls l left join hit using (identifier, norm) left join tot using (identifier))
    select identifier, norm, label, c as count, m / 100 confidence, round(r / sum(r) over (partition by identifier), 9) relevance from up"""
)
def tag_label_digest(x: Tags) -> DataFrame:
    return T.label_digest(x.tags, "identifier").withColumn("relevance", F.round("relevance", 9))


@query(
    """select network, identifier address, tag_id, false inherited from mapped where acl_group = 'public'
    union all select m.network, m.address, b.tag_id, true from mapping m join best b using (network, cluster_id) where not exists (select 1 from mapped o where o.acl_group = 'public' and o.network = m.network and o.identifier = m.address and o.tag_id = b.tag_id)"""
)
def tag_inherited(x: Tags) -> DataFrame:
    return T.inherited(x.tags, x.mapping, ["public"])


@query("select tag_id, identifier, case when acl_group = 'public' then label end as label, case when acl_group = 'public' then actor end actor from tags")
def tag_obfuscated(x: Tags) -> DataFrame:
    return T.obfuscated(x.tags).select("tag_id", "identifier", "label", "actor")


@query("select label, norm from weighed group by all")
def tag_normalized_labels(x: Tags) -> DataFrame:
    return x.tags.select("label", normalized(F.col("label")).alias("norm")).distinct()


@query("select a.label a, b.label b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) s from words_of a join words_of b on a.label < b.label and len(list_intersect(a.t, b.t)) > 0")
def tag_label_similarity(x: Tags) -> DataFrame:
    return T.similar_labels(x.tags).withColumn("s", F.round("s", 9))


@query(
    """select 'actor' kind, tag_id from (select tag_id from tags where actor = 'NATION_7' and acl_group = 'public' order by tag_id limit 20) union all select 'label', tag_id from weighed where norm = 'building nation_3' and acl_group in ('public', 'private')
    union all select 'cluster', tag_id from tags t where exists (select 1 from mapping m where m.network = t.network and m.address = t.identifier and m.cluster_id = (select cluster_id from mapping group by cluster_id order by count(*) desc, cluster_id limit 1))"""
)
def tags_by_actor_label_cluster(x: Tags) -> DataFrame:
    mapping = x.mapping
    largest = mapping.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1)
    found = {
        "actor": T.tags_where(x.tags, ["public"], actor="NATION_7", limit=20),
        "label": T.tags_where(x.tags, ["public", "private"], label="Building  nation_3", limit=1 << 30),
        "cluster": T.tags_where(x.tags, ["public", "private"], clusters=mapping.join(largest, "cluster_id", "left_semi"), limit=1 << 30),
    }
    parts = [rows.select(F.lit(kind).alias("kind"), "tag_id") for kind, rows in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """, several as (select network, identifier from tags group by all having count(distinct label) > 1),
    pairs as (select a.network, a.identifier, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) sim from tags a join tags b on a.network = b.network and a.identifier = b.identifier and a.tag_id < b.tag_id
        join words_of x on x.label = a.label join words_of y on y.label = b.label join several s on s.network = a.network and s.identifier = a.identifier),
    measured as (select network, identifier, 1 - avg(case when sim <= 0.25 then 0.25 when sim <= 0.5 then 0.5 when sim <= 0.75 then 0.75 else 1.0 end::double) q from pairs group by all)
    select network, identifier, array_to_string(list_sort(list(distinct label)), ',') labels from measured join tags using (network, identifier) where q <= 0.3 group by all"""
)
def tag_low_quality_labels(x: Tags) -> DataFrame:
    return T.low_quality_labels(x.tags, T.quality(x.tags), 0.3).select("network", "identifier", F.array_join("labels", ",").alias("labels"))
