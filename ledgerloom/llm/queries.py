"""Queries over whole tables that the driver registers, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, mixing, near_dedup, pii, quotation, substring_dedup, toxicity, vector_search
from .common import held_out, table


def _sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", _sha256("text").alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=50)
    digest = F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(_sha256("kept"))
    return out.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256).drop("n_read")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts, more = ([count(k.name) for k in pii.KINDS if k.base == b] for b in (True, False))
    scores = F.transform("pii", lambda s: F.round(s["score"], 2)).alias("scores")
    of_base = F.filter("pii", lambda s: s["kind"].isin(base))
    return out.select("doc_id", *counts, F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), *more, scores)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotation.link_quotes(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "position", "reply_to_conv", "reply_to_turn", "n_quotes", "max_level", "n_linked", "clean_text", "chat")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=7)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.7).cast("int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"), F.size("offending").alias("n_offending"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


_ALL = (
    op1_line_dedup,
    op2_substring_dedup,
    op3_exact_top_k,
    op4_pii,
    op5_minhash_near_dedup,
    op6_quotation_linking,
    op7_poisson_mixing,
    op8_decontamination,
    op9_toxicity,
    op10_language_id,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op1_line_dedup": """
        with lines as (
            select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
        ), one as (
            select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from lines
        ), keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from one
        ), frequent as (
            select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10
        ), marked as (
            select keyed.*, frequent.k is not null as gone from keyed left join frequent using (k)
        )
        select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from marked group by r, doc_id
    """,
    "op3_exact_top_k": """
        with v as (
            select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
            where vec_id is not null and embedding is not null
                and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
        ), ranked as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
        )
        select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
    """,
    "op7_poisson_mixing": """
        with recursive sizes as (
            select source, count(*) as n from documents group by source
        ), plan as (
            select source, sqrt(n::double) / (select sum(sqrt(n::double)) from sizes) * (select sum(n) from sizes)::double / n as rate from sizes
        ), parts as (
            select source, greatest(1, ceil(rate / 32.0))::int as parts, rate / greatest(1, ceil(rate / 32.0))::int as r from plan
        ), p as (
            select source, parts, r, 0 as k, exp(-r) as p, exp(-r) as c from parts
            union all
            select source, parts, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) from p where k < ceil(r + 12 * sqrt(r) + 24)
        ), sums as (
            select source, parts, list(c order by k) as c from p group by source, parts
        ), unit as (
            select d.*, s.c, ('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, '') || ':' || part), 1, 13))::bigint / 4503599627370496.0 as u
            from (select *, row_number() over () as r from documents) d
            join sums s on d.source is not distinct from s.source, range(1, s.parts + 1) t(part)
        ), drawn as (
            select doc_id, text, lang, source, n_chars, r, len([x for x in c if x <= u]) as times from unit
        ), counted as (
            select doc_id, text, lang, source, n_chars, r, sum(times) as times from drawn group by all
        )
        select doc_id, text, lang, source, n_chars, replica::int as replica,
            md5('order:7:' || coalesce(doc_id::varchar, '') || ':' || replica) as shuffle_key
        from counted, range(1, times::bigint + 1) t(replica)
    """,
}
