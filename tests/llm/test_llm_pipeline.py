"""The pipeline stage by stage, and the registered queries against SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import language_id, queries

from .test_llm_operators import brute_components, brute_hits, brute_lines


def test_stages_do_what_brute_force_does(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 ?!", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    now = docs.union(junk)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "lines", "near_copies", "benchmark", "mixture"]

    told = steps["language"](spark, now, sf_dir)
    scored = language_id.predict(now, language_id.train(now)).collect()
    want = {(r.doc_id, r.lang_pred) for r in scored if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert told.columns == docs.columns and {(r.doc_id, r.lang) for r in told.collect()} == want and len(want) >= docs.count() - 2

    rows = told.orderBy("doc_id").collect()
    lines = {r.doc_id: r for r in steps["lines"](spark, told, sf_dir).collect()}
    for r, kept in zip(rows, brute_lines([r.text for r in rows], 10), strict=True):
        assert lines[r.doc_id].text == "\n".join(kept) and lines[r.doc_id].n_chars == len(lines[r.doc_id].text)

    left = spark.createDataFrame(list(lines.values()), docs.schema)
    near = steps["near_copies"](spark, left, sf_dir)
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in lines.values()]).items() if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want

    clean = steps["benchmark"](spark, near, sf_dir)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    hit = {d for d, _ in brute_hits({r.doc_id: r.text for r in near.collect()}, items)}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want - hit

    mixed = steps["mixture"](spark, clean, sf_dir)
    assert set(docs.columns) < set(mixed.columns)
    n = clean.count()
    assert abs(mixed.count() - n) < 6 * n**0.5
    assert mixed.groupBy("doc_id", "replica").count().filter("count > 1").count() == 0


def test_stages_take_nulls_repeated_rows_and_other_columns(spark, sf_dir):
    text = "the and of is in to that it for was with as on be at by this from are or an " * 3
    other = "der die das und in den von zu mit sich auf ist nicht ein eine als auch es an werden aus " * 3
    rows = [(1, text, None, "a", 1, "x"), (1, text, "en", "a", 1, "y"), (2, text, "de", "a", 1, "z"), (2, other, "de", None, None, None), (None, other, None, "a", 2, "n"), (3, None, "en", "b", 0, "e"), (4, "", "en", "b", 0, "e"), (5, "12 34 !?", "en", "b", 9, "e"), (6, "w" * 30_000, "en", "b", 9, "e")]
    train = [(100 + i, (text if i % 2 else other) + f" {i}", "en" if i % 2 else "de", "a", 5, "t") for i in range(30)]
    docs = spark.createDataFrame(rows + train, "doc_id long, text string, lang string, source string, n_chars long, SCORE string")
    steps = dict(corpus_pipeline.STAGES)
    told = steps["language"](spark, docs, sf_dir)
    langs = {r.SCORE: r.lang for r in told.collect()}
    assert told.columns == docs.columns and langs["x"] == langs["z"] == "en" and langs["n"] == "de" and "e" not in langs
    lines = steps["lines"](spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    near = steps["near_copies"](spark, docs.filter("SCORE is null or SCORE != 't'"), sf_dir)
    left = sorted((r.doc_id or -1, (r.text or "")[:3]) for r in near.collect())
    assert near.columns == docs.columns and left == [(-1, "der"), (1, "the"), (2, "der"), (3, ""), (4, ""), (5, "12 "), (6, "www")]
    clean = steps["benchmark"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert set(docs.columns) < set(steps["mixture"](spark, docs, sf_dir).columns)


def test_run_applies_the_stages_and_takes_no_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))


def test_remaining_queries_return_a_row_for_each_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op4_pii", "op5_minhash_near_dedup", "op9_toxicity", "op10_language_id"):
        out = queries.QUERIES[name](spark, sf_dir)
        assert out.count() == docs and out.filter(F.col("doc_id").isNull()).count() == 0
