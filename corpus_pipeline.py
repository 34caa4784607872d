"""A cleaning pipeline over documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from ledgerloom.llm.common import ship, stored, table


#: A text whose best language scores less is in none that the model knows.
LEAST_SCORE = 0.25


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that clash with ``names``, in any case, under other names, and what each column is called now."""
    taken = {n.lower() for n in names}
    now = {c: f"_aside_{i}_{c}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed({c: n for c, n in now.items() if c != n}), now


def _back(df: DataFrame, now: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`").alias(c) for c, n in now.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, with that language as lang.

    Documents that are rejected go: those without any letter, and those whose best language
    scores below LEAST_SCORE. lang says what was predicted, where it was null or another one too.
    """
    ship(spark)
    rows, now = _aside(docs, "lang_pred", "score")
    judged = language_id.predict(rows, language_id.train(rows))
    told = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _back(told.withColumn("lang", F.col("lang_pred")), now)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold are taken out; n_chars follows the text, which is never null then."""
    ship(spark)
    rows, now = _aside(docs, "n_lines", "n_dropped", "lines", "hashes", "drop", "kept", "t1", "t2", "hits")
    kept = line_dedup.dedup_lines(rows)
    return _back(kept.withColumn("n_chars", F.char_length("text").cast("long")), now)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest id; rows that share an id are judged each."""
    ship(spark)
    return near_dedup.without_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows, now = _aside(docs, "hits")
    found = decontaminate.find_items(rows, table(spark, sf_dir, "benchmark"))
    return _back(found.filter(F.size("hits") == 0), now)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target shares, shuffled; adds replica and shuffle_key."""
    ship(spark)
    return mixing.mix(docs, seed=7)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: Learned languages and MinHash components can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
