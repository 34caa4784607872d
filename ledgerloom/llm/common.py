"""What the operators share: tables, stages in storage that every executor can see, the held-out third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import cut as stored
from ..plans.stage import discard, ship

__all__ = ["discard", "held_out", "ship", "stored", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """Rows no model may learn labels from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with the names an operator adds."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
