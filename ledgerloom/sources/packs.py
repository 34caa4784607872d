"""Tag packs: a header and its tags as one table, and tables as flat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import flat


def tags_of_packs(packs: DataFrame, tags: str = "tags") -> DataFrame:
    """One row for each tag of each pack; what a tag doesn't say itself is taken from its pack's header.

    ``packs`` has header columns and an array of structs. Columns that only the header has
    are copied to every tag, those that only tags have stay, and of those that both have
    the tag's value counts unless it is null. A pack without tags gives no rows.
    """
    inner = packs.schema[tags].dataType.elementType.fieldNames()
    header = [c for c in packs.columns if c != tags]
    each = packs.select(*[F.col(f"`{c}`").alias(f"_header_{c}") for c in header], F.explode(tags).alias("_tag"))
    own = lambda c: F.col("_tag").getField(c)
    kept = [(F.coalesce(own(c), f"_header_{c}") if c in inner else F.col(f"_header_{c}")).alias(c) for c in header]
    return each.select(*kept, *[own(c).alias(c) for c in inner if c not in header])


def incomplete(tags: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Tags that lack a needed field after inheritance, with the names of those that are missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    return tags.withColumn("missing", missing).filter(F.size("missing") > 0)


def write_flat(df: DataFrame, path: str, kind: str = "csv") -> None:
    """``df`` as CSV with a header, JSON lines or Parquet; structs become columns for CSV, arrays their JSON."""
    if kind == "csv":
        df = flat(df)
        df = df.select(*[(F.to_json(f"`{f.name}`") if f.dataType.typeName() in ("array", "map") else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def read_flat(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A table written by ``write_flat``, or by others in the same form, with the types of ``schema``."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("escape", '"').csv(path) if kind == "csv" else reader.format(kind).load(path)


def cross_rates(rates: DataFrame, fx: DataFrame, base: str) -> DataFrame:
    """``rates`` (day, value in ``base``) with a row for each currency of ``fx`` (day, currency, per_base).

    Days without an exchange rate have rows for ``base`` only.
    """
    others = rates.join(fx, "day").select("day", "currency", (F.col("value") * F.col("per_base")).alias("value"))
    return rates.select("day", F.lit(base).alias("currency"), "value").union(others)
