"""Tables in a lake of Parquet files: ranges, appends without repeats, overwrites by partition, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from ..operators.ids import in_block_range
from ..plans.stage import files


class Lake:
    """Named tables under a root. Additional columns of later files are read as null in earlier ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, path = files(self.spark, self.path(name))
        return fs.exists(path)

    def columns(self, name: str) -> list[str]:
        """Columns of a table, partition columns last; none if there is no such table."""
        return self.read(name).columns if self.exists(name) else []

    def is_empty(self, name: str) -> bool:
        return not self.exists(name) or self.read(name).isEmpty()

    def partitions(self, name: str) -> list[str]:
        """Names of a table's folders, such as ``partition=3``, from a listing; no file is opened."""
        fs, path = files(self.spark, self.path(name))
        found = fs.listStatus(path) if fs.exists(path) else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName())

    def mark_complete(self, name: str, block: int) -> None:
        """Note that all blocks up to ``block`` are written, by an empty folder beside the table; the highest one counts."""
        fs, path = files(self.spark, f"{self.root}/_complete/{name}/{block:020d}")
        fs.mkdirs(path)

    def complete_up_to(self, name: str) -> int | None:
        fs, path = files(self.spark, f"{self.root}/_complete/{name}")
        marks = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return max(marks, default=None)

    def read(self, name: str, start: int | None = None, end: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """A table's blocks start to end; both filter and columns reach the scan."""
        df = in_block_range(self.spark.read.option("mergeSchema", "true").parquet(self.path(name)), start, end)
        return df.select(*columns) if columns else df

    def items(self, name: str, blocks: list[int], partition_size: int | None = None) -> DataFrame:
        """Rows of given blocks; with a partition size, only their partitions are opened."""
        df = self.read(name).filter(F.col("block_id").isin(blocks))
        return df.filter(F.col("partition").isin(sorted({b // partition_size for b in blocks}))) if partition_size else df

    def append(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        self._write(df, partition).mode("append").parquet(self.path(name))

    def overwrite_partitions(self, name: str, df: DataFrame, partition: str) -> None:
        """Replace the partitions that ``df`` has rows of, and no others."""
        self._write(df, partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    def merge_new(self, name: str, df: DataFrame, keys: list[str], partition: str | None = None) -> None:
        """Append the rows whose key the table doesn't have yet; of repeated keys in ``df``, one."""
        new = df.dropDuplicates(keys)
        if self.exists(name):
            new = new.join(self.read(name).select(*keys), keys, "left_anti")
        self.append(name, new, partition)

    def highest_block(self, name: str) -> int | None:
        return self.read(name).agg(F.max("block_id")).first()[0] if self.exists(name) else None

    def discard_above(self, name: str, block: int, partition: str) -> None:
        """Take out rows above a block, which a writer that stopped half-way has left.

        Run again after a stop of its own, it finds what is still above the block.
        """
        df = self.read(name)
        touched = [r[0] for r in df.filter(F.col("block_id") > block).select(partition).distinct().collect()]  # partitions of one unfinished batch
        from ..plans.stage import cut

        kept = cut(df.filter(F.col(partition).isin(touched) & (F.col("block_id") <= block)), "kept")
        left = {r[0] for r in kept.select(partition).distinct().collect()}
        empty = [p for p in touched if p not in left]
        self.overwrite_partitions(name, kept, partition)
        for p in empty:
            fs, path = files(self.spark, f"{self.path(name)}/{partition}={p}")
            fs.delete(path, True)

    def compact(self, name: str, partition: str, value: int, n: int = 1) -> None:
        """Rewrite one partition as ``n`` files."""
        from ..plans.stage import cut

        rows = cut(self.read(name).filter(F.col(partition) == value), "compact")
        self.overwrite_partitions(name, rows.repartition(n), partition)

    @staticmethod
    def _write(df: DataFrame, partition: str | None):
        writer = (df.repartition(partition) if partition else df).write.option("compression", "zstd")
        return writer.partitionBy(partition) if partition else writer


def processed_ranges(df: DataFrame, column: str) -> DataFrame:
    """(range_start, range_end) of runs of consecutive numbers.

    A number starts a run if the one before it isn't there, and ends one if the next isn't;
    the n-th start belongs to the n-th end. Only the borders are ordered.
    """
    have = df.select(F.col(column).alias("v")).distinct()
    starts = have.join(have.select((F.col("v") + 1).alias("v")), "v", "left_anti").withColumn("nth", F.row_number().over(Window.orderBy("v")))
    ends = have.join(have.select((F.col("v") - 1).alias("v")), "v", "left_anti").withColumn("nth", F.row_number().over(Window.orderBy("v")))
    return starts.withColumnRenamed("v", "range_start").join(ends.withColumnRenamed("v", "range_end"), "nth").drop("nth")


def missing_ranges(df: DataFrame, column: str) -> DataFrame:
    """Gaps between runs."""
    runs = processed_ranges(df, column)
    after = runs.withColumn("next", F.lead("range_start").over(Window.orderBy("range_start")))
    return after.filter("next is not null").select((F.col("range_end") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"))


def partition_audit(df: DataFrame, key: str) -> DataFrame:
    """For each task's partition: rows, distinct keys, and the rows of its most frequent key."""
    per = df.groupBy(F.spark_partition_id().alias("partition"), key).agg(F.count("*").alias("n"))
    return per.groupBy("partition").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.max("n").alias("largest_key"))


def oversized_keys(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of keys up to ``limit`` rows, rows of larger keys), for writers with a ceiling per partition."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def salted(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows dealt by key and a hash of the whole row, so that a frequent key takes ``n`` tasks."""
    return df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(n)))


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: matched without regard to case and underscores, cast, missing ones null."""
    flat = lambda name: name.replace("_", "").lower()
    have = {flat(c): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[flat(f.name)]}`") if flat(f.name) in have else F.lit(None)).cast(_plain(f.dataType)).alias(f.name) for f in schema.fields])


def _plain(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_plain(kind.elementType))
    return MapType(_plain(kind.keyType), _plain(kind.valueType)) if isinstance(kind, MapType) else kind


def divergence(lake: Lake, tables: list[str]) -> dict[str, int | None]:
    """Highest block of each table; sinks that agree have the same."""
    return {t: lake.highest_block(t) for t in tables}


def write_all(lakes: list[Lake], name: str, df: DataFrame, partition: str | None = None) -> None:
    """Append the same rows to every sink; they are computed once, so that all get the same."""
    from ..plans.stage import cut, discard

    rows = cut(df, "sinks")
    for lake in lakes:
        lake.append(name, rows, partition)
    discard(rows)


def catch_up(ahead: Lake, behind: Lake, name: str, keys: list[str], partition: str | None = None) -> None:
    """Copy what ``behind`` lacks, from its highest block on; a block that was written in part is completed, not repeated."""
    have = behind.highest_block(name)
    rows = ahead.read(name, start=have)
    if have is not None:
        rows = rows.join(behind.read(name, start=have).select(*keys), keys, "left_anti")
    behind.append(name, rows, partition)
