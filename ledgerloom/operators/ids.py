"""Dense ids, buckets and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut

#: Default sizes of the buckets that queryable tables are grouped by.
ID_BUCKET, BLOCK_BUCKET, SECONDARY = 25_000, 150_000, 100
INT_MAX = 2**31 - 1


def dense_ids(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """``df`` with ids start, start + 1, ... in the order of ``order``, without a global window.

    Rows are range-partitioned and sorted; a row's place in its partition plus the counts of
    the partitions before it is its id. Only those counts, one row a partition, meet in one
    task. The sorted rows are written once, so a retried task can't number them anew.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ids")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row a partition
    return numbered.withColumn(name, (F.col("_before") + inside + F.lit(start)).cast("long")).drop("_at", "_part", "_before")


def id_group(value: Column, size: int = ID_BUCKET) -> Column:
    return F.floor(value / size).cast("int")


def wrapped_group(value: Column, size: int) -> Column:
    """Groups of ids beyond 32 bits wrap to a signed 32-bit number."""
    return (F.pmod(F.floor(value / size) + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("int")


def block_group(block: Column, size: int = BLOCK_BUCKET) -> Column:
    return F.floor(block / size).cast("int")


def secondary_group(value: Column, size: int = SECONDARY) -> Column:
    return F.pmod(value, F.lit(size)).cast("int")


def saturated(count: Column) -> Column:
    """A count as a 32-bit number that stops at its greatest value."""
    return F.least(count, F.lit(INT_MAX)).cast("int")


def prefix(text: Column, length: int, upper: bool = True) -> Column:
    cut_ = F.substring(text, 1, length)
    return F.upper(cut_) if upper else F.lower(cut_)


def address_prefix(address: Column, length: int, hrp: str = "") -> Column:
    """First ``length`` characters, after the human-readable part of a bech32 address."""
    plain = F.substring(address, 1, length)
    return F.when(address.startswith(hrp), F.substring(address, len(hrp) + 1, length)).otherwise(plain) if hrp else plain


def transaction_id(block: Column, index: Column) -> Column:
    """Block in the high 32 bits, index in the low ones."""
    return F.shiftleft(block.cast("long"), 32).bitwiseOR(index.cast("long"))


def block_of(tx_id: Column) -> Column:
    return F.shiftright(tx_id, 32).cast("int")


def in_block_range(df: DataFrame, start: int | None = None, end: int | None = None, column: str = "block_id") -> DataFrame:
    """Rows of blocks start to end, both included; an open side has no bound. Reaches the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    return df if end is None else df.filter(F.col(column) <= end)


def skewed_secondary_ids(df: DataFrame, group: str, key: str, factor: float = 2.5, exact: bool = True) -> DataFrame:
    """Adds secondary_group: groups of above ``factor`` times the median size are cut into pieces of that size.

    A row's piece follows a hash of ``key``, so no group is ordered by one task.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    middle = F.median("_n") if exact else F.percentile_approx("_n", 0.5, 100)
    limit = sizes.agg((middle * factor).alias("_limit"))
    pieces = sizes.crossJoin(F.broadcast(limit)).select(group, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("_limit"))).cast("int").alias("_pieces"))
    joined = df.join(pieces, group)
    return joined.withColumn("secondary_group", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.col("_pieces")).cast("int")).drop("_pieces")


def secondary_lookup(df: DataFrame, group: str, secondary: str = "secondary_group") -> DataFrame:
    """(group, max_secondary_id) of groups that have more than one."""
    return df.groupBy(group).agg(F.max(secondary).alias("max_secondary_id")).filter("max_secondary_id > 0")


def hash_ids(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """(column, address_id): ids that need no order, from a seeded hash."""
    return df.select(column).distinct().withColumn("address_id", F.xxhash64(F.col(column), F.lit(seed)))


def id_collisions(ids: DataFrame, column: str, name: str = "address_id") -> DataFrame:
    """Ids that several values share."""
    return ids.groupBy(name).agg(F.count_distinct(column).alias("n")).filter("n > 1")
