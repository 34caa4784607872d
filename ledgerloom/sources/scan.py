"""Finding addresses in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import address_kind

#: What an address can look like; checksums decide.
CANDIDATE = r"(?<![0-9A-Za-z])(?:0x[0-9a-fA-F]{40}|(?:bc|tb|ltc)1[02-9ac-hj-np-z]{11,71}|[13TLM][1-9A-HJ-NP-Za-km-z]{25,34})(?![0-9A-Za-z])"


def addresses_in(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, address, kind): addresses whose checksum holds, once for each text.

    The expression runs in the JVM; only what it finds goes to Python for the checksum.
    """
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(CANDIDATE), F.lit(0)))).alias("address"))
    return found.withColumn("kind", address_kind(F.col("address"))).filter("kind is not null")
