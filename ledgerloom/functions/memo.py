"""Memos that transactions carry in outputs which can't be spent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First characters of the memos of a liquidity network.
MEMO_STARTS = ("=", "s", "S", "+", "-", "~")


def memo(script: Column) -> Column:
    """The text that a data output carries, from its script (digits); null for other scripts and cut ones.

    The length stands in one byte up to 75, or after 4c in one and after 4d in two, the
    lower one first. Bytes that aren't UTF-8 become replacement characters.
    """
    byte = lambda at: F.conv(F.substring(script, 1 + 2 * at, 2), 16, 10).cast("int")
    push = byte(1)
    start = F.when(push <= 75, 2).when(push == 76, 3).when(push == 77, 4)
    size = F.when(push <= 75, push).when(push == 76, byte(2)).when(push == 77, byte(2) + 256 * byte(3))
    good = F.lower(F.substring(script, 1, 2)).eqNullSafe("6a") & script.rlike("^([0-9a-fA-F]{2})+$") & (F.length(script) >= 2 * (start + size))
    return F.when(good, F.make_valid_utf8(F.unhex(F.substring(script, 1 + 2 * start, 2 * size)).cast("string")))


def memo_parts(text: Column) -> Column:
    """(action, asset, receiver, limit) of a memo that a liquidity network reads; null for other texts, as are parts that are left out."""
    parts = F.split(text, ":")
    part = lambda at: F.nullif(F.get(parts, F.lit(at)), F.lit(""))
    swap = F.upper(F.get(parts, F.lit(0))).isin("=", "S", "SWAP")
    named = F.when(swap, "swap").otherwise(F.lower(F.get(parts, F.lit(0))))
    known = F.substring(text, 1, 1).isin(*MEMO_STARTS) & (F.length(text) >= 2)
    return F.when(known, F.struct(named.alias("action"), part(1).alias("asset"), part(2).alias("receiver"), part(3).alias("bound")))
