"""Values in a chain's unit with their worth in fiat currencies, held in the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of one coin, by kind of chain.
COIN = {"utxo": 10**8, "account": 10**18, "tron": 10**6}


def utxo_fiat(value: Column, rates: Column) -> Column:
    """Fiat values of a UTXO amount: half a cent and more rounds up."""
    return F.transform(rates, lambda rate: (F.floor(value * rate / F.lit(1e6) + F.lit(0.5)) / F.lit(100.0)).cast("double"))


def account_fiat(value: Column, rates: Column, coin: float) -> Column:
    """Fiat values of an account chain's amount, not rounded."""
    return F.transform(rates, lambda rate: (value.cast("double") * rate / F.lit(float(coin))).cast("double"))


def pegged_rates(native: Column, own: Column, peg: Column) -> Column:
    """Rates [EUR, USD] of a token: of the currency it is pegged to, else its own, else zeros.

    A token on the dollar is worth 1 USD and EUR/USD euros, and the other way round; one on
    the native coin has the coin's rates. A missing or zero rate gives 0, not an error.
    """
    eur, usd = F.get(native, F.lit(0)), F.get(native, F.lit(1))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        F.when(peg == "usd", F.array(over(eur, usd), F.lit(1.0)))
        .when(peg == "eur", F.array(F.lit(1.0), over(usd, eur)))
        .when(peg == "native", native)
        .otherwise(F.coalesce(own, F.array(F.lit(0.0), F.lit(0.0))))
    )


def sums(value: str, fiat: str, n: int, suffix: str = "") -> list[Column]:
    """Aggregates of an amount and of each of its ``n`` fiat values."""
    parts = [F.coalesce(F.sum(F.get(fiat, F.lit(i))), F.lit(0.0)) for i in range(n)]
    return [F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(f"value{suffix}"), F.array(*parts).alias(f"fiat_values{suffix}")]


def currency(value: Column, fiat: Column) -> Column:
    return F.struct(value.alias("value"), fiat.alias("fiat_values"))


def zero_currency(n: int) -> Column:
    return currency(F.lit(0).cast("long"), F.array(*[F.lit(0.0)] * n))


def or_zero(value: Column, n: int) -> Column:
    return F.coalesce(value, zero_currency(n))


def sum_by_place(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Element-wise sums of an array column of any width."""
    each = df.select(*keys, F.posexplode(values).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_all"))
    return rows.select(*keys, F.transform("_all", lambda x: x["_v"]).alias(values))


def fiat_names(rates: DataFrame, column: str = "fiat_values") -> list[str]:
    """The currencies of a table of rate maps, which have to be the same in every row."""
    found = rates.select(F.map_keys(column).alias("k")).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("rates have no, or not the same, currencies" if not found else "rates differ in their currencies")
    return list(found[0].k)
