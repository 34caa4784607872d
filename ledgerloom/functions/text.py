"""Normalised labels and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least similarity of a fuzzy match.
THRESHOLD = 0.3


def normalized(label: Column) -> Column:
    """Lower case, trimmed, all but digits, ASCII letters, underscores and blanks as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^0-9a-zA-Z_ ]+", " "), " +", " ")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each with two blanks before it and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))
