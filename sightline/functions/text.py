"""Plate and text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CONFUSED, FOLDED


def clean_plate(c: Column) -> Column:
    """Upper case, letters and digits only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def fold_plate(c: Column) -> Column:
    """clean_plate with confusable letters turned into the digits they are read as."""
    return F.translate(clean_plate(c), CONFUSED, FOLDED)


def grams(c: Column, q: int) -> Column:
    """Distinct q-character windows of a string, none if it is shorter."""
    n = F.length(c)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - (q - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(n >= q, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def substrings(c: Column, least: int) -> Column:
    """Distinct substrings of at least `least` characters."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    every = F.flatten(
        F.transform(starts, lambda i: F.transform(starts, lambda k: F.when(k + i - 1 <= n, F.substring(c, i, k))))
    )
    return F.array_distinct(F.filter(every, lambda s: s.isNotNull() & (F.length(s) >= least)))


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def squeezed(c: Column) -> Column:
    """Lower-case a-z and 0-9 alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def trigrams(c: Column) -> Column:
    s = squeezed(c)
    return F.when(F.length(s) >= 3, grams(s, 3)).when(s != "", F.array(s)).otherwise(F.array().cast("array<string>"))


def redact_url(c: Column) -> Column:
    """Drops user:password@ of a url; paths pass."""
    return F.regexp_replace(c, r"^([A-Za-z][\w+.\-]*://)[^/]*@", "$1")


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def masked(c: Column) -> Column:
    return F.when(F.length(c) < 4, c).otherwise(F.concat(F.substring(c, 1, 2), F.lit("…"), F.substring(c, -2, 2)))


def severity_rank(c: Column, unknown: int = 1) -> Column:
    rank = F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2).when(c == "critical", 3)
    return rank.otherwise(unknown)


def half_up(c: Column, digits: int) -> Column:
    """Rounds halves up on the double itself, so that other engines can give the same value."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale
