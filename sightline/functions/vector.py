"""Vectors as arrays, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in array order; 0 where one is null, empty or of another length."""
    zero = F.lit(0.0)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(zero)


def usable(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0)


def attribute_delta(body_a: Column, body_b: Column, colour_a: Column, colour_b: Column, bonus: float, penalty: float) -> Column:
    """-penalty if a known attribute differs, bonus if both are known and agree, else null."""
    known = lambda x, y: x.isNotNull() & y.isNotNull() & (x != "unknown") & (y != "unknown") & (x != "") & (y != "")
    body, colour = F.coalesce(known(body_a, body_b), F.lit(False)), F.coalesce(known(colour_a, colour_b), F.lit(False))
    differs = (body & (body_a != body_b)) | (colour & (colour_a != colour_b))
    return F.when(differs, -penalty).when(body & colour, bonus)
