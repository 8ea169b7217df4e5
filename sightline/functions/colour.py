"""Colour and brightness of a region by the means of its channels, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference colours of vehicles as (blue, green, red), in the order that decides ties.
REFERENCES = [
    ("white", 200, 200, 200),
    ("silver", 150, 150, 150),
    ("black", 45, 45, 45),
    ("red", 30, 30, 160),
    ("blue", 150, 60, 30),
    ("yellow", 40, 180, 200),
    ("green", 60, 130, 60),
]
# Weights of the channels in ITU-R BT.601.
BT601 = {"blue": 0.114, "green": 0.587, "red": 0.299}


def nearest_colour(blue: Column, green: Column, red: Column, width: Column, height: Column, least: int = 8) -> Column:
    """The reference nearest by Euclidean distance; null for regions under `least` pixels a side or without means."""
    def apart(ref) -> Column:
        return sum((c - v) * (c - v) for c, v in zip((blue, green, red), ref[1:], strict=True))

    ranked = F.array(*[F.struct(apart(r).alias("d"), F.lit(i).alias("i"), F.lit(r[0]).alias("name")) for i, r in enumerate(REFERENCES)])
    seen = (width >= least) & (height >= least) & blue.isNotNull() & green.isNotNull() & red.isNotNull()
    return F.when(seen, F.array_min(ranked)["name"])


def luma(blue: Column, green: Column, red: Column) -> Column:
    """Mean brightness; of one channel alone its mean, of none 0."""
    grey = F.coalesce(blue, F.lit(0.0)).cast("double")
    return F.when(green.isNull() | red.isNull(), grey).otherwise(BT601["blue"] * blue + BT601["green"] * green + BT601["red"] * red)
