"""Impossible travel, routes and tracks over comparable clocks."""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import haversine_km, kmh, plausible
from ..functions.text import fold_plate, half_up, substrings
from ..params import Clone, Match
from .folds import streamed


def scene_us(df: DataFrame) -> Column:
    """Scene time where a second reading agreed with it, else null."""
    return F.when(F.coalesce(df["corroborated"], F.lit(False)), df["scene_us"])


def clone_confidence(speed: Column, conf_a: Column, conf_b: Column, params: Clone) -> Column:
    strength = F.when(speed.isNull(), params.zero_elapsed_violation).when(speed <= params.max_kmh, 0.0).otherwise(1.0 - params.max_kmh / speed)
    weakest = F.least(F.coalesce(conf_a, F.lit(params.default_plate_conf)), F.coalesce(conf_b, F.lit(params.default_plate_conf)))
    return half_up(F.least(F.lit(params.max_confidence), strength * (0.5 + 0.5 * weakest)), 3)


def newest(sightings: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The newest `limit` rows, which is the scan's own bound, and whether there were more: one row more is asked for."""
    page = sightings.orderBy(F.desc("wall_us"), F.desc("id")).limit(limit + 1)
    truncated = page.count() > limit
    return sightings.orderBy(F.desc("wall_us"), F.desc("id")).limit(limit), truncated


def clones(sightings: DataFrame, cameras: DataFrame, sessions: DataFrame, params: Clone = Clone()) -> DataFrame:
    """Neighbouring sightings of one plate in one session that no vehicle could have made, strongest first by sort.

    Rows are split by plate and session before they are ordered, so a row of another session never comes between.
    Small dimensions join first; the one large shuffle is on (plate, session).
    """
    s = sightings.withColumn("fold", fold_plate(F.col("plate_text"))).withColumn("at", scene_us(sightings))
    s = s.where((F.length("fold") >= params.min_plate_chars) & F.col("at").isNotNull()).join(sessions, "camera_id")
    s = s.join(cameras.select("camera_id", "lat", "lon"), "camera_id", "left")
    row = F.struct("id", "camera_id", "lat", "lon", "at", "plate_text", "plate_conf")
    s = s.withColumn("p", F.lag(row).over(Window.partitionBy("fold", "time_group").orderBy("at", "id")))
    s = s.withColumn("km", haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon")))
    s = s.withColumn("elapsed_s", (F.col("at") - F.col("p.at")) / 1e6)
    s = s.where((F.col("p.camera_id") != F.col("camera_id")) & (F.col("km") > 0) & ~plausible(F.col("km"), F.col("elapsed_s"), params.max_kmh))
    s = s.withColumn("kmh", kmh(F.col("km"), F.col("elapsed_s")))
    s = s.withColumn("confidence", clone_confidence(F.col("kmh"), F.col("p.plate_conf"), F.col("plate_conf"), params))
    shown = F.when(F.upper("p.plate_text") == F.upper("plate_text"), F.upper("plate_text")).otherwise(F.concat(F.upper("p.plate_text"), F.lit(" / "), F.upper("plate_text")))
    reason = F.concat_ws(
        " ", shown, F.lit("at"), "p.camera_id", F.lit("and"), "camera_id", F.format_string("%.1f km and %.0f s apart", "km", "elapsed_s"),
        F.coalesce(F.format_string("imply %.0f km/h", "kmh"), F.lit("in the same second")),
    )
    return s.where(F.col("confidence") >= params.min_confidence).select(
        shown.alias("plate"), "time_group", F.col("p.id").alias("id_a"), F.col("id").alias("id_b"), F.col("p.camera_id").alias("camera_a"),
        F.col("camera_id").alias("camera_b"), "km", "elapsed_s", "kmh", "confidence", reason.alias("reason"),
    )


HOPS = "plate string, place int, id long, time_group string, leg_km double"
ROUTE = (
    "plate string, hops int, unclocked int, other_session int, impossible int, total_km double, duration_s double, time_groups string"
)


class Route:
    """One plate's route: the last accepted sighting and running totals. Emits the hops, or the totals at the end."""

    def __init__(self, max_kmh: float, each_hop: bool):
        self.max_kmh, self.each_hop = max_kmh, each_hop
        self.hops = self.unclocked = self.other_session = self.impossible = 0
        self.km, self.first, self.before, self.sessions = 0.0, None, None, set()

    def row(self, x: dict) -> list[tuple]:
        leg = 0.0
        if x["at"] is None:
            self.unclocked += 1
            return []
        if self.before is not None:
            if self.before["time_group"] != x["time_group"]:
                self.other_session += 1
                return []
            leg = _km(self.before, x)
            if x["at"] <= self.before["at"] or not leg / ((x["at"] - self.before["at"]) / 3.6e9) <= self.max_kmh:
                self.impossible += 1
                return []
        else:
            self.first = x["at"]
        self.hops, self.km, self.before = self.hops + 1, self.km + leg, x
        self.sessions.add(x["time_group"])
        return [(x["plate"], self.hops, x["id"], x["time_group"], leg)] if self.each_hop else []

    def end(self, last: dict) -> list[tuple]:
        if self.each_hop:
            return []
        took = (self.before["at"] - self.first) / 1e6 if self.hops > 1 else 0.0
        groups = ",".join(sorted(g for g in self.sessions if g is not None))
        return [(last["plate"], self.hops, self.unclocked, self.other_session, self.impossible, self.km, took, groups)]


def _km(a: dict, b: dict) -> float:
    if None in (a["lat"], a["lon"], b["lat"], b["lon"]):
        return 0.0
    lat_a, lat_b, lon = radians(a["lat"]), radians(b["lat"]), radians(b["lon"] - a["lon"])
    return 2 * 6371.0 * asin(min(1.0, sqrt(sin((lat_b - lat_a) / 2) ** 2 + cos(lat_a) * cos(lat_b) * sin(lon / 2) ** 2)))


def _route(sightings: DataFrame, cameras: DataFrame, sessions: DataFrame, targets: DataFrame, params: Match, each_hop: bool) -> DataFrame:
    t = targets.select("plate", fold_plate(F.col("plate")).alias("target")).distinct()
    keys = F.array_distinct(F.concat(F.array("target"), substrings(F.col("target"), 4)))
    t = t.select("plate", F.explode(keys).alias("fold"))
    s = sightings.withColumn("fold", fold_plate(F.col("plate_text"))).where("fold <> ''").withColumn("at", scene_us(sightings))
    s = s.join(t, "fold").join(cameras.select("camera_id", "lat", "lon"), "camera_id", "left").join(sessions, "camera_id", "left")
    order = ["order_us", "id", "camera_id", "time_group", "at", "lat", "lon"]
    s = s.select("plate", F.coalesce("at", "wall_us").alias("order_us"), *order[1:])
    return streamed(s, ["plate"], order, lambda: Route(params.max_kmh, each_hop), StructType.fromDDL(HOPS if each_hop else ROUTE))


def routes(sightings: DataFrame, cameras: DataFrame, sessions: DataFrame, targets: DataFrame, params: Match = Match()) -> DataFrame:
    """For each targets.plate: its sightings in time order, each accepted if one vehicle could come from the last
    accepted one. A refused sighting doesn't become the one before. Totals here; `route_hops` has the hops.

    A read fits a target if equal when folded, or of four characters and contained in it: targets are exploded into
    their substrings, so the match is an equi-join. The fold streams over one plate's sightings.
    """
    return _route(sightings, cameras, sessions, targets, params, False)


def route_hops(sightings: DataFrame, cameras: DataFrame, sessions: DataFrame, targets: DataFrame, params: Match = Match()) -> DataFrame:
    """The accepted sightings of `routes`, a row each: plate, place from 1, id, time_group, leg_km."""
    return _route(sightings, cameras, sessions, targets, params, True)


def legs(hops: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Distance from the row before, null at the first or where a place is unknown."""
    w = Window.partitionBy(*by).orderBy(*order)
    return hops.withColumn("leg_km", haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
