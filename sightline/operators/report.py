"""The operational report and the export of sightings, as DataFrames that a sink writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Report

HOUR_US = 3_600_000_000


def iso_utc(us: Column) -> Column:
    """Microseconds since 1970 as ISO text in UTC; a fraction only where there is one."""
    part = F.pmod(us, F.lit(1_000_000))
    seconds = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(seconds, F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def nonzero(c: Column, digits: int) -> Column:
    """Rounded; null where missing or zero, as a confidence of zero means none."""
    return F.when(c != 0, F.round(c, digits))


def chosen(sightings: DataFrame, since_us: int, plate: str | None = None, cameras: list[str] | None = None) -> DataFrame:
    """Sightings from since_us on, of plates that hold a text in any case, of the cameras named."""
    s = sightings.where(F.col("wall_us") >= since_us)
    if plate:
        s = s.where(F.upper("plate_text").contains(plate.upper()))
    return s.where(F.col("camera_id").isin(cameras)) if cameras else s


def export_page(sightings: DataFrame, cameras: DataFrame, epoch_us: int, limit: int, hours: int) -> DataFrame:
    """The oldest `limit` rows in 14 columns, with `line` from 1; a last line says so where rows were left out.

    The page is cut before it meets the roster. Missing values are null, which the CSV sink writes as empty text;
    cameras that the roster lacks keep their rows.
    """
    page = sightings.orderBy("wall_us", "id").limit(limit + 1)
    lined = page.withColumn("line", F.row_number().over(Window.orderBy("wall_us", "id")))  # of limit + 1 rows
    place = cameras.select("camera_id", F.col("name").alias("camera_name"), "city", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    rows = lined.join(place, "camera_id", "left")
    columns = {
        "detection_id": F.col("id").cast("string"), "camera_id": F.col("camera_id"), "camera_name": F.col("camera_name"), "city": F.col("city"), "latitude": F.col("latitude"), "longitude": F.col("longitude"),
        "timestamp_utc": iso_utc(F.col("wall_us") + epoch_us), "pts_ms": F.round(F.col("pts_ms").cast("double"), 1), "vehicle_class": F.col("vehicle_class"), "colour": F.col("colour"), "plate_text": F.col("plate_text"),
        "plate_confidence": nonzero(F.col("plate_conf"), 3), "detection_confidence": F.round("confidence", 3), "evidence": F.col("evidence"),
    }
    keep = F.col("line") <= limit
    cut = F.lit(f"# only the first {limit} rows of the last {hours} h; ask for less to have all")
    return rows.select("line", *[F.when(keep, v).otherwise(cut if c == "detection_id" else None).alias(c) for c, v in columns.items()])


def plate_reads(sightings: DataFrame, cameras: DataFrame, epoch_us: int) -> DataFrame:
    """Reads of plates with the clock they go by: the scene's where corroborated, else the stream's."""
    scene = F.date_format(F.timestamp_micros(F.col("scene_us") + epoch_us), "HH:mm:ss")
    clock = F.when(F.col("corroborated"), F.concat(F.lit("scene "), scene)).otherwise(F.concat(F.lit("stream "), F.expr("pts_ms div 1000"), F.lit(" s")))
    vehicle = F.concat_ws(" ", "colour", "vehicle_class")
    named = cameras.select("camera_id", F.col("name").alias("camera_name"))
    return sightings.where("plate_text is not null").join(named, "camera_id", "left").select(
        F.col("id").alias("detection_id"), "wall_us", clock.alias("clock"), "camera_id", "camera_name", "plate_text", nonzero(F.col("plate_conf"), 2).alias("confidence"), vehicle.alias("vehicle"), "evidence"
    )


def degraded(cameras: DataFrame, condition: Column) -> DataFrame:
    """Cameras that can't be analysed, with what was measured."""
    measured = F.concat(condition, F.lit(", luma "), F.round("mean_luma").cast("long"), F.lit(", banding "), F.round("banding").cast("long"))
    return cameras.where("capability = 'degraded'").select("camera_id", "name", measured.alias("condition"))


def summary(sightings: DataFrame, now_us: int, recent_us: int = 300_000_000, low_yield: float = 0.05) -> DataFrame:
    """One row: sightings in all, with a plate and of the last minutes, classes by count, and whether few plates can be
    read. Counted by class first, so that one row a class meets the last step."""
    parts = sightings.groupBy("vehicle_class").agg(F.count("*").alias("n"), F.count("plate_text").alias("plates"), F.count_if(F.col("wall_us") >= now_us - recent_us).alias("recent"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "vehicle_class", "n")))
    out = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(o) for c, o in (("n", "total"), ("plates", "plates"), ("recent", "recent"))], ordered.alias("classes"))
    told = F.array_join(F.transform("classes", lambda c: F.concat(c["n"], F.lit(" "), F.coalesce(c["vehicle_class"], F.lit("unknown")))), ", ")
    few = (F.col("total") > 0) & (F.col("plates") / F.greatest("total", F.lit(1)) < low_yield)
    return out.select("total", "plates", "recent", told.alias("classes"), few.alias("few_plates"))


def sections(sightings: DataFrame, alerts: DataFrame, zone_events: DataFrame, cameras: DataFrame, condition: Column, now_us: int, epoch_us: int, plate: str | None = None, only: list[str] | None = None, params: Report = Report()) -> dict[str, DataFrame]:
    """The six sections by title, ordered, for `sinks.html_report` with `params.limits`. The filters by plate and camera
    hold for the section of plates alone."""
    since = now_us - params.hours * HOUR_US
    day = chosen(sightings, since)
    named = cameras.select("camera_id", F.col("name").alias("camera_name"))
    activity = day.groupBy("camera_id").agg(F.count("*").alias("detections")).join(named, "camera_id", "left")
    return {
        "Summary": summary(day, now_us),
        "Plates": plate_reads(chosen(sightings, since, plate, only), cameras, epoch_us).orderBy(F.desc("wall_us"), F.desc("detection_id")),
        "Alerts": alerts.where(F.col("wall_us") >= since).join(named, "camera_id", "left").orderBy(F.desc("wall_us"), F.desc("alert_id")),
        "Zone events": zone_events.where(F.col("wall_us") >= since).join(named, "camera_id", "left").orderBy(F.desc("wall_us"), F.desc("event_id")),
        "Activity": activity.orderBy(F.desc("detections"), "camera_id"),
        "Degraded cameras": degraded(cameras, condition).orderBy("camera_id"),
    }
