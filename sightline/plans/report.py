"""The report's sections, the export, and what a client shows of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import registry, report
from ..sources import domain as d
from . import query
from .relational import ALERTS, DAY_US, NOW_US, alerts

DAY = NOW_US - DAY_US
EXPORT_HOURS, EXPORT_ROWS = 72, 200
EVIDENCE = "case when id % 13 = 0 then 'evidence/' || id || '.jpg' end"
ISO = """strftime(make_timestamp(wall_us + 1704067200000000), '%Y-%m-%dT%H:%M:%S') || case when wall_us % 1000000 <> 0 then '.' || lpad((wall_us % 1000000)::varchar, 6, '0') else '' end || '+00:00'"""


def _sightings(spark, sf_dir):
    return d.sightings(spark, sf_dir).withColumn("evidence", F.expr(EVIDENCE))


@query(
    f"""with page as (select s.*, (row_number() over (order by wall_us, id))::int as line, {EVIDENCE} as evidence from sightings s where wall_us >= {NOW_US - EXPORT_HOURS * 3_600_000_000} qualify line <= {EXPORT_ROWS + 1}),
    shown as (
      select line, id::varchar as detection_id, camera_id, c.name as camera_name, c.city, c.lat as latitude, c.lon as longitude, {ISO} as timestamp_utc, pts_ms::double as pts_ms, vehicle_class, colour, plate_text,
        case when plate_conf <> 0 then round(plate_conf, 3) end as plate_confidence, round(confidence, 3) as detection_confidence, evidence from page left join cameras c using (camera_id) where line <= {EXPORT_ROWS}
    ) select * from shown union all by name select line, '# only the first {EXPORT_ROWS} rows of the last {EXPORT_HOURS} h; ask for less to have all' as detection_id from page where line > {EXPORT_ROWS}""",
    d.SIGHTINGS, d.CAMERAS,
)
def csv_export_shape(spark, sf_dir):
    s = report.chosen(_sightings(spark, sf_dir), NOW_US - EXPORT_HOURS * report.HOUR_US)
    return report.export_page(s, d.cameras(spark), d.SINCE_US, EXPORT_ROWS, EXPORT_HOURS)


@query(
    f"""select id as detection_id, wall_us, case when corroborated then 'scene ' || strftime(make_timestamp(scene_us + 1704067200000000), '%H:%M:%S') else 'stream ' || pts_ms // 1000 || ' s' end as clock, camera_id, c.name as camera_name, plate_text,
      case when plate_conf <> 0 then round(plate_conf, 2) end as confidence, colour || ' ' || vehicle_class as vehicle, {EVIDENCE} as evidence
    from sightings left join cameras c using (camera_id) where wall_us >= {DAY} and plate_text is not null and contains(upper(plate_text), 'GJ') and camera_id in ('cam01', 'cam02', 'cam03', 'cam06', 'cam12')
    order by wall_us desc, id desc limit 200""",
    d.SIGHTINGS, d.CAMERAS,
)
def report_plates(spark, sf_dir):
    """The report's section of plates: the day's newest reads, of plates with a text and of cameras named."""
    s = report.chosen(_sightings(spark, sf_dir), DAY, "gj", ["cam01", "cam02", "cam03", "cam06", "cam12"])
    return report.plate_reads(s, d.cameras(spark), d.SINCE_US).orderBy(F.desc("wall_us"), F.desc("detection_id")).limit(200)


@query(
    """select camera_id, name, case when not has_frame then 'down' when mean_luma < 28 then 'black' when mean_luma > 235 then 'overexposed' when banding > 40 then 'corrupt' else 'usable' end
      || ', luma ' || mean_luma::bigint || ', banding ' || banding::bigint as condition from roster where capability = 'degraded'""",
    d.ROSTER,
)
def report_degraded(spark, sf_dir):
    """The report's section of cameras that can't be analysed."""
    return report.degraded(d.roster(spark, sf_dir), registry.frame_state())


@query(
    f"""with k as (select vehicle_class, count(*) as n from sightings group by 1) select count(*) as total, count(plate_text) as plates, count_if(wall_us >= {NOW_US - 300_000_000})::bigint as recent,
      (select string_agg(n || ' ' || vehicle_class, ', ' order by n desc, vehicle_class) from k) as classes, count(*) > 0 and count(plate_text)::double / count(*) < 0.05::double as few_plates from sightings""",
    d.SIGHTINGS,
)
def detection_summary(spark, sf_dir):
    return report.summary(d.sightings(spark, sf_dir), NOW_US)


#: Means of a sighting's channels and the sides of its region; some regions are too small, some are grey.
MEANS = ["(id * 31 % 256)::double as blue", "case when id % 17 <> 0 then (id * 57 % 256)::double end as green", "(user_id * 91 % 256)::double as red", "id % 40 as width", "id % 37 as height"]


def _means(spark, sf_dir):
    s = d.sightings(spark, sf_dir)
    return s.selectExpr("id", *MEANS)


@query(
    f"""with m as (select id, {', '.join(MEANS)} from sightings), refs(place, name, b, g, r) as (values {', '.join(repr((i, *r)) for i, r in enumerate(colour.REFERENCES))}),
    near as (select id, arg_min(name, struct_pack(d := pow(blue - b, 2) + pow(green - g, 2) + pow(red - r, 2), i := place)) as name from m, refs where green is not null and width >= 8 and height >= 8 group by id)
    select id, near.name as colour, case when green is null then blue else 0.114::double * blue + 0.587::double * green + 0.299::double * red end as luma from m left join near using (id)""",
    d.SIGHTINGS,
)
def region_colour(spark, sf_dir):
    """The colour and the brightness of each sighting's region."""
    channels = [F.col(c) for c in ("blue", "green", "red")]
    return _means(spark, sf_dir).select("id", colour.nearest_colour(*channels, F.col("width"), F.col("height")).alias("colour"), colour.luma(*channels).alias("luma"))


@query(
    f"""with {ALERTS} select alert_id, a.camera_id, a.plate, s.plate_text as observed from alerts a left join sightings s on s.id = a.detection_id
    where severity = 'high' and substr(a.camera_id, 4, 2)::int between 1 and 15 and (contains(lower(a.plate), '5o') or contains(lower(coalesce(s.plate_text, '')), '5o'))""",
    d.SIGHTINGS, d.WATCHLIST,
)
def alert_filter(spark, sf_dir):
    """Alerts of a severity and of some cameras, whose plate, watched or read, holds a text."""
    a = alerts(spark, sf_dir).where("severity = 'high'").where(F.col("camera_id").isin([f"cam{i:02d}" for i in range(1, 16)]))
    read = d.sightings(spark, sf_dir).select(F.col("id").alias("detection_id"), F.col("plate_text").alias("observed"))
    holds = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("5o")
    return a.join(read, "detection_id", "left").where(holds("plate") | holds("observed")).select("alert_id", "camera_id", "plate", "observed")


@query(
    f"""with f as (select * from sightings where wall_us >= {NOW_US - 15 * DAY_US} and vehicle_class in ('car', 'bus') and (contains(lower(colour), 're') or contains(lower(vehicle_class), 're')))
    select id, camera_id, vehicle_class, colour, case when confidence <> 0 then round(confidence, 3) end as confidence, {ISO} as at, (select count(*) from f) as total from f order by wall_us desc, id offset 50 limit 50""",
    d.SIGHTINGS,
)
def detection_page(spark, sf_dir):
    """The second page of sightings of some classes whose words hold a text, beside the number of all of them."""
    f = d.sightings(spark, sf_dir).where(f"wall_us >= {NOW_US - 15 * DAY_US} and vehicle_class in ('car', 'bus')")
    f = f.where(F.lower("colour").contains("re") | F.lower("vehicle_class").contains("re"))
    page = f.orderBy(F.desc("wall_us"), "id").offset(50).limit(50).join(F.broadcast(f.agg(F.count("*").alias("total"))))
    return page.select("id", "camera_id", "vehicle_class", "colour", report.nonzero(F.col("confidence"), 3).alias("confidence"), report.iso_utc(F.col("wall_us") + d.SINCE_US).alias("at"), "total")
