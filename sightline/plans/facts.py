"""What is known of one entity or one day, as rows and as a sentence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import domain as d
from . import query
from .relational import ALERTS, DAY_US, NOW_US, ZONE_EVENTS, alerts, zone_events


@query(
    f"""with {ALERTS}, seen as (select plate_text, count(*) as n from sightings group by 1), raised as (select entry_id, count(*) as n from alerts group by 1)
    select w.entry_id, w.plate, category, severity, active, coalesce(s.n, 0) as sightings, coalesce(r.n, 0) as alerts,
      'Watchlist entry ' || w.entry_id || ' - ' || w.plate || ', ' || category || ' (' || severity || '). ' || coalesce(s.n, 0) || ' sighting(s) recorded, ' || coalesce(r.n, 0) || ' alert(s) raised.' as fact
    from watchlist w left join seen s on s.plate_text = w.plate left join raised r on r.entry_id = w.entry_id""",
    d.SIGHTINGS, d.WATCHLIST,
)
def watchlist_facts(spark, sf_dir):
    seen = d.sightings(spark, sf_dir).groupBy("plate_text").agg(F.count("*").alias("sightings"))
    raised = alerts(spark, sf_dir).groupBy("entry_id").agg(F.count("*").alias("alerts"))
    w = d.watchlist(spark, sf_dir).select("entry_id", "plate", "category", "severity", "active")
    out = w.join(seen, F.col("plate") == F.col("plate_text"), "left").join(raised, "entry_id", "left").drop("plate_text").fillna(0, ["sightings", "alerts"])
    return out.withColumn("fact", F.format_string("Watchlist entry %d - %s, %s (%s). %d sighting(s) recorded, %d alert(s) raised.", "entry_id", "plate", "category", "severity", "sightings", "alerts"))


@query(
    f"""with {ZONE_EVENTS}, rules as (select substr(camera_id, 4, 2)::int as rule_id, camera_id, name from cameras)
    select r.rule_id, r.camera_id, count(z.event_id) as events, max(z.wall_us) as last_us, count(z.event_id) filter (not z.acknowledged) as open,
      'Zone ' || r.rule_id || ' on ' || r.name || ': ' || count(z.event_id) || ' event(s) triggered.' as fact
    from rules r left join zone_events z on z.rule_id = r.rule_id group by r.rule_id, r.camera_id, r.name""",
    d.SIGHTINGS, d.CAMERAS,
)
def zone_facts(spark, sf_dir):
    z = zone_events(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("events"), F.max("wall_us").alias("last_us"), F.count_if(~F.col("acknowledged")).alias("open"))
    rules = d.cameras(spark).select(F.substring("camera_id", 4, 2).cast("int").alias("rule_id"), "camera_id", "name")
    out = rules.join(z, "rule_id", "left").fillna(0, ["events", "open"])
    return out.select("rule_id", "camera_id", "events", "last_us", "open", F.format_string("Zone %d on %s: %d event(s) triggered.", "rule_id", "name", "events").alias("fact"))


@query(
    """select id as detection_id, s.camera_id, case when corroborated then scene_us else wall_us end as at_us, case when corroborated then scene_us end as scene_us, plate_text,
      'Detection ' || id || ' - a ' || coalesce(colour, 'colour-unknown') || ' ' || vehicle_class || ' on ' || coalesce(name, s.camera_id) || '.' as fact
    from sightings s left join cameras c using (camera_id)""",
    d.SIGHTINGS, d.CAMERAS,
)
def vehicle_facts(spark, sf_dir):
    s = d.sightings(spark, sf_dir).join(F.broadcast(d.cameras(spark).select("camera_id", "name")), "camera_id", "left")
    what = F.concat(F.lit("Detection "), "id", F.lit(" - a "), F.coalesce("colour", F.lit("colour-unknown")), F.lit(" "), "vehicle_class", F.lit(" on "), F.coalesce("name", "camera_id"), F.lit("."))
    at = F.when(F.col("corroborated"), F.col("scene_us"))
    return s.select(F.col("id").alias("detection_id"), "camera_id", F.coalesce(at, "wall_us").alias("at_us"), at.alias("scene_us"), "plate_text", what.alias("fact"))


@query(
    f"""with {ALERTS} select alert_id, camera_id, plate, severity, (row_number() over (order by wall_us desc, alert_id desc))::int as place, (select count(*) from alerts where not acknowledged) as open
    from alerts where not acknowledged qualify place <= 10""",
    d.SIGHTINGS, d.WATCHLIST,
)
def open_alerts_newest(spark, sf_dir):
    """The ten newest open alerts beside the number of all open ones."""
    from pyspark.sql import Window

    found = alerts(spark, sf_dir).where("not acknowledged")
    total = found.agg(F.count("*").alias("open"))
    order = [F.desc("wall_us"), F.desc("alert_id")]
    page = found.orderBy(*order).limit(10).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return page.join(F.broadcast(total)).select("alert_id", "camera_id", "plate", "severity", "place", "open")


DAY = f"wall_us >= {NOW_US - DAY_US}"


@query(
    f"""with {ALERTS} select coalesce(category, 'all') as category, coalesce(severity, 'all') as severity, count(*) as n, count_if(acknowledged)::bigint as acknowledged, round(max(score), 6) as best
    from alerts where {DAY} group by grouping sets ((category, severity), ())""",
    d.SIGHTINGS, d.WATCHLIST,
)
def report_alerts(spark, sf_dir):
    """The report's section of alerts: the day's, by category and severity, and in all."""
    day = alerts(spark, sf_dir).where(DAY)
    sums = [F.count("*").alias("n"), F.count_if("acknowledged").alias("acknowledged"), F.round(F.max("score"), 6).alias("best")]
    parts = day.groupBy("category", "severity").agg(*sums)
    return parts.unionByName(day.agg(*sums).select(F.lit("all").alias("category"), F.lit("all").alias("severity"), "n", "acknowledged", "best"))


@query(
    f"""with {ZONE_EVENTS} select c.name as camera_name, rule_id, vehicle_class, count(*) as n, count_if(acknowledged)::bigint as acknowledged, max(wall_us) as last_us
    from zone_events join cameras c using (camera_id) where {DAY} group by all""",
    d.SIGHTINGS, d.CAMERAS,
)
def report_zones(spark, sf_dir):
    """The report's section of zone events: the day's, by rule and class."""
    z = zone_events(spark, sf_dir).where(DAY).groupBy("camera_id", "rule_id", "vehicle_class")
    z = z.agg(F.count("*").alias("n"), F.count_if("acknowledged").alias("acknowledged"), F.max("wall_us").alias("last_us"))
    return z.join(F.broadcast(d.cameras(spark).select("camera_id", F.col("name").alias("camera_name"))), "camera_id").drop("camera_id")


@query(
    f"""select coalesce(c.city, 'location unknown') as city, c.capability, count(distinct c.camera_id) as cameras, count(distinct s.camera_id) as seen, count(s.id) as detections
    from cameras c left join (select * from sightings where {DAY}) s using (camera_id) group by all""",
    d.SIGHTINGS, d.CAMERAS,
)
def report_coverage(spark, sf_dir):
    """The report's section of coverage: cameras by city and capability, those that saw anything in the day, and how much."""
    s = d.sightings(spark, sf_dir).where(DAY).groupBy("camera_id").agg(F.count("*").alias("k"))
    c = d.cameras(spark).join(s, "camera_id", "left")
    return c.groupBy(F.coalesce("city", F.lit("location unknown")).alias("city"), "capability").agg(
        F.count("*").alias("cameras"), F.count("k").alias("seen"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("detections")
    )
