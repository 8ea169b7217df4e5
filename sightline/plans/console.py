"""What an operator's console shows: labels, joined rosters, bands, edits and notices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import captions as cap
from ..functions.text import severity_rank
from ..operators import registry, traffic
from ..sources import domain as d
from ..sources import sinks
from ..sources.storage import stored
from . import query
from .movement import ASSESS, BUCKETS, NORMS, _buckets
from .relational import ALERTS, NOW_US, ZONE_EVENTS, alerts
from .text import CAPTIONS, captions
from .vision import FRAMES, frames


def newest(buckets, hours):
    """Rows of the last hours that there are; the last bucket is one number."""
    return buckets.join(F.broadcast(buckets.agg(F.max("bucket").alias("last"))), F.col("bucket") > F.col("last") - hours).drop("last")


@query(
    """select id, case when corroborated then 'scene ' || strftime(make_timestamp(scene_us + 1704067200000000), '%H:%M:%S') else 'T+' || (pts_ms // 1000)::varchar || 's' end as label from sightings""",
    d.SIGHTINGS,
)
def time_label(spark, sf_dir):
    at = F.date_format(F.timestamp_micros(F.col("scene_us") + d.SINCE_US), "HH:mm:ss")
    label = F.when(F.col("corroborated"), F.concat(F.lit("scene "), at)).otherwise(F.concat(F.lit("T+"), F.expr("pts_ms div 1000"), F.lit("s")))
    return d.sightings(spark, sf_dir).select("id", label.alias("label"))


@query(
    """select c.camera_id, c.name, case when capability = 'degraded' then 'degraded' when not live then 'not-started' when not connected or stale_s is null or stale_s > 30 then 'offline' when stale_s > 5 or dark then 'degraded' else 'online' end as state,
      s.last_us, dark as is_dark from cameras c left join (select camera_id, max(wall_us) as last_us from sightings where user_id % 2 = 0 group by 1) s using (camera_id)""",
    d.SIGHTINGS, d.CAMERAS,
)
def roster_health(spark, sf_dir):
    last = d.sightings(spark, sf_dir).where("user_id % 2 = 0").groupBy("camera_id").agg(F.max("wall_us").alias("last_us"))
    return d.cameras(spark).join(last, "camera_id", "left").select("camera_id", "name", registry.health().alias("state"), "last_us", F.col("dark").alias("is_dark"))


@query(
    f"""with {NORMS} select b.camera_id, b.bucket, b.total, case when samples >= 5 then round(greatest(0, mean - 2 * greatest(stdev, 1)), 6) end as low, case when samples >= 5 then round(mean + 2 * greatest(stdev, 1), 6) end as high
    from buckets b left join norms n on n.camera_id = b.camera_id and n.hour = b.hour where b.bucket > (select max(bucket) - 48 from buckets)""",
    d.SIGHTINGS, d.CAMERAS,
)
def band_series(spark, sf_dir):
    b = _buckets(spark, sf_dir)
    out = newest(b, 48).join(traffic.band(traffic.learn(b)), ["camera_id", "hour"], "left")
    return out.select("camera_id", "bucket", "total", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"with {BUCKETS} select camera_id, count(*) as buckets, sum(total)::bigint as total, max(total) as busiest, count_if(total = 0)::bigint as idle from buckets group by 1", d.SIGHTINGS, d.CAMERAS)
def chart_summary(spark, sf_dir):
    return _buckets(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("buckets"), F.sum("total").alias("total"), F.max("total").alias("busiest"), F.count_if(F.col("total") == 0).alias("idle"))


@query(f"with {ASSESS} select status, count(*) as n from judged where bucket > (select max(bucket) - 24 from judged) group by 1", d.SIGHTINGS, d.CAMERAS)
def status_counts(spark, sf_dir):
    b = _buckets(spark, sf_dir)
    return traffic.assess(newest(b, 24), traffic.learn(b)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""with {FRAMES}, a as (select *, (x2 - x1) * (y2 - y1) as area, hour // 24 as day from frames) select camera_id, day, id, area from a qualify row_number() over (partition by camera_id, day order by area desc, id) = 1""",
    d.SIGHTINGS,
)
def largest_vehicle(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).withColumn("day", F.expr("hour div 24"))
    best = f.groupBy("camera_id", "day").agg(F.max_by(F.struct("id", "area"), F.struct("area", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("camera_id", "day", "b.id", "b.area")


@query(f"with {CAPTIONS} select id, (body_type <> 'unknown')::int + (colour is not null)::int + (markings <> '')::int + (damage <> '')::int >= 2 or len(string_split(trim(caption), ' ')) >= 2 as worth from caps join fields using (caption)")
def worth_indexing(spark, sf_dir):
    return cap.with_attributes(captions(spark, sf_dir)).select("id", cap.worth_indexing().alias("worth"))


@query(
    f"""with {ALERTS} select alert_id, '[' || upper(severity) || '] ' || plate || ' seen at ' || camera_id as subject, case severity when 'high' then 2 else 3 end as rank from alerts where severity in ('high', 'critical')""",
    d.SIGHTINGS, d.WATCHLIST,
)
def notice_list(spark, sf_dir):
    return sinks.notices(alerts(spark, sf_dir)).select("alert_id", "subject", severity_rank(F.col("severity")).alias("rank"))


@query(
    f"""with {ALERTS} select alert_id, acknowledged or alert_id in (select min(alert_id) from alerts group by plate) as acknowledged from alerts""",
    d.SIGHTINGS, d.WATCHLIST,
)
def acknowledge_update(spark, sf_dir):
    a = stored(alerts(spark, sf_dir).select("alert_id", "plate", "acknowledged"), "alerts")  # read twice
    return registry.acknowledge(a, a.groupBy("plate").agg(F.min("alert_id").alias("alert_id")).select("alert_id")).select("alert_id", "acknowledged")


@query(
    """with n as (select entry_id, plate, category from watchlist where entry_id % 2 = 0 union all select 900000 + entry_id, upper(replace(' gj 01 ' || entry_id, ' ', '')), 'wanted' from watchlist where entry_id % 3 = 0) select * from n where entry_id % 10 <> 4""",
    d.WATCHLIST,
)
def watchlist_edit(spark, sf_dir):
    w = d.watchlist(spark, sf_dir).select("entry_id", "plate", "category")
    new = w.where("entry_id % 3 = 0").select((F.col("entry_id") + 900000).alias("entry_id"), F.concat(F.lit(" gj 01 "), "entry_id").alias("plate"), F.lit("wanted").alias("category"))
    gone = w.where("entry_id % 2 <> 0").select("entry_id").union(w.where("entry_id % 10 = 4").select("entry_id")).union(new.where("entry_id % 10 = 4").select("entry_id"))
    return registry.edit_watchlist(w, new, gone)


@query(
    f"""with {ALERTS}, {ZONE_EVENTS} select s.camera_id, s.id, s.vehicle_class, case when a.detection_id is not null then 'alert' when z.event_id is not null then 'zone' else 'none' end as evidence
    from (select * from sightings where wall_us >= {NOW_US} - 259200000000 and vehicle_class in ('car', 'bus')) s left join (select distinct detection_id from alerts) a on a.detection_id = s.id left join zone_events z on z.event_id = s.id""",
    d.SIGHTINGS, d.WATCHLIST,
)
def evidence_kind(spark, sf_dir):
    s = d.sightings(spark, sf_dir).where(f"wall_us >= {NOW_US} - 259200000000 and vehicle_class in ('car', 'bus')")
    a = alerts(spark, sf_dir).select(F.col("detection_id").alias("id")).distinct().withColumn("a", F.lit(True))
    z = s.where("x1 < 425 and y1 < 225").select("id").withColumn("z", F.lit(True))
    kind = F.when(F.col("a"), "alert").when(F.col("z"), "zone").otherwise("none")
    return s.join(a, "id", "left").join(z, "id", "left").select("camera_id", "id", "vehicle_class", kind.alias("evidence"))


@query(
    f"""with {FRAMES} select camera_id, hour // 24 as day, sum(case when rn <= 3 then 1 else 0 end)::bigint as admitted, sum(case when rn > 3 then 1 else 0 end)::bigint as denied
    from (select *, row_number() over (partition by hour // 24 order by id) as rn from (select camera_id, hour, min(id) as id from frames group by camera_id, hour // 24, hour)) group by all""",
    d.SIGHTINGS,
)
def escalation_slots(spark, sf_dir):
    f = frames(spark, sf_dir).groupBy("camera_id", "hour").agg(F.min("id").alias("id")).withColumn("day", F.expr("hour div 24"))
    rn = F.row_number().over(Window.partitionBy("day").orderBy("id"))
    f = f.withColumn("ok", (rn <= 3).cast("long"))
    return f.groupBy("camera_id", "day").agg(F.sum("ok").alias("admitted"), F.sum(1 - F.col("ok")).alias("denied"))


