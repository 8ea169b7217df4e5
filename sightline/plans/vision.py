"""Sequences of one camera: epochs, sampling, clocks, tracks, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vision
from ..params import Dark
from ..sources import domain as d
from . import query
from .relational import ALERTS, alerts

FRAMES = "frames as (select id, id as seq, camera_id, pts_ms, wall_us // 3600000000 as hour, user_id as track_id, vehicle_class, x1, y1, x2, y2, (x1 + x2)::double / 2 as cx, (y1 + y2)::double / 2 as cy, wall_us // 600000000 as frame, wall_us // 1000 as wall_ms from sightings)"


def frames(spark, sf_dir):
    s = d.sightings(spark, sf_dir)
    return s.select(
        "id", F.col("id").alias("seq"), "camera_id", "pts_ms", F.expr("wall_us div 3600000000").alias("hour"), "track_id", "vehicle_class", "x1", "y1", "x2", "y2",
        ((F.col("x1") + F.col("x2")) / 2.0).alias("cx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"), F.expr("wall_us div 600000000").alias("frame"), F.expr("wall_us div 1000").alias("wall_ms"),
    )


EPOCHS = """cuts as (select *, coalesce(pts_ms + 2000 < lag(pts_ms) over (partition by camera_id order by seq), false) as cut from frames),
    epochs as (select *, (sum(cut::int) over (partition by camera_id order by seq))::bigint as epoch from cuts)"""


@query(f"with {FRAMES}, {EPOCHS} select id, camera_id, cut, epoch from epochs", d.SIGHTINGS)
def loop_epochs(spark, sf_dir):
    days = frames(spark, sf_dir).withColumn("day", F.expr("hour div 24"))
    return vision.epochs_in_parts(days, "day").select("id", "camera_id", "cut", "epoch")


@query(
    f"""with {FRAMES}, {EPOCHS}, e as (select camera_id, epoch, max(pts_ms) as longest from epochs group by all)
    select camera_id, case when max(epoch) >= 2 then max(case when epoch = 1 then longest end) end as loop_ms from e group by 1""",
    d.SIGHTINGS,
)
def loop_length(spark, sf_dir):
    return vision.loop_length(vision.epochs(frames(spark, sf_dir)))


@query(
    f"""with {FRAMES}, {EPOCHS} select id, case when count(*) over w >= 10 and last(pts_ms) over w > first(pts_ms) over w then round((count(*) over w - 1) / ((last(pts_ms) over w - first(pts_ms) over w)::double / 1000), 9) end as fps
    from epochs window w as (partition by camera_id, epoch order by seq rows between 59 preceding and current row)""",
    d.SIGHTINGS,
)
def measured_fps(spark, sf_dir):
    f = vision.measured_fps(vision.epochs(frames(spark, sf_dir)), ["camera_id", "epoch"])
    return f.select("id", F.round("fps", 9).alias("fps"))


@query(
    f"""with recursive {FRAMES}, {EPOCHS}, o as (select *, row_number() over (partition by camera_id, epoch order by pts_ms, id) as rn from epochs),
    walk(camera_id, epoch, rn, id, pts_ms, sent, keep) as (
      select camera_id, epoch, rn, id, pts_ms, pts_ms, true from o where rn = 1
      union all
      select o.camera_id, o.epoch, o.rn, o.id, o.pts_ms, case when o.pts_ms - w.sent >= 300000 then o.pts_ms else w.sent end, o.pts_ms - w.sent >= 300000
      from walk w join o on o.camera_id = w.camera_id and o.epoch = w.epoch and o.rn = w.rn + 1
    ) select camera_id, epoch, id, pts_ms from walk where keep""",
    d.SIGHTINGS,
)
def pts_sampling(spark, sf_dir):
    return vision.sampled(vision.epochs(frames(spark, sf_dir)), ["camera_id", "epoch"], 300_000)


@query(
    f"""with recursive {ALERTS}, o as (select *, row_number() over (partition by plate order by wall_us, alert_id) as rn from alerts where severity in ('high', 'critical')),
    walk(plate, rn, alert_id, wall_us, sent, keep) as (
      select plate, rn, alert_id, wall_us, wall_us, true from o where rn = 1
      union all
      select o.plate, o.rn, o.alert_id, o.wall_us, case when o.wall_us - w.sent >= 86400000000 then o.wall_us else w.sent end, o.wall_us - w.sent >= 86400000000
      from walk w join o on o.plate = w.plate and o.rn = w.rn + 1
    ) select plate, alert_id, wall_us from walk where keep""",
    d.SIGHTINGS, d.WATCHLIST,
)
def alert_cooldown(spark, sf_dir):
    severe = alerts(spark, sf_dir).where("severity in ('high', 'critical')")
    return vision.cooled(severe, "plate", 86_400_000_000)  # a day, as the test feed is thin


@query(
    """with r as (select id, camera_id, wall_us // 3600000000 as hour, pts_ms, pts_ms // 1000 + case when id % 4 = 0 then 50 else id % 3 end + (wall_us // 3600000000) * 3600 as seconds from sightings where corroborated),
    l as (select *, lag(seconds) over w + (pts_ms - lag(pts_ms) over w)::double / 1000 as expected from r window w as (partition by camera_id, hour order by pts_ms, id))
    select id, coalesce(abs(seconds - expected) <= 2.5::double, false) as anchors from l""",
    d.SIGHTINGS,
)
def clock_corroborate(spark, sf_dir):
    r = d.sightings(spark, sf_dir).where("corroborated").selectExpr(
        "id", "camera_id", "wall_us div 3600000000 as hour", "pts_ms",
        "pts_ms div 1000 + case when id % 4 = 0 then 50 else id % 3 end + (wall_us div 3600000000) * 3600 as seconds",
    )
    return vision.corroborated(r, ["camera_id", "hour"]).select("id", "anchors")


@query(
    """with f as (select camera_id, id as seq, case when id % 400 < 300 then 10 else 60 end as luma, case when id % 97 = 0 then 1 else 0 end as found from sightings),
    k as (select *, luma < 18 and found = 0 as dark, sum((not (luma < 18 and found = 0))::int) over (partition by camera_id order by seq) as island from f)
    select camera_id, min(seq) as first, max(seq) as last, count(*) as frames from k where dark group by camera_id, island having count(*) >= 5""",
    d.SIGHTINGS,
)
def dark_streaks(spark, sf_dir):
    f = d.sightings(spark, sf_dir).selectExpr(
        "camera_id", "id as seq", "case when id % 400 < 300 then 10 else 60 end as luma", "case when id % 97 = 0 then 1 else 0 end as found", "wall_us div 86400000000 as day"
    )
    return vision.dark_streaks_in_parts(f, "day", params=Dark(streak=5))


@query(
    f"""with {FRAMES}, h as (select *, y2 - y1 as h, (x2 - x1) * (y2 - y1) as area, hour // 48 as fr from frames)
    select id, h >= 64 and row_number() over (partition by camera_id, fr, h >= 64 order by area desc, id) <= 8 as embed, h >= 110 and row_number() over (partition by camera_id, fr, h >= 110 order by h desc, id) <= 4 as read_plate from h""",
    d.SIGHTINGS,
)
def frame_top_n(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("frame", F.expr("hour div 48"))
    return vision.top_of_frame(f).select("id", "embed", "read_plate")


SHAPE = """shape as (
      select camera_id, track_id, hour // 24 as day, count(*) as sightings, (max(pts_ms) - min(pts_ms))::double / 1000 as dwell_s,
        last(cx order by id) - first(cx order by id) as dx, last(cy order by id) - first(cy order by id) as dy, last(vehicle_class order by id) as vehicle_class from frames group by all
    ), way as (select *, case when sightings < 2 or sqrt(dx * dx + dy * dy) < 40 then null when abs(dx) > abs(dy) then case when dx > 0 then 'right' else 'left' end when dy > 0 then 'down' else 'up' end as direction from shape)"""


def _shape(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("day", F.expr("hour div 24"))
    return vision.track_shape(f, ["camera_id", "track_id", "day"], ["id"])


@query(f"with {FRAMES}, {SHAPE} select camera_id, direction, count(*) as n from way where direction is not null group by all", d.SIGHTINGS)
def direction_histogram(spark, sf_dir):
    return _shape(spark, sf_dir).where("direction is not null").groupBy("camera_id", "direction").agg(F.count("*").alias("n"))


@query(
    f"with {FRAMES}, {SHAPE} select camera_id, vehicle_class, count(*) as tracks, count_if(sightings >= 2)::bigint as counted, round(avg(dwell_s), 6) as mean_dwell_s from way group by all", d.SIGHTINGS
)
def track_dwell(spark, sf_dir):
    return _shape(spark, sf_dir).groupBy("camera_id", "vehicle_class").agg(F.count("*").alias("tracks"), F.count_if(F.col("sightings") >= 2).alias("counted"), F.round(F.avg("dwell_s"), 6).alias("mean_dwell_s"))


# A triangle, a rectangle and a line on each camera, moved by its number.
ZONES_OF = """zones as (
      select camera_id || '-in' as zone_id, camera_id, 'intrusion' as rule, [{x: 0.1 + k / 100.0, y: 0.1}, {x: 0.9, y: 0.2}, {x: 0.5, y: 0.9}] as points, [] as classes, 30.0 as dwell_s from n
      union all select camera_id || '-loiter', camera_id, 'loitering', [{x: 0.2, y: 0.2}, {x: 0.8, y: 0.2}, {x: 0.8, y: 0.8}, {x: 0.2, y: 0.8 - k / 200.0}], ['car', 'bus'], 60.0 from n
      union all select camera_id || '-line', camera_id, 'crossing', [{x: 0.5, y: 0.0}, {x: 0.5 + k / 100.0, y: 1.0}], [], 30.0 from n
    )"""
ZONES = f"n as (select camera_id, substr(camera_id, 4, 2)::int as k from cameras), {ZONES_OF}"


def zones(spark):
    return zones_of(d.cameras(spark).selectExpr("camera_id", "cast(substr(camera_id, 4, 2) as int) as k"))


def zones_of(n):
    point = lambda x, y: f"struct(cast({x} as double) as x, cast({y} as double) as y)"
    none, some = "cast(array() as array<string>)", "array('car', 'bus')"
    a = n.selectExpr("concat(camera_id, '-in') as zone_id", "camera_id", "'intrusion' as rule", f"array({point('0.1D + k / 100D', 0.1)}, {point(0.9, 0.2)}, {point(0.5, 0.9)}) as points", f"{none} as classes", "30D as dwell_s")
    b = n.selectExpr("concat(camera_id, '-loiter') as zone_id", "camera_id", "'loitering' as rule", f"array({point(0.2, 0.2)}, {point(0.8, 0.2)}, {point(0.8, 0.8)}, {point(0.2, '0.8D - k / 200D')}) as points", f"{some} as classes", "60D as dwell_s")
    c = n.selectExpr("concat(camera_id, '-line') as zone_id", "camera_id", "'crossing' as rule", f"array({point(0.5, 0)}, {point('0.5D + k / 100D', 1)}) as points", f"{none} as classes", "30D as dwell_s")
    return a.union(b).union(c)


def _hits(spark, sf_dir, rule):
    points = frames(spark, sf_dir).drop("pts_ms").withColumnRenamed("wall_ms", "pts_ms")  # a clock that doesn't restart
    return vision.zone_hits(points, zones(spark).where(F.col("rule") == rule), 1900, 1080, ["camera_id", "track_id"], ["pts_ms", "id"])


STEPS = "pts as (select *, lag(cx) over w as px, lag(cy) over w as py, min(wall_ms) over w as since from frames window w as (partition by camera_id, track_id order by wall_ms, id))"
EDGES = """edges as (select zone_id, i, points[i].x * 1900 as xi, points[i].y * 1080 as yi, points[case when i = 1 then len(points) else i - 1 end].x * 1900 as xj, points[case when i = 1 then len(points) else i - 1 end].y * 1080 as yj
      from zones, unnest(range(1, len(points) + 1)) as g(i) where rule <> 'crossing'),
    inside as (
      select p.id, z.zone_id, z.rule, z.dwell_s, p.camera_id, p.track_id, p.wall_ms, p.since from pts p join zones z on z.camera_id = p.camera_id and (len(classes) = 0 or list_contains(classes, p.vehicle_class)) join edges e on e.zone_id = z.zone_id
      group by all having count_if((yi > any_value(cy)) <> (yj > any_value(cy)) and false) >= 0 and sum(((yi > cy) <> (yj > cy) and cx < (xj - xi) * (cy - yi) / case when yj = yi then 1e-12 else yj - yi end + xi)::int) % 2 = 1
    )"""
EDGES = EDGES.replace("count_if((yi > any_value(cy)) <> (yj > any_value(cy)) and false) >= 0 and ", "")


@query(f"with {FRAMES}, {STEPS}, {ZONES}, {EDGES} select zone_id, track_id, id from inside where rule = 'intrusion' qualify row_number() over (partition by zone_id, track_id order by wall_ms, id) = 1", d.SIGHTINGS, d.CAMERAS)
def zone_intrusion(spark, sf_dir):
    return _hits(spark, sf_dir, "intrusion").select("zone_id", "track_id", "id")


@query(
    f"with {FRAMES}, {STEPS}, {ZONES}, {EDGES} select zone_id, track_id, id from inside where rule = 'loitering' and (wall_ms - since) / 1000.0 >= dwell_s qualify row_number() over (partition by zone_id, track_id order by wall_ms, id) = 1",
    d.SIGHTINGS, d.CAMERAS,
)
def zone_loitering(spark, sf_dir):
    return _hits(spark, sf_dir, "loitering").select("zone_id", "track_id", "id")


@query(
    f"""with {FRAMES}, {STEPS}, {ZONES}, l as (select zone_id, camera_id, points[1].x * 1900 as ax, points[1].y * 1080 as ay, points[2].x * 1900 as qx, points[2].y * 1080 as qy from zones where rule = 'crossing'),
    o as (select *, (qx - ax) * (py - ay) - (qy - ay) * (px - ax) > 0 as d1, (qx - ax) * (cy - ay) - (qy - ay) * (cx - ax) > 0 as d2,
      (cx - px) * (ay - py) - (cy - py) * (ax - px) > 0 as d3, (cx - px) * (qy - py) - (cy - py) * (qx - px) > 0 as d4 from pts join l using (camera_id) where px is not null)
    select zone_id, track_id, id, case when d2 then 'a' else 'b' end as side from o where d1 <> d2 and d3 <> d4 qualify row_number() over (partition by zone_id, track_id order by wall_ms, id) = 1""",
    d.SIGHTINGS, d.CAMERAS,
)
def zone_crossing(spark, sf_dir):
    return _hits(spark, sf_dir, "crossing").select("zone_id", "track_id", "id", "side")


@query(
    f"""with {FRAMES}, b as (select *, hour // 24 as fr from frames), p as (
      select a.camera_id, a.id as id_a, b.id as id_b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as areas from b a join b on a.camera_id = b.camera_id and a.fr = b.fr and a.id < b.id
    ) select camera_id, id_a, id_b, round(inter::double / (areas - inter), 6) as iou from p where inter > 0 and inter::double / (areas - inter) >= 0.25::double""",
    d.SIGHTINGS,
)
def iou_pairs(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("frame", F.expr("hour div 24"))
    return vision.overlaps(f).withColumn("iou", F.round("iou", 6))
