"""Listings, counts, registry, retention and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import masked
from ..operators import matching, registry, retention
from ..sources import domain as d
from ..sources.storage import shared_path, stored
from . import query
from .movement import SCORED

DAY_US = 86_400_000_000
NOW_US = 30 * DAY_US  # the end of the test month

ALERTS = f"""{SCORED}, alerts as (
      select id * 10000 + entry_id as alert_id, id as detection_id, entry_id, camera_id, score, severity, category, plate, wall_us, (id * 10000 + entry_id) % 3 = 0 as acknowledged
      from hits where active
    )"""


def alerts(spark, sf_dir):
    found = matching.alerts(d.sightings(spark, sf_dir), d.watchlist(spark, sf_dir)).where("active")
    key = F.col("id") * 10000 + F.col("entry_id")
    return found.select(key.alias("alert_id"), F.col("id").alias("detection_id"), "entry_id", "camera_id", "score", "severity", "category", "plate", "wall_us", (key % 3 == 0).alias("acknowledged"))


def zone_events(spark, sf_dir):
    """One event for each sighting whose centre lies in its camera's upper left quarter, as a stand-in feed."""
    s = d.sightings(spark, sf_dir).where("x1 < 425 and y1 < 225")
    return s.select(F.col("id").alias("event_id"), "camera_id", F.expr("cast(substr(camera_id, 4, 2) as int)").alias("rule_id"), "vehicle_class", "wall_us", (F.col("id") % 4 == 0).alias("acknowledged"))


ZONE_EVENTS = """zone_events as (
      select id as event_id, camera_id, substr(camera_id, 4, 2)::int as rule_id, vehicle_class, wall_us, id % 4 = 0 as acknowledged from sightings where x1 < 425 and y1 < 225
    )"""


@query(
    f"""select s.id, s.camera_id, c.name, s.vehicle_class, s.colour, case when s.confidence <> 0 then s.confidence end as confidence, s.plate_text
    from sightings s left join cameras c using (camera_id) where s.wall_us >= {NOW_US - 15 * DAY_US} and s.vehicle_class = 'car' and upper(s.plate_text) like '%GJ%'
    order by s.wall_us desc, s.id offset 20 limit 100""",
    d.SIGHTINGS, d.CAMERAS,
)
def detection_list(spark, sf_dir):
    s = d.sightings(spark, sf_dir).where(f"wall_us >= {NOW_US - 15 * DAY_US} and vehicle_class = 'car'").where(F.upper("plate_text").contains("GJ"))
    page = s.orderBy(F.desc("wall_us"), "id").offset(20).limit(100)  # the page comes before the join
    out = page.join(F.broadcast(d.cameras(spark)), "camera_id", "left")
    return out.select("id", "camera_id", "name", "vehicle_class", "colour", F.when(F.col("confidence") != 0, F.col("confidence")).alias("confidence"), "plate_text")


@query(
    "select count(*) as total, count(plate_text) as plates, coalesce(floor(1000.0::double * count(plate_text) / nullif(count(*), 0) + 0.5::double) / 10::double, 0) as plate_rate_pct, "
    "count(distinct camera_id) as cameras, count_if(vehicle_class = 'car')::bigint as cars, count_if(vehicle_class = 'bus')::bigint as buses, count_if(vehicle_class = 'truck')::bigint as trucks, count_if(vehicle_class = 'motorcycle')::bigint as motorcycles from sightings",
    d.SIGHTINGS,
)
def detection_stats(spark, sf_dir):
    kinds = {"car": "cars", "bus": "buses", "truck": "trucks", "motorcycle": "motorcycles"}
    s = d.sightings(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count("plate_text").alias("plates"), F.countDistinct("camera_id").alias("cameras"),
        *[F.count_if(F.col("vehicle_class") == k).alias(n) for k, n in kinds.items()],
    )
    rate = F.floor(1000.0 * F.col("plates") / F.nullif("total", F.lit(0)) + 0.5) / 10
    return s.withColumn("plate_rate_pct", F.coalesce(rate, F.lit(0.0)))


@query("select vehicle_class, count(*) as n from sightings group by 1", d.SIGHTINGS)
def class_counts(spark, sf_dir):
    return d.sightings(spark, sf_dir).groupBy("vehicle_class").agg(F.count("*").alias("n"))


@query("select camera_id, count(*) as n from sightings group by 1 order by n desc, camera_id limit 15", d.SIGHTINGS)
def top_cameras(spark, sf_dir):
    return d.sightings(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera_id").limit(15)


@query("select camera_id, max(wall_us) as last_us, arg_max(id, struct_pack(w := wall_us, i := id)) as last_id from sightings group by 1", d.SIGHTINGS)
def last_seen(spark, sf_dir):
    return d.sightings(spark, sf_dir).groupBy("camera_id").agg(F.max("wall_us").alias("last_us"), F.max_by("id", F.struct("wall_us", "id")).alias("last_id"))


@query(
    f"""with {ALERTS} select a.alert_id, a.detection_id, a.plate, round(a.score, 6) as score, a.severity, a.acknowledged, c.name as camera_name, s.plate_text as observed
    from alerts a left join sightings s on s.id = a.detection_id left join cameras c on c.camera_id = a.camera_id order by a.wall_us desc, a.alert_id desc limit 50""",
    d.SIGHTINGS, d.CAMERAS, d.WATCHLIST,
)
def alert_list(spark, sf_dir):
    page = alerts(spark, sf_dir).orderBy(F.desc("wall_us"), F.desc("alert_id")).limit(50)
    s = d.sightings(spark, sf_dir).select(F.col("id").alias("detection_id"), F.col("plate_text").alias("observed"))
    seen = s.join(F.broadcast(page.select("detection_id").distinct()), "detection_id")  # 50 ids at most
    out = page.join(F.broadcast(seen), "detection_id", "left").join(F.broadcast(d.cameras(spark).select("camera_id", F.col("name").alias("camera_name"))), "camera_id", "left")
    return out.select("alert_id", "detection_id", "plate", F.round("score", 6).alias("score"), "severity", "acknowledged", "camera_name", "observed")


@query(
    f"with {ALERTS} select category, severity, acknowledged, count(*) as n, count(distinct detection_id) as detections from alerts group by all", d.SIGHTINGS, d.WATCHLIST
)
def alert_totals(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("category", "severity", "acknowledged").agg(F.count("*").alias("n"), F.countDistinct("detection_id").alias("detections"))


@query(
    f"""with {ZONE_EVENTS} select z.event_id, z.rule_id, z.vehicle_class, z.acknowledged, c.name as camera_name from zone_events z left join cameras c using (camera_id)
    order by z.wall_us desc, z.event_id limit 100""",
    d.SIGHTINGS, d.CAMERAS,
)
def zone_event_list(spark, sf_dir):
    page = zone_events(spark, sf_dir).orderBy(F.desc("wall_us"), "event_id").limit(100)
    out = page.join(F.broadcast(d.cameras(spark)), "camera_id", "left")
    return out.select("event_id", "rule_id", "vehicle_class", "acknowledged", F.col("name").alias("camera_name"))


@query(f"with {ZONE_EVENTS} select camera_id, count(*) as n, count_if(not acknowledged)::bigint as open, max(wall_us) as newest_us from zone_events group by 1", d.SIGHTINGS)
def zone_event_totals(spark, sf_dir):
    return zone_events(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(~F.col("acknowledged")).alias("open"), F.max("wall_us").alias("newest_us"))


@query("select n_nationkey as key, case when length(n_name) < 4 then n_name else substr(n_name, 1, 2) || '…' || right(n_name, 2) end as shown from nation")
def secret_mask(spark, sf_dir):
    return d.raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), masked(F.col("n_name")).alias("shown"))


PAYLOADS = """payloads as (
      select s_suppkey as row_id, case s_suppkey % 9 when 0 then '' when 1 then 'x' else 'S-' || s_suppkey end as camera_id, case when s_suppkey % 7 <> 0 then s_name end as name,
        (s_suppkey % 200 - 95)::double as lat, (s_suppkey * 3 % 400 - 190)::double as lon,
        case s_suppkey % 5 when 0 then null when 1 then 'ftp://h/' || s_suppkey else ' rtsp://h/' || s_suppkey end as rtsp_url,
        case s_suppkey % 6 when 0 then 'https://h/' || s_suppkey when 1 then '' when 2 then 'h/' || s_suppkey end as hls_url,
        case s_suppkey % 8 when 3 then 'magic' when 4 then null else 'anpr' end as capability,
        case s_suppkey % 10 when 3 then '12.5' when 4 then '' when 5 then null else ' 640' end as width, case s_suppkey % 12 when 7 then 'tall' else s_suppkey::varchar end as height from supplier
    )"""


def payloads(spark, sf_dir):
    return d.raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as row_id",
        "case s_suppkey % 9 when 0 then '' when 1 then 'x' else concat('S-', s_suppkey) end as camera_id",
        "case when s_suppkey % 7 <> 0 then s_name end as name",
        "cast(s_suppkey % 200 - 95 as double) as lat",
        "cast(s_suppkey * 3 % 400 - 190 as double) as lon",
        "case s_suppkey % 5 when 0 then null when 1 then concat('ftp://h/', s_suppkey) else concat(' rtsp://h/', s_suppkey) end as rtsp_url",
        "case s_suppkey % 6 when 0 then concat('https://h/', s_suppkey) when 1 then '' when 2 then concat('h/', s_suppkey) end as hls_url",
        "case s_suppkey % 8 when 3 then 'magic' when 4 then null else 'anpr' end as capability",
        "case s_suppkey % 10 when 3 then '12.5' when 4 then '' when 5 then null else ' 640' end as width",
        "case s_suppkey % 12 when 7 then 'tall' else cast(s_suppkey as string) end as height",
    )


ERROR = """case when not regexp_full_match(camera_id, '[A-Za-z0-9_-]{2,32}') then 'id' when name is null or name = '' then 'name' when not lat between -90 and 90 then 'lat' when not lon between -180 and 180 then 'lon'
      when coalesce(rtsp_url, '') = '' and coalesce(hls_url, '') = '' then 'url' when len(list_filter([trim(rtsp_url), trim(hls_url)], lambda u: u <> '' and not regexp_matches(u, '^(rtsp|rtsps|http|https)://'))) > 0 then 'scheme'
      when capability not in ('anpr', 'vehicle', 'person', 'degraded', 'unknown') then 'capability' when not regexp_full_match(trim(width), '[+-]?[0-9]+') then 'width' when not regexp_full_match(trim(height), '[+-]?[0-9]+') then 'height' end"""


@query(f"with {PAYLOADS} select row_id, {ERROR} as error from payloads")
def camera_validate(spark, sf_dir):
    return payloads(spark, sf_dir).select("row_id", registry.payload_error().alias("error"))


@query(
    f"with {PAYLOADS}, e as (select *, {ERROR} as error from payloads) select count_if(error is null and row_id % 2 = 0)::bigint as updated, count_if(error is null and row_id % 2 <> 0)::bigint as created, count_if(error is not null)::bigint as errors from e"
)
def bulk_quarantine(spark, sf_dir):
    known = payloads(spark, sf_dir).where("row_id % 2 = 0").select("camera_id")
    return registry.import_counts(payloads(spark, sf_dir), known)


@query("select camera_id, exists (select 1 from sightings s where s.camera_id = c.camera_id and s.user_id % 11 = 0) as refused from cameras c", d.SIGHTINGS, d.CAMERAS)
def guarded_delete(spark, sf_dir):
    used = d.sightings(spark, sf_dir).where("user_id % 11 = 0").select("camera_id").distinct().withColumn("refused", F.lit(True))
    return d.cameras(spark).join(used, "camera_id", "left").select("camera_id", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(
    "with seed as (select 'SEED' || i as plate from range(6) t(i) union all select plate from watchlist where entry_id % 10 = 0) select plate from seed where plate not in (select plate from watchlist)",
    d.WATCHLIST,
)
def seed_antijoin(spark, sf_dir):
    w = d.watchlist(spark, sf_dir)
    seed = spark.range(6).select(F.concat(F.lit("SEED"), "id").alias("plate")).union(w.where("entry_id % 10 = 0").select("plate"))
    return seed.join(w, "plate", "left_anti")


FILES = """files as (
      select id, wall_us as mtime_us, 1000 + id % 5000 as bytes, id % 13 = 0 as open from sightings
    )"""


def files(spark, sf_dir):
    return d.sightings(spark, sf_dir).select("id", F.col("wall_us").alias("mtime_us"), (1000 + F.col("id") % 5000).alias("bytes"), (F.col("id") % 13 == 0).alias("open"))


@query(
    f"""with {FILES}, f as (select *, ({NOW_US} - mtime_us)::double / 1e6::double > 604800 as old from files), live as (
      select *, sum(bytes) over (order by mtime_us, id) - bytes as before, sum(bytes) over () as total from f where not open and not old
    ), kept as (select coalesce(sum(bytes), 0) as b from f where open)
    select f.id, case when f.open and (f.old or true) then 'protected' when f.old then 'expired' when l.total + k.b - l.before > 500000 then 'budget' else 'kept' end as verdict
    from f cross join kept k left join live l using (id)""",
    d.SIGHTINGS,
)
def prune_evidence(spark, sf_dir):
    return retention.prune_files(files(spark, sf_dir), NOW_US, 500_000, 7 * 86400).select("id", "verdict")


@query(
    f"""with {ALERTS} select id from sightings where wall_us < {NOW_US - DAY_US} and id not in (select detection_id from alerts)
    order by wall_us, id limit greatest(0, (select count(*) from sightings) - 600)""",
    d.SIGHTINGS, d.WATCHLIST,
)
def prune_detections(spark, sf_dir):
    return retention.prune_rows(d.sightings(spark, sf_dir), alerts(spark, sf_dir).select(F.col("detection_id").alias("id")), NOW_US, 600, 86400)


@query(
    f"with {ALERTS}, {ZONE_EVENTS} select detection_id as id from alerts where not acknowledged union select event_id from zone_events where not acknowledged", d.SIGHTINGS, d.WATCHLIST
)
def protected_evidence(spark, sf_dir):
    return retention.protected(alerts(spark, sf_dir).withColumnRenamed("detection_id", "id"), zone_events(spark, sf_dir).withColumnRenamed("event_id", "id"))


@query("select corroborated, count(*) as n, count(case when corroborated then scene_us end) as timed, coalesce(sum(case when corroborated then scene_us end), 0)::bigint as checksum from sightings group by 1", d.SIGHTINGS)
def purge_scene_time(spark, sf_dir):
    s = retention.purge_scene_times(d.sightings(spark, sf_dir))
    return s.groupBy("corroborated").agg(F.count("*").alias("n"), F.count("scene_us").alias("timed"), F.coalesce(F.sum("scene_us"), F.lit(0).cast("long")).alias("checksum"))


@query(
    f"""with {FILES} select count(*) as files, sum(bytes)::bigint as bytes, round(sum(bytes) / 1048576.0::double, 6) as mib, round(100.0::double * sum(bytes) / 5368709120, 6) as budget_pct, count_if(open)::bigint as protected from files""",
    d.SIGHTINGS,
)
def storage_report(spark, sf_dir):
    f = files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if("open").alias("protected"))
    return f.withColumn("mib", F.round(F.col("bytes") / 1048576.0, 6)).withColumn("budget_pct", F.round(100.0 * F.col("bytes") / 5368709120, 6))


@query(
    f"""with {ALERTS}, h as (select alert_id, 'history' as origin, 0 as o, wall_us from alerts where alert_id % 3 <> 1), l as (select alert_id, 'live' as origin, 1 as o, wall_us from alerts where alert_id % 3 <> 2),
    merged as (select * from (select * from h union all select * from l) qualify row_number() over (partition by alert_id order by o) = 1)
    select alert_id, origin from merged order by wall_us desc, alert_id limit 200""",
    d.SIGHTINGS, d.WATCHLIST,
)
def history_live_merge(spark, sf_dir):
    a = stored(alerts(spark, sf_dir).select("alert_id", "wall_us"), "alerts")  # read twice
    merged = registry.merge_feeds(a.where("alert_id % 3 <> 1"), a.where("alert_id % 3 <> 2"), "alert_id", "wall_us", 200)
    return merged.select("alert_id", "origin")


AUDIT = "audit as (select event_id, 'user' || user_id as actor, event_type as action, 'cam' || event_id % 30 as target, event_id as at_id from events)"


@query(f"with {AUDIT} select event_id, actor, action, target from audit where contains(lower(actor || ' ' || action || ' ' || target), 'r1') order by event_id desc limit 500")
def audit_search(spark, sf_dir):
    a = d.raw(spark, sf_dir, "events").selectExpr("event_id", "concat('user', user_id) as actor", "event_type as action", "concat('cam', event_id % 30) as target")
    return a.where(F.lower(F.concat_ws(" ", "actor", "action", "target")).contains("r1")).orderBy(F.desc("event_id")).limit(500)


@query(
    """with p(role, permission) as (values ('viewer', 'read'), ('operator', 'read'), ('operator', 'operate'), ('admin', 'read'), ('admin', 'operate'), ('admin', 'manage')),
    asked as (select distinct event_type, case event_type when 'view' then 'viewer' when 'click' then 'operator' when 'purchase' then 'admin' else 'guest' end as role from events)
    select event_type, a.role, n.permission, p.role is not null as allowed from asked a cross join (values ('read'), ('operate'), ('manage')) n(permission) left join p on p.role = a.role and p.permission = n.permission"""
)
def permission_matrix(spark, sf_dir):
    role = "case event_type when 'view' then 'viewer' when 'click' then 'operator' when 'purchase' then 'admin' else 'guest' end as role"
    asked = d.raw(spark, sf_dir, "events").selectExpr("event_type", role).distinct()
    return registry.permissions(asked)


@query(
    """select camera_id, count(*) as detections, count(plate_text) as plates, count_if(vehicle_class = 'bus')::bigint as buses, max(wall_us) as last_us,
      case when corroborated_n > 0 then 'scene' else 'stream' end as clock
    from (select *, count_if(corroborated) over (partition by camera_id) as corroborated_n from sightings where wall_us >= """
    + str(NOW_US - DAY_US)
    + ") group by camera_id, corroborated_n",
    d.SIGHTINGS,
)
def report_summary(spark, sf_dir):
    s = d.sightings(spark, sf_dir).where(f"wall_us >= {NOW_US - DAY_US}")
    return s.groupBy("camera_id").agg(
        F.count("*").alias("detections"), F.count("plate_text").alias("plates"), F.count_if(F.col("vehicle_class") == "bus").alias("buses"), F.max("wall_us").alias("last_us"),
        F.when(F.count_if("corroborated") > 0, "scene").otherwise("stream").alias("clock"),
    )


@query(
    """with m as (select user_id, sum(value) * 1000 as bytes, count(*) as records, (max(epoch_us(ts)) - min(epoch_us(ts)))::double / 1e6::double as s from events group by 1)
    select user_id, round(bytes * 8 / s / 1e6::double, 9) as mbit_s, round(bytes / 1e6::double / s * 3600, 6) as mb_h, round(bytes / (records * 316), 6) as reduction from m where s > 0"""
)
def bandwidth_ratio(spark, sf_dir):
    e = d.raw(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    m = e.groupBy("user_id").agg((F.sum("value") * 1000).alias("bytes"), F.count("*").alias("records"), ((F.max("us") - F.min("us")) / 1e6).alias("s")).where("s > 0")
    return m.select(
        "user_id", F.round(F.col("bytes") * 8 / F.col("s") / 1e6, 9).alias("mbit_s"), F.round(F.col("bytes") / 1e6 / F.col("s") * 3600, 6).alias("mb_h"),
        F.round(F.col("bytes") / (F.col("records") * 316), 6).alias("reduction"),
    )


@query(
    """select w.entry_id, w.plate, count(s.id) as exact_sightings from watchlist w left join sightings s on s.plate_text = w.plate group by all""",
    d.SIGHTINGS, d.WATCHLIST,
)
def watchlist_sightings(spark, sf_dir):
    counts = d.sightings(spark, sf_dir).groupBy("plate_text").agg(F.count("*").alias("n"))
    w = d.watchlist(spark, sf_dir)
    return w.join(counts, w.plate == counts.plate_text, "left").select("entry_id", "plate", F.coalesce("n", F.lit(0).cast("long")).alias("exact_sightings"))


@query("select category, count(*) as n from watchlist where active group by 1", d.WATCHLIST)
def watchlist_categories(spark, sf_dir):
    return d.watchlist(spark, sf_dir).where("active").groupBy("category").agg(F.count("*").alias("n"))


@query(
    f"""with {ALERTS}, {ZONE_EVENTS} select camera_id, coalesce(n, 0) as detections, coalesce(a, 0) as alerts, coalesce(z, 0) as zone_events, last_us from cameras
      left join (select camera_id, count(*) as n, max(wall_us) as last_us from sightings group by 1) using (camera_id)
      left join (select camera_id, count(*) as a from alerts group by 1) using (camera_id) left join (select camera_id, count(*) as z from zone_events group by 1) using (camera_id)""",
    d.SIGHTINGS, d.CAMERAS, d.WATCHLIST,
)
def camera_facts(spark, sf_dir):
    s = d.sightings(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("detections"), F.max("wall_us").alias("last_us"))
    a = alerts(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("alerts"))
    z = zone_events(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("zone_events"))
    out = d.cameras(spark).select("camera_id").join(s, "camera_id", "left").join(a, "camera_id", "left").join(z, "camera_id", "left")
    return out.fillna(0, ["detections", "alerts", "zone_events"]).select("camera_id", "detections", "alerts", "zone_events", "last_us")


# -- rosters by payloads that say which columns they bring: suppliers take two payloads each, every third is new

PATCHES = """old as (
      select s_suppkey, s_name, s_nationkey, s_acctbal, 'manual' as origin from supplier where s_suppkey % 3 <> 0
    ), patches as (
      select s_suppkey, k, case when (s_suppkey + k) % 4 <> 0 then s_name || '-' || k end as s_name, case when s_suppkey % 5 <> k then s_nationkey + 100 * k end as s_nationkey, s_acctbal * k as s_acctbal,
        (s_suppkey + k) % 3 <> 1 as has_name, (s_suppkey * k) % 4 < 2 as has_nation, s_suppkey % 7 = k as has_acctbal
      from supplier, range(1, 3) t(k) where s_suppkey % 2 = 0
    )"""


@query(
    f"""with {PATCHES}, n as (
      select s_suppkey, bool_or(has_name) as a, arg_max(struct_pack(v := s_name), k) filter (has_name) as name, bool_or(has_nation) as b, arg_max(struct_pack(v := s_nationkey), k) filter (has_nation) as nation,
        bool_or(has_acctbal) as c, arg_max(struct_pack(v := s_acctbal), k) filter (has_acctbal) as acctbal from patches group by s_suppkey)
    select s_suppkey, case when a then name.v else old.s_name end as s_name, case when b then nation.v else old.s_nationkey end as s_nationkey,
      case when c then acctbal.v when old.s_suppkey is null then 0 else old.s_acctbal end as s_acctbal, case when old.s_suppkey is null then 'payload' else origin end as origin
    from old full join n using (s_suppkey)"""
)
def roster_patch(spark, sf_dir):
    s = d.raw(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.lit("manual").alias("origin"))
    both = s.where("s_suppkey % 2 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    patches = both.selectExpr(
        "s_suppkey", "k", "case when (s_suppkey + k) % 4 <> 0 then concat(s_name, '-', k) end as s_name", "case when s_suppkey % 5 <> k then s_nationkey + 100 * k end as s_nationkey", "s_acctbal * k as s_acctbal",
        "filter(array(case when (s_suppkey + k) % 3 <> 1 then 's_name' end, case when (s_suppkey * k) % 4 < 2 then 's_nationkey' end, case when s_suppkey % 7 = k then 's_acctbal' end, 'unknown'), x -> x is not null) as present",
    )
    return registry.merge_present(old, patches, "s_suppkey", "k", {"s_acctbal": 0.0, "origin": "payload"})


def _told(spark, tables: dict[str, dict]):
    return spark.createDataFrame([(t, k, int(v)) for t, figures in tables.items() for k, v in figures.items()], "step string, figure string, n long")


@query(
    f"""with {FILES}, {ALERTS}, f as (select *, ({NOW_US} - mtime_us)::double / 1e6::double > 604800 as old from files), l as (
      select *, sum(bytes) over (order by mtime_us, id) - bytes as before, sum(bytes) over () as total from f where not open and not old
    ), j as (
      select f.id, f.bytes, case when f.open then 'protected' when f.old then 'expired' when l.total + k.b - l.before > 500000 then 'budget' else 'kept' end as verdict
      from f cross join (select coalesce(sum(bytes), 0) as b from f where open) k left join l using (id)
    ), gone as (select id from sightings where wall_us < {NOW_US - DAY_US} and id not in (select detection_id from alerts) order by wall_us, id limit (select greatest(0, count(*) - 600) from sightings))
    select 'purge' as step, unnest(['rows', 'clocked_before', 'clocked_after']) as figure, unnest([count(*), count(scene_us), count_if(corroborated and scene_us is not null)])::bigint as n from sightings
    union all select 'evidence', unnest(['files_before', 'bytes_before', 'files_after', 'bytes_after', 'files_protected', 'files_expired', 'files_over_budget']),
      unnest([count(*), sum(bytes), count_if(verdict in ('kept', 'protected')), coalesce(sum(bytes) filter (verdict in ('kept', 'protected')), 0), count_if(verdict = 'protected'), count_if(verdict = 'expired'), count_if(verdict = 'budget')])::bigint from j
    union all select 'rows', unnest(['rows_before', 'rows_after']), unnest([count(*), count(*) - (select count(*) from gone)])::bigint from sightings""",
    d.SIGHTINGS, d.WATCHLIST,
)
def retention_figures(spark, sf_dir):
    """What the purge and the two prunes change, counted while they run."""
    at = shared_path(spark, "figures")
    s = d.sightings(spark, sf_dir)
    needed = alerts(spark, sf_dir).select(F.col("detection_id").alias("id"))
    return _told(
        spark,
        {
            "purge": retention.purged(s, f"{at}/purge"),
            "evidence": retention.pruned_files(files(spark, sf_dir), f"{at}/evidence", NOW_US, 500_000, 7 * 86400),
            "rows": retention.pruned_rows(s, needed, f"{at}/rows", NOW_US, 600, 86400),
        },
    )
