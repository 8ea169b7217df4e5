"""The roster of cameras: states, gaps, checks and merges, over a camera for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fingerprint, redact_url
from ..operators import registry
from ..sources import domain as d
from . import query
from .vision import ZONES_OF, zones_of

CITY = "coalesce(city, 'unknown')"
HEALTH = """case when capability = 'degraded' then 'degraded' when not live then 'not-started' when not connected or stale_s is null or stale_s > 30 then 'offline'
      when stale_s > 5 or dark then 'degraded' else 'online' end"""
BASIC = "case when not live then 'not-started' when not connected then 'offline' when stale_s > 5 or reconnects > 3 then 'degraded' else 'online' end"


@query(
    f"""select case when grouping(capability) = 0 then 'capability' when grouping(place) = 0 then 'city' else 'all' end as kind, case when grouping(capability) = 0 then capability when grouping(place) = 0 then place end as value, count(*) as n,
      floor(1000.0::double * count_if(capability = 'anpr') / greatest(count(*), 1) + 0.5::double) / 10::double as anpr_pct, floor(1000.0::double * count_if(capability <> 'degraded') / greatest(count(*), 1) + 0.5::double) / 10::double as usable_pct
    from (select *, {CITY} as place from roster) group by grouping sets ((capability), (place), ())""",
    d.ROSTER,
)
def gap_analysis(spark, sf_dir):
    return registry.gaps(d.roster(spark, sf_dir))


@query(f"select 'capability' as kind, capability as value, camera_id from roster union all select 'city', {CITY}, camera_id from roster", d.ROSTER)
def gap_members(spark, sf_dir):
    return registry.gap_members(d.roster(spark, sf_dir))


@query(f"select {CITY} as city, count(*) as n from roster group by all order by n desc, city limit 8", d.ROSTER)
def coverage(spark, sf_dir):
    return d.roster(spark, sf_dir).groupBy(F.coalesce("city", F.lit("unknown")).alias("city")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(8)


@query(f"select camera_id, {HEALTH} as state from roster", d.ROSTER)
def health_state(spark, sf_dir):
    return d.roster(spark, sf_dir).select("camera_id", registry.health().alias("state"))


@query(f"select camera_id, {BASIC} as state from roster", d.ROSTER)
def health_state_basic(spark, sf_dir):
    return d.roster(spark, sf_dir).select("camera_id", registry.basic_health(F.col("reconnects")).alias("state"))


@query(
    "select camera_id, case when not has_frame then 'down' when mean_luma < 28 then 'black' when mean_luma > 235 then 'overexposed' when banding > 40 then 'corrupt' else 'usable' end as state from roster",
    d.ROSTER,
)
def frame_state(spark, sf_dir):
    return d.roster(spark, sf_dir).select("camera_id", registry.frame_state().alias("state"))


@query("select camera_id, regexp_replace(rtsp_url, '^([A-Za-z][\\w+.\\-]*://)[^/]*@', '\\1') as url, substr(sha256(rtsp_url), 1, 12) as fingerprint from roster", d.ROSTER)
def url_redact(spark, sf_dir):
    return d.roster(spark, sf_dir).select("camera_id", redact_url(F.col("rtsp_url")).alias("url"), fingerprint(F.col("rtsp_url")).alias("fingerprint"))


@query(
    """with old as (select camera_id, 'hevc' as codec, 640 as width, capability from roster where number % 3 <> 0), probe as (
      select camera_id, case when number % 5 <> 0 then 'h264' end as codec, case when number % 7 <> 0 then number * 10 end as width from roster where number % 4 <> 1
    ) select camera_id, coalesce(p.codec, o.codec) as codec, coalesce(p.width, o.width)::bigint as width,
      case when o.camera_id is null then 'unknown' when o.capability <> 'degraded' and camera_id in (select camera_id from roster where number % 10 < 4) then 'anpr' else o.capability end as capability
    from old o full join probe p using (camera_id)""",
    d.ROSTER,
)
def onboard_upsert(spark, sf_dir):
    r = d.roster(spark, sf_dir)
    old = r.where("number % 3 <> 0").select("camera_id", F.lit("hevc").alias("codec"), F.lit(640).cast("long").alias("width"), "capability")
    probe = r.where("number % 4 <> 1").selectExpr("camera_id", "case when number % 5 <> 0 then 'h264' end as codec", "case when number % 7 <> 0 then number * 10 end as width")
    return registry.onboard(old, probe, surveyed=r.where("number % 10 < 4"))


@query(
    f"""with n as (select camera_id, (number % 100)::int as k from roster), {ZONES_OF}, made as (
      select zone_id, case when length(zone_id) % 11 = 0 then 'queue' else rule end as rule, case when length(zone_id) % 2 = 0 then points[1:2] else points end as points, case when ends_with(camera_id, '7') then camera_id || 'x' else camera_id end as camera_id from zones
    ) select zone_id, case when rule not in ('intrusion', 'crossing', 'loitering') then 'rule' when len(points) < case when rule = 'crossing' then 2 else 3 end then 'points'
      when len(list_filter(points, lambda p: p.x not between 0 and 1 or p.y not between 0 and 1)) > 0 then 'range' when camera_id not in (select camera_id from roster) then 'camera' end as error from made""",
    d.ROSTER,
)
def zone_validate(spark, sf_dir):
    r = d.roster(spark, sf_dir)
    z = zones_of(r.selectExpr("camera_id", "cast(number % 100 as int) as k"))
    z = z.withColumn("points", F.expr("case when length(zone_id) % 2 = 0 then slice(points, 1, 2) else points end"))
    z = z.withColumn("rule", F.when(F.length("zone_id") % 11 == 0, "queue").otherwise(F.col("rule")))
    z = z.withColumn("camera_id", F.when(F.col("camera_id").endswith("7"), F.concat("camera_id", F.lit("x"))).otherwise(F.col("camera_id")))
    return registry.zone_errors(z, r).select("zone_id", "error")


@query(
    f"""select camera_id, coalesce(r.state, b.state, 'unknown') as state, case when r.state is not null then 'rich' when b.state is not null then 'basic' else 'roster' end as source from roster
      left join (select camera_id, {HEALTH} as state from roster where number % 3 = 0) r using (camera_id) left join (select camera_id, {BASIC} as state from roster where number % 2 = 0) b using (camera_id)""",
    d.ROSTER,
)
def roster_fallback(spark, sf_dir):
    r = d.roster(spark, sf_dir)
    rich = r.where("number % 3 = 0").select("camera_id", registry.health().alias("state"))
    basic = r.where("number % 2 = 0").select("camera_id", registry.basic_health(F.col("reconnects")).alias("state"))
    return registry.first_source(r.select("camera_id"), [("rich", rich), ("basic", basic)], "camera_id", "state", "unknown", "roster")


@query("select camera_id, lat, lon, city from roster where capability = 'degraded' and lat is not null and lon is not null", d.ROSTER)
def gap_zones(spark, sf_dir):
    return d.roster(spark, sf_dir).where("capability = 'degraded' and lat is not null and lon is not null").select("camera_id", "lat", "lon", "city")


#: Keys of three in four users, and requests that bring a key, none, or one that nobody has.
ACCESS = """keys as (
      select distinct 'k' || user_id as key, 'user' || user_id as name, ['viewer', 'operator', 'admin'][(user_id % 3 + 1)::int] as role from events where user_id % 4 <> 0
    ), requests as (select event_id, case event_id % 5 when 0 then null when 1 then '' else 'k' || user_id end as key from events)"""


@query(
    f"""with {ACCESS} select event_id, 'open' as mode, 'anonymous' as name, 'admin' as role, 'open-mode' as fingerprint from requests union all select event_id, 'unreadable', null, null, null from requests
    union all select event_id, 'enforced', case when coalesce(key, '') = '' then 'anonymous' else name end, case when coalesce(key, '') = '' then 'viewer' else role end, case when coalesce(key, '') = '' then 'anon' when name is not null then substr(sha256(key), 1, 12) end
    from requests left join keys using (key)"""
)
def access_modes(spark, sf_dir):
    """Who each request's caller is while there are no keys, while there are, and while they can't be read."""
    e = d.raw(spark, sf_dir, "events")
    keys = e.where("user_id % 4 <> 0").selectExpr("concat('k', user_id) as key", "concat('user', user_id) as name", "element_at(array('viewer', 'operator', 'admin'), cast(user_id % 3 + 1 as int)) as role").distinct()
    requests = e.selectExpr("event_id", "case event_id % 5 when 0 then null when 1 then '' else concat('k', user_id) end as key")
    out = None
    for mode in ("open", "enforced", "unreadable"):
        part = registry.principals(requests, keys, mode).select("event_id", F.lit(mode).alias("mode"), "name", "role", "fingerprint")
        out = part if out is None else out.unionByName(part)
    return out
