"""Appearance and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import attribute_delta
from ..operators import journeys
from ..params import Journey, Similar
from ..sources import domain as d
from . import query

LOOSE = Similar(threshold=0.80, limit=25)


def _topk_sql(every: int) -> str:
    return f"""{d.BLENDED}, hits as (
      select q.vec_id as query_id, g.vec_id, round(list_dot_product(q.v, g.v), 9) as similarity from blended q join blended g on q.vec_id % {every} = 0 and g.vec_id <> q.vec_id
    ), ranked as (select *, (row_number() over (partition by query_id order by similarity desc, vec_id))::int as place from hits where similarity >= 0.8::double qualify place <= 25)"""


def _ranked(spark, sf_dir, every):
    g = d.blended(spark, sf_dir)
    return journeys.similar(g, g.where(F.col("vec_id") % every == 0), LOOSE)


#: Searches ask with every row whose id this divides, against all rows.
ASKED = 20


def _topk(every: int) -> str:
    return f"with {_topk_sql(every)} select query_id, vec_id, round(similarity, 6) as similarity, place from ranked"


@query(_topk(ASKED))
def appearance_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, ASKED).withColumn("similarity", F.round("similarity", 6))


def _ambiguity(every: int) -> str:
    return f"""with {_topk_sql(every)}, f as (select *, max(similarity) over w as first, max(case when place = 2 then similarity end) over w as second from ranked window w as (partition by query_id))
    select query_id, vec_id, place, coalesce(first - second <= 0.020000001::double and first - similarity <= 0.020000001::double, false) as ambiguous from f"""


@query(_ambiguity(ASKED))
def appearance_ambiguity(spark, sf_dir):
    return journeys.flagged(_ranked(spark, sf_dir, ASKED), LOOSE).select("query_id", "vec_id", "place", "ambiguous")


SIMILAR = f"""{_topk_sql(ASKED)}, placed as (
      select s.id, s.camera_id, s.wall_us, c.lat, c.lon, t.time_group from sightings s left join cameras c using (camera_id) left join sessions t using (camera_id)
    ), far as (
      select r.*, b.camera_id, coalesce({d.km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 0) as km, abs(b.wall_us - a.wall_us)::double / 1e6::double as secs, a.camera_id <> b.camera_id and b.wall_us <> a.wall_us as judged,
        a.time_group is not distinct from b.time_group as same_time_group
      from ranked r join placed a on a.id = query_id join placed b on b.id = r.vec_id
    ), ok as (select *, not judged or km / (secs / 3600.0::double) <= 120 as plausible from far)"""
SPEED = "'implies ' || floor(km / (secs / 3600) + 0.5::double)::bigint || ' km/h over ' || ((floor(km * 10 + 0.5::double) / 10)::decimal(20, 1))::varchar || ' km'"


@query(
    f"""with {SIMILAR} select query_id, vec_id, place, round(similarity, 4) as similarity, camera_id, floor(km * 100 + 0.5::double) / 100 as distance_km, floor(secs * 10 + 0.5::double) / 10 as elapsed_s, plausible,
      case when not judged then 'same camera' when plausible then {SPEED} else {SPEED} || ' in ' || floor(secs + 0.5::double)::bigint || 's - not physically possible' end as plausibility, same_time_group from ok""",
    d.SIGHTINGS, d.CAMERAS, d.TIME_GROUPS,
)
def similar_vehicles(spark, sf_dir):
    """The most alike of each asked sighting's vector, with what distance and time allow; vectors are those of the
    sightings of their id."""
    ranked = _ranked(spark, sf_dir, ASKED).withColumn("similarity", F.round("similarity", 4))
    return journeys.with_travel(ranked, d.sightings(spark, sf_dir), d.cameras(spark), d.sessions(spark))


ATTRS = "attrs as (select vec_id, case vec_id % 4 when 0 then 'suv' when 1 then 'bus' when 2 then 'unknown' end as body, case vec_id % 3 when 0 then 'red' when 1 then 'blue' end as hue from embeddings)"


def _adjust_sql(every: int) -> str:
    return f"""with {_topk_sql(every)}, {ATTRS}, p as (
      select r.*, case when (a.body <> 'unknown' and b.body <> 'unknown' and a.body <> b.body) or a.hue <> b.hue then -0.05::double when a.body <> 'unknown' and b.body <> 'unknown' and a.hue = b.hue then 0.03::double end as delta
      from ranked r join attrs a on a.vec_id = query_id join attrs b on b.vec_id = r.vec_id
    ) select query_id, vec_id, delta, floor(least(1, greatest(0, similarity + coalesce(delta, 0))) * 10000 + 0.5::double) / 10000::double as presented from p"""


def _adjusted(spark, sf_dir, every):
    attrs = d.raw(spark, sf_dir, "embeddings").selectExpr("vec_id", "case vec_id % 4 when 0 then 'suv' when 1 then 'bus' when 2 then 'unknown' end as body", "case vec_id % 3 when 0 then 'red' when 1 then 'blue' end as hue")
    a, b = attrs.selectExpr("vec_id as query_id", "body as body_a", "hue as hue_a"), attrs.selectExpr("vec_id", "body as body_b", "hue as hue_b")
    r = _ranked(spark, sf_dir, every).join(a, "query_id").join(b, "vec_id")
    r = r.withColumn("delta", attribute_delta(F.col("body_a"), F.col("body_b"), F.col("hue_a"), F.col("hue_b"), 0.03, 0.05))
    shown = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity") + F.coalesce("delta", F.lit(0.0)))) * 10000 + 0.5) / 10000
    return r.select("query_id", "vec_id", "delta", shown.alias("presented"))


@query(_adjust_sql(ASKED))
def attribute_adjust(spark, sf_dir):
    return _adjusted(spark, sf_dir, ASKED)


#: Two of three sightings carry the vector of their event; the rest have none.
WITH_VECTORS = f"""{d.BLENDED}, seen as (
      select s.*, case when s.id % 3 <> 2 then b.v end as v from sightings s left join blended b on b.vec_id = s.user_id % (select count(*) from embeddings)
    )"""


def seen(spark, sf_dir):
    n = d.raw(spark, sf_dir, "embeddings").count()
    v = d.blended(spark, sf_dir).select(F.col("vec_id").alias("k"), "v")
    s = d.sightings(spark, sf_dir).withColumn("k", F.col("user_id") % n)
    return s.join(v, "k", "left").withColumn("v", F.when(F.col("id") % 3 != 2, F.col("v")))


@query(
    f"""with {WITH_VECTORS} select count(*) as total, count_if(corroborated)::bigint as clocked, count_if(corroborated and v is not null)::bigint as comparable, count_if(not corroborated)::bigint as no_clock, count_if(corroborated and v is null)::bigint as no_embedding from seen""",
    d.SIGHTINGS,
)
def journey_exclusions(spark, sf_dir):
    return journeys.exclusions(seen(spark, sf_dir))


def _steps_sql(gap_us: int) -> str:
    return f"""with {WITH_VECTORS}, m as (select s.*, t.time_group, c.lat, c.lon from seen s join sessions t using (camera_id) join cameras c using (camera_id) where corroborated and v is not null),
    p as (
      select a.time_group, a.id as id_a, b.id as id_b, {d.km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km, (b.scene_us - a.scene_us)::double / 1e6::double as seconds, a.v as va, b.v as vb
      from m a join m b on a.time_group = b.time_group and b.scene_us > a.scene_us and b.scene_us - a.scene_us <= {gap_us} and a.camera_id <> b.camera_id
    ) select time_group, id_a, id_b, round(km, 6) as km, seconds, round(list_dot_product(va, vb), 6) as similarity from p where km / (seconds / 3600) <= 120 and round(list_dot_product(va, vb), 9) >= 0.84::double"""


def _steps(spark, sf_dir, params):
    m = journeys.minable(seen(spark, sf_dir), d.sessions(spark))
    return journeys.steps(m, d.cameras(spark), params, digits=6)


@query(_steps_sql(1_800_000_000), d.SIGHTINGS, d.CAMERAS, d.TIME_GROUPS)
def journey_candidates(spark, sf_dir):
    return _steps(spark, sf_dir, Journey())


@query()
def journey_mine(spark, sf_dir):
    m = journeys.minable(seen(spark, sf_dir), d.sessions(spark))
    return journeys.mine(m, d.cameras(spark)).drop("hop_ids", "cameras")


MADE = "made as (select conv_id as place, count(*) as hop_count, case when conv_id % 5 <> 0 then 0.8::double + (conv_id % 20)::double / 100 end as min_similarity, floor((0.5::double + (conv_id * 7 % 40)::double / 100) * 1000 + 0.5::double) / 1000::double as confidence from conversations group by conv_id)"


@query(f"with {MADE} select place, hop_count, min_similarity, confidence from made where hop_count >= 3 and coalesce(min_similarity, 1) >= 0.84::double order by confidence desc, hop_count desc, place limit 50")
def journey_filter(spark, sf_dir):
    c = d.raw(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("place")).agg(F.count("*").alias("hop_count"))
    made = c.withColumn("min_similarity", F.expr("case when place % 5 <> 0 then 0.8D + (place % 20) / 100D end")).withColumn("confidence", F.expr("floor((0.5D + (place * 7 % 40) / 100D) * 1000 + 0.5D) / 1000D"))
    return journeys.stored(made, 3, 0.84, 50).select("place", "hop_count", "min_similarity", "confidence")
