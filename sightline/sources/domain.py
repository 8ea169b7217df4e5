"""Domain tables derived from the generic test tables, each with the same derivation in plain SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cameras with their place.
CAMERA_PLACES = [
    ("cam01", 23.0290, 72.5580, "Ahmedabad", "Ahmedabad"),
    ("cam02", 23.0330, 72.5620, "Ahmedabad", "Ahmedabad"),
    ("cam03", 23.1090, 72.5900, "Ahmedabad", "Ahmedabad"),
    ("cam04", 23.0130, 72.5620, "Ahmedabad", "Ahmedabad"),
    ("cam05", 23.1010, 72.5860, "Ahmedabad", "Ahmedabad"),
    ("cam06", 21.5060, 70.4620, "Junagadh", "Junagadh"),
    ("cam07", 20.9000, 70.4000, "Gir Somnath", "Gir Somnath"),
    ("cam08", 21.5150, 70.4500, "Junagadh", "Junagadh"),
    ("cam09", 21.5200, 70.4300, "Junagadh", "Junagadh"),
    ("cam10", 21.5220, 70.4570, "Junagadh", "Junagadh"),
    ("cam11", 21.4900, 70.4300, "Junagadh", "Junagadh"),
    ("cam12", 23.1650, 72.5800, "Adalaj", "Gandhinagar"),
    ("cam13", 23.0380, 72.5510, "Ahmedabad", "Ahmedabad"),
    ("cam14", 23.0290, 72.5700, "Ahmedabad", "Ahmedabad"),
    ("cam15", 23.0180, 72.5300, "Ahmedabad", "Ahmedabad"),
    ("cam16", 23.1020, 72.5870, "Ahmedabad", "Ahmedabad"),
    ("cam17", 22.3000, 70.8000, "Rajkot", "Rajkot"),
    ("cam18", 22.3050, 70.7950, "Rajkot", "Rajkot"),
    ("cam19", 20.8200, 72.9800, "Gandevi", "Navsari"),
    ("cam20", 23.2000, 72.6300, "Mohanpura", "Gandhinagar"),
    ("cam21", 23.8500, 72.1200, "Patan", "Patan"),
    ("cam22", 23.9000, 72.3000, "Mervada", "Banaskantha"),
    ("cam23", 23.7000, 72.4000, "Kheram", "Banaskantha"),
    ("cam24", 23.1700, 72.8200, "Dehgam", "Gandhinagar"),
    ("cam25", 23.9500, 72.4500, "Dhanori", "Banaskantha"),
    ("cam26", 20.9000, 72.9000, "Tankal", "Navsari"),
    ("cam27", 20.7700, 72.9600, "Bilimora", "Navsari"),
    ("cam28", 20.7710, 72.9610, "Bilimora", "Navsari"),
    ("cam29", 20.7720, 72.9620, "Bilimora", "Navsari"),
    ("cam30", 23.0800, 70.1300, "Gandhidham", "Kutch"),
]

# Cameras whose recordings share one clock, by session.
SESSIONS = {
    "ahmedabad-13jun": ["cam01", "cam02", "cam03", "cam04", "cam05", "cam13", "cam14", "cam15"],
    "junagadh-13jun": ["cam08", "cam09", "cam10", "cam11"],
}

SINCE_US = 1_704_067_200_000_000  # 2024-01-01 in microseconds


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sighting for each event; times are whole numbers of microseconds or milliseconds."""
    return sightings_of(raw(spark, sf_dir, "events"))


def sightings_of(events: DataFrame) -> DataFrame:
    """The sightings of a table or a stream of events."""
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - SINCE_US)
    base = F.expr(
        "concat('GJ', lpad(cast(user_id % 38 + 1 as string), 2, '0'), char(65 + user_id % 26),"
        " char(65 + (user_id * 7) % 26), lpad(cast((user_id * 7919) % 10000 as string), 4, '0'))"
    )
    e = e.withColumn("base_plate", base)
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.expr("concat('cam', lpad(cast((event_id * 7 + user_id) % 30 + 1 as string), 2, '0'))").alias("camera_id"),
        "base_plate",
        F.expr(
            "case event_id % 5 when 0 then null when 1 then substr(base_plate, 3)"
            " when 2 then replace(base_plate, '0', 'O') else base_plate end"
        ).alias("plate_text"),
        F.expr("case when event_id % 11 <> 0 then (event_id * 17 % 70 + 30) / 100D end").alias("plate_conf"),
        F.expr("us div 720000000 * 1000000").alias("scene_us"),
        F.expr("event_id % 3 <> 0").alias("corroborated"),
        F.col("us").alias("wall_us"),
        F.expr("us % 3600000000 div 1000").alias("pts_ms"),
        F.expr(
            "case event_type when 'view' then 'motorcycle' when 'purchase' then 'bus' when 'error' then 'truck' else 'car' end"
        ).alias("vehicle_class"),
        F.expr("element_at(array('white','silver','black','red','blue','yellow','green'), cast((user_id * 13) % 7 + 1 as int))").alias("colour"),
        F.expr("(event_id * 29 % 80 + 20) / 100D").alias("confidence"),
        F.expr("(event_id * 37) % 1700").alias("x1"),
        F.expr("(event_id * 53) % 900").alias("y1"),
        F.expr("(event_id * 37) % 1700 + 60 + event_id % 160").alias("x2"),
        F.expr("(event_id * 53) % 900 + 50 + event_id % 130").alias("y2"),
        F.col("user_id").alias("track_id"),
    )


SIGHTINGS = """ev as (
  select *, epoch_us(ts) - 1704067200000000 as us,
    concat('GJ', lpad((user_id % 38 + 1)::varchar, 2, '0'), chr((65 + user_id % 26)::int),
      chr((65 + (user_id * 7) % 26)::int), lpad(((user_id * 7919) % 10000)::varchar, 4, '0')) as base_plate
  from events
), sightings as (
  select event_id as id, user_id, concat('cam', lpad(((event_id * 7 + user_id) % 30 + 1)::varchar, 2, '0')) as camera_id, base_plate,
    case event_id % 5 when 0 then null when 1 then substr(base_plate, 3) when 2 then replace(base_plate, '0', 'O') else base_plate end as plate_text,
    case when event_id % 11 <> 0 then (event_id * 17 % 70 + 30)::double / 100 end as plate_conf,
    us // 720000000 * 1000000 as scene_us, event_id % 3 <> 0 as corroborated, us as wall_us, us % 3600000000 // 1000 as pts_ms,
    case event_type when 'view' then 'motorcycle' when 'purchase' then 'bus' when 'error' then 'truck' else 'car' end as vehicle_class,
    ['white','silver','black','red','blue','yellow','green'][((user_id * 13) % 7 + 1)::int] as colour,
    (event_id * 29 % 80 + 20)::double / 100 as confidence,
    (event_id * 37) % 1700 as x1, (event_id * 53) % 900 as y1,
    (event_id * 37) % 1700 + 60 + event_id % 160 as x2, (event_id * 53) % 900 + 50 + event_id % 130 as y2,
    user_id as track_id
  from ev
)"""


def cameras(spark: SparkSession) -> DataFrame:
    """The roster with measured facts by arithmetic on the camera's number, so that every state occurs."""
    places = spark.createDataFrame(CAMERA_PLACES, "camera_id string, lat double, lon double, city string, district string")
    n = F.substring("camera_id", 4, 2).cast("int")
    return places.select(
        "camera_id",
        F.concat(F.col("city"), F.lit(" "), F.substring("camera_id", 4, 2)).alias("name"),
        "lat",
        "lon",
        F.when(n % 13 == 0, None).otherwise(F.col("city")).alias("city"),
        "district",
        F.when(n % 6 == 0, "anpr").when(n % 5 == 0, "degraded").when(n % 11 == 0, "person").when(n % 17 == 0, "unknown").otherwise("vehicle").alias("capability"),
        (n * 9 % 256).cast("double").alias("mean_luma"),
        (n * 3 % 50).cast("double").alias("banding"),
        (n % 29 != 0).alias("has_frame"),
        (n % 8 != 0).alias("connected"),
        F.when(n % 10 == 3, None).otherwise((n * 2 % 40).cast("double")).alias("stale_s"),
        (n % 9 == 4).alias("dark"),
        (n % 14 != 5).alias("live"),
        F.concat(F.lit("rtsp://user:secret@10.0.0."), n, F.lit("/stream")).alias("rtsp_url"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


CAMERAS = f"""places(camera_id, lat, lon, city, district) as (
  values {_values([(a, b, c, d, e) for a, b, c, d, e in CAMERA_PLACES])}
), cameras as (
  select camera_id, city || ' ' || substr(camera_id, 4, 2) as name, lat::double as lat, lon::double as lon,
    case when n % 13 <> 0 then city end as city, district,
    case when n % 6 = 0 then 'anpr' when n % 5 = 0 then 'degraded' when n % 11 = 0 then 'person' when n % 17 = 0 then 'unknown' else 'vehicle' end as capability,
    (n * 9 % 256)::double as mean_luma, (n * 3 % 50)::double as banding, n % 29 <> 0 as has_frame, n % 8 <> 0 as connected,
    case when n % 10 <> 3 then (n * 2 % 40)::double end as stale_s, n % 9 = 4 as dark, n % 14 <> 5 as live,
    'rtsp://user:secret@10.0.0.' || n || '/stream' as rtsp_url
  from (select *, substr(camera_id, 4, 2)::int as n from places)
)"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each supplier, in its nation, with the columns of `cameras`, its number and how often it came back.
    This roster grows with the scale; states follow from the number and from the cents of the balance."""
    nations = raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    s = raw(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left").withColumn("n", F.col("s_suppkey"))
    s = s.withColumn("cents", F.round(F.abs("s_acctbal") * 100).cast("long"))
    return s.selectExpr(
        "n as number",
        "concat('S-', n) as camera_id",
        "s_name as name",
        "case when n % 19 <> 4 then 8D + s_nationkey + (n % 100) / 100D end as lat",
        "case when n % 23 <> 5 then 60D + s_nationkey + (n * 7 % 100) / 100D end as lon",
        "case when n % 13 <> 0 then nation end as city",
        "nation as district",
        "case when n % 6 = 0 then 'anpr' when n % 5 = 0 then 'degraded' when n % 11 = 0 then 'person' when n % 17 = 0 then 'unknown' else 'vehicle' end as capability",
        "cast(cents % 256 as double) as mean_luma",
        "cast(cents % 50 as double) as banding",
        "n % 29 <> 3 as has_frame",
        "n % 8 <> 1 as connected",
        "case when n % 10 <> 3 then cast(cents % 40 as double) end as stale_s",
        "n % 9 = 4 as dark",
        "n % 14 <> 5 as live",
        "cents % 6 as reconnects",
        "case n % 5 when 0 then concat('media/', s_name, '@', n, '.mp4') when 1 then concat('http://h', n, '/a@b') when 2 then concat('rtsps://user', n, '@h', n, '/stream') when 3 then null"
        " else concat('rtsp://user:', cents, '@h', n, '/stream') end as rtsp_url",
    )


ROSTER = """suppliers as (
  select s_suppkey as n, s_name, s_nationkey, n_name as nation, round(abs(s_acctbal) * 100)::bigint as cents from supplier left join nation on n_nationkey = s_nationkey
), roster as (
  select n as number, 'S-' || n as camera_id, s_name as name,
    case when n % 19 <> 4 then 8.0::double + s_nationkey + (n % 100)::double / 100 end as lat, case when n % 23 <> 5 then 60.0::double + s_nationkey + (n * 7 % 100)::double / 100 end as lon,
    case when n % 13 <> 0 then nation end as city, nation as district,
    case when n % 6 = 0 then 'anpr' when n % 5 = 0 then 'degraded' when n % 11 = 0 then 'person' when n % 17 = 0 then 'unknown' else 'vehicle' end as capability,
    (cents % 256)::double as mean_luma, (cents % 50)::double as banding, n % 29 <> 3 as has_frame, n % 8 <> 1 as connected,
    case when n % 10 <> 3 then (cents % 40)::double end as stale_s, n % 9 = 4 as dark, n % 14 <> 5 as live, cents % 6 as reconnects,
    case n % 5 when 0 then 'media/' || s_name || '@' || n || '.mp4' when 1 then 'http://h' || n || '/a@b' when 2 then 'rtsps://user' || n || '@h' || n || '/stream' when 3 then null
      else 'rtsp://user:' || cents || '@h' || n || '/stream' end as rtsp_url
  from suppliers
)"""


def sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, g) for g, cs in SESSIONS.items() for c in cs], "camera_id string, time_group string")


TIME_GROUPS = f"""sessions(camera_id, time_group) as (
  values {_values([(c, g) for g, cs in SESSIONS.items() for c in cs])}
)"""


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each fifth user that was seen."""
    users = raw(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 5 = 0")
    return users.select(
        F.col("user_id").alias("entry_id"),
        F.expr(
            "concat('GJ', lpad(cast(user_id % 38 + 1 as string), 2, '0'), char(65 + user_id % 26),"
            " char(65 + (user_id * 7) % 26), lpad(cast((user_id * 7919) % 10000 as string), 4, '0'))"
        ).alias("plate"),
        F.expr("element_at(array('stolen','wanted','blacklist','suspect','missing'), cast(user_id div 5 % 5 + 1 as int))").alias("category"),
        F.expr("element_at(array('low','medium','high','critical'), cast(user_id % 4 + 1 as int))").alias("severity"),
        F.expr("case when user_id % 3 = 0 then null else element_at(array('car','motorcycle','bus','truck'), cast(user_id % 4 + 1 as int)) end").alias("entry_class"),
        F.expr("case when user_id % 10 = 0 then null else element_at(array('white','silver','black','red','blue','yellow','green'), cast((user_id * 13) % 7 + 1 as int)) end").alias("entry_colour"),
        F.expr("user_id % 35 <> 0").alias("active"),
    )


WATCHLIST = """watchlist as (
  select user_id as entry_id, concat('GJ', lpad((user_id % 38 + 1)::varchar, 2, '0'), chr((65 + user_id % 26)::int),
      chr((65 + (user_id * 7) % 26)::int), lpad(((user_id * 7919) % 10000)::varchar, 4, '0')) as plate,
    ['stolen','wanted','blacklist','suspect','missing'][(user_id // 5 % 5 + 1)::int] as category,
    ['low','medium','high','critical'][(user_id % 4 + 1)::int] as severity,
    case when user_id % 3 <> 0 then ['car','motorcycle','bus','truck'][(user_id % 4 + 1)::int] end as entry_class,
    case when user_id % 10 <> 0 then ['white','silver','black','red','blue','yellow','green'][((user_id * 13) % 7 + 1)::int] end as entry_colour,
    user_id % 35 <> 0 as active
  from (select distinct user_id from events where user_id % 5 = 0)
)"""

FOLD = "translate(regexp_replace(upper(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'OQDILSBZGT', '0001158267')"


def fold_sql(column: str) -> str:
    return FOLD.format(column)


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371.0::double * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn towards the first vector of their label, so that equal labels look alike."""
    e = raw(spark, sf_dir, "embeddings").where("embedding is not null")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    mixed = F.zip_with("centre", "embedding", lambda c, x: 0.9 * c.cast("double") + 0.436 * x.cast("double"))
    out = e.join(first, "label").select("vec_id", "label", mixed.alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    # the norm stands beside each component: named in a transform, it would be worked out anew for each
    return out.select("vec_id", "label", F.zip_with("m", F.array_repeat(norm, F.size("m")), lambda x, n: x / n).alias("v"))


BLENDED = """blended as (
  select vec_id, label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as v from (
    select e.vec_id, e.label, list_transform(list_zip(c.centre, e.embedding), lambda p: 0.9::double * p[1]::double + 0.436::double * p[2]::double) as m
    from embeddings e join (select label, arg_min(embedding, vec_id) as centre from embeddings group by label) c using (label)
  )
)"""
