"""The camera roster: checks, states, imports, gaps, and who may do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPABILITIES = ["anpr", "vehicle", "person", "degraded", "unknown"]
SCHEMES = ["rtsp", "rtsps", "http", "https"]
# Permissions of the roles.
PERMISSIONS = [
    ("viewer", "read"),
    ("operator", "read"),
    ("operator", "operate"),
    ("admin", "read"),
    ("admin", "operate"),
    ("admin", "manage"),
]


URLS = ["rtsp_url", "hls_url"]


def payload_error() -> Column:
    """The first rule that a roster row breaks, null if none. Texts are trimmed first; an empty url is none; a size may
    be missing, but not other than whole."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    urls = [text(c) for c in URLS]
    none, wrong = F.lit(True), F.lit(False)
    for u in urls:
        none, wrong = none & (u == ""), wrong | ((u != "") & ~u.rlike(f"^({'|'.join(SCHEMES)})://"))
    whole = lambda c: F.col(c).isNull() | text(c).rlike(r"^[+-]?\d+$")
    return (
        F.when(~text("camera_id").rlike(r"^[A-Za-z0-9_-]{2,32}$"), "id")
        .when(text("name") == "", "name")
        .when(~F.col("lat").between(-90, 90), "lat")
        .when(~F.col("lon").between(-180, 180), "lon")
        .when(none, "url")
        .when(wrong, "scheme")
        .when(~F.col("capability").isin(CAPABILITIES), "capability")
        .when(~whole("width"), "width")
        .when(~whole("height"), "height")
    )


def import_counts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """created, updated, errors: bad rows don't hold up good ones."""
    ids = known.distinct().withColumn("known", F.lit(True))
    r = rows.withColumn("error", payload_error()).join(ids, "camera_id", "left")
    return r.agg(
        F.count_if(F.col("error").isNull() & F.col("known").isNotNull()).alias("updated"),
        F.count_if(F.col("error").isNull() & F.col("known").isNull()).alias("created"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def onboard(old: DataFrame, probe: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Roster after a probe: what it measured replaces the old value, what it lacks stays; cameras of a survey read
    plates unless degraded; new cameras start unknown."""
    named = surveyed.select("camera_id").distinct().withColumn("_surveyed", F.lit(True))
    kept = old.join(named, "camera_id", "left")
    measured = probe.select("camera_id", *[F.col(c).alias(f"_{c}") for c in ("codec", "width")])
    both = kept.withColumn("_old", F.lit(True)).join(measured, "camera_id", "full")
    capability = F.when(F.col("_old").isNull(), "unknown").when((F.col("capability") != "degraded") & F.col("_surveyed"), "anpr").otherwise(F.col("capability"))
    return both.select("camera_id", F.coalesce("_codec", "codec").alias("codec"), F.coalesce("_width", "width").alias("width"), capability.alias("capability"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last new one, else the old."""
    last = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
    return old.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)


def health() -> Column:
    """State of a camera from capability, live, connected, stale_s and dark; the order of the rules matters."""
    return (
        F.when(F.col("capability") == "degraded", "degraded")
        .when(~F.col("live"), "not-started")
        .when(~F.col("connected") | F.col("stale_s").isNull() | (F.col("stale_s") > 30), "offline")
        .when((F.col("stale_s") > 5) | F.col("dark"), "degraded")
        .otherwise("online")
    )


def basic_health(reconnects: Column) -> Column:
    """The coarser state that a client can tell by itself."""
    return (
        F.when(~F.col("live"), "not-started")
        .when(~F.col("connected"), "offline")
        .when((F.col("stale_s") > 5) | (reconnects > 3), "degraded")
        .otherwise("online")
    )


def frame_state() -> Column:
    return (
        F.when(~F.col("has_frame"), "down")
        .when(F.col("mean_luma") < 28, "black")
        .when(F.col("mean_luma") > 235, "overexposed")
        .when(F.col("banding") > 40, "corrupt")
        .otherwise("usable")
    )


def gaps(cameras: DataFrame) -> DataFrame:
    """Counts and shares by capability, by city and overall, in one pass of grouping sets; `gap_members` has the cameras."""
    share = lambda c: F.floor(1000.0 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)) + 0.5) / 10
    by_cap, by_city = F.grouping("capability") == 0, F.grouping("city") == 0
    out = cameras.withColumn("city", F.coalesce("city", F.lit("unknown"))).groupingSets([["capability"], ["city"], []], "capability", "city").agg(
        F.when(by_cap, "capability").when(by_city, "city").otherwise("all").alias("kind"),
        F.when(by_cap, F.col("capability")).when(by_city, F.col("city")).alias("value"),
        F.count("*").alias("n"),
        share(F.col("capability") == "anpr").alias("anpr_pct"),
        share(F.col("capability") != "degraded").alias("usable_pct"),
    )
    return out.select("kind", "value", "n", "anpr_pct", "usable_pct")


def gap_members(cameras: DataFrame) -> DataFrame:
    """The cameras of each capability and of each city, one row each, so that no list grows with the roster."""
    groups = {"capability": F.col("capability"), "city": F.coalesce("city", F.lit("unknown"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in groups.items()]))
    return cameras.select("camera_id", each.alias("g")).select("g.kind", "g.value", "camera_id")


def merge_feeds(history: DataFrame, live: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """History and live rows, history first where both have a key, newest first."""
    both = history.withColumn("origin", F.lit("history")).unionByName(live.withColumn("origin", F.lit("live")))
    first = Window.partitionBy(key).orderBy(F.col("origin") == "live")
    return both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").orderBy(F.desc(order), key).limit(limit)


def permissions(roles: DataFrame) -> DataFrame:
    """For each row of roles and each permission, whether the role has it; an unknown role has none."""
    spark = roles.sparkSession
    table = spark.createDataFrame(PERMISSIONS, "role string, permission string").withColumn("has", F.lit(True))
    every = F.explode(F.array(*[F.lit(p) for p in ("read", "operate", "manage")]))
    out = roles.withColumn("permission", every).join(F.broadcast(table), ["role", "permission"], "left")
    return out.select("event_type", "role", "permission", F.coalesce("has", F.lit(False)).alias("allowed"))


# Who a caller without a key is, by mode.
NOBODY = {"open": ("anonymous", "admin", "open-mode"), "enforced": ("anonymous", "viewer", "anon")}


def principals(requests: DataFrame, keys: DataFrame, mode: str) -> DataFrame:
    """requests(key) with name, role and fingerprint of the caller, all null where refused; keys(key, name, role).

    open (there are no keys): all are admins, whatever they present. enforced: an empty key reads, a known key has its
    role, an unknown one is refused. unreadable (keys there, but broken): all are refused.
    """
    said = ("name", "role", "fingerprint")
    if mode == "unreadable":
        return requests.select("*", *[F.lit(None).cast("string").alias(c) for c in said])
    if mode == "open":
        return requests.select("*", *[F.lit(v).alias(c) for c, v in zip(said, NOBODY["open"], strict=True)])
    if mode != "enforced":
        raise ValueError(f"unknown mode of access: {mode}")
    empty = F.coalesce("key", F.lit("")) == ""
    held = keys.select("key", F.col("name").alias("_name"), F.col("role").alias("_role"), F.substring(F.sha2("key", 256), 1, 12).alias("_fingerprint"))
    out = requests.join(held, "key", "left")
    return out.select(*requests.columns, *[F.when(empty, v).otherwise(F.col(f"_{c}")).alias(c) for c, v in zip(said, NOBODY["enforced"], strict=True)])


def zone_errors(zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """zones (zone_id, camera_id, rule, points) with the first rule that each breaks, null if none."""
    known = cameras.select("camera_id").withColumn("known", F.lit(True))
    out_of_range = F.exists("points", lambda p: ~p["x"].between(0, 1) | ~p["y"].between(0, 1))
    error = (
        F.when(~F.col("rule").isin("intrusion", "crossing", "loitering"), "rule")
        .when(F.size("points") < F.when(F.col("rule") == "crossing", 2).otherwise(3), "points")
        .when(out_of_range, "range")
        .when(F.col("known").isNull(), "camera")
    )
    return zones.join(known, "camera_id", "left").withColumn("error", error).drop("known")


# What a new camera has where its payload doesn't say.
CREATE_DEFAULTS = {"capability": "vehicle", "department": "Home Department", "enabled": True}


def merge_present(old: DataFrame, patches: DataFrame, key: str, order: str, defaults: dict | None = None) -> DataFrame:
    """old after patches(key, order, present array<string>, and columns of old): a column that a patch names in `present`
    takes its value, null too; one that it doesn't name stays, or takes its default in a row that is new.

    Patches of one key are merged first, each column from the last patch that names it, in one aggregation that is
    combined before its shuffle; then both sides meet on the key. A name in `present` that old lacks changes nothing.
    """
    defaults, columns = defaults or {}, [c for c in old.columns if c != key]
    named = lambda c: F.array_contains("present", c)
    last = patches.groupBy(key).agg(*[F.max_by(F.when(named(c), F.struct(F.col(c).alias("v"))), F.when(named(c), F.col(order))).alias(f"_{c}") for c in columns if c in patches.columns])
    both = old.withColumn("_old", F.lit(True)).join(last, key, "full")

    def value(c: str) -> Column:
        kept = F.coalesce(F.when(F.col("_old"), F.col(c)), F.when(F.col("_old").isNull(), F.lit(defaults.get(c)))).cast(old.schema[c].dataType)
        return (F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(kept) if f"_{c}" in both.columns else kept).alias(c)

    return both.select(key, *map(value, columns))


def own_feeds(requests: DataFrame) -> DataFrame:
    """Patches for merge_present of requests(path, camera_id, name, city, district, lat, lon, capability, seq) to take a
    local recording for a camera: what is missing gets the names of own footage, and its plates can be read."""
    base = F.element_at(F.split("path", "/"), -1)
    own = requests.where("path is not null and path <> ''").select(
        F.coalesce("camera_id", F.concat(F.lit("own"), F.lpad((F.crc32("path") % 1000).cast("string"), 3, "0"))).alias("camera_id"),
        F.coalesce("name", F.concat(F.lit("Own feed - "), base)).alias("name"),
        F.coalesce("city", F.lit("Participant footage")).alias("city"),
        F.coalesce("district", F.lit("Own feed")).alias("district"),
        F.lit("Participant").alias("department"), "lat", "lon",
        F.coalesce("capability", F.lit("anpr")).alias("capability"), F.lit("ok").alias("health"), F.col("path").alias("rtsp_url"), "seq",
    )
    said = [c for c in own.columns if c not in ("camera_id", "seq")]
    return own.withColumn("present", F.array(*map(F.lit, said)))


def first_source(roster: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str, default: str, rest: str) -> DataFrame:
    """The value of the first source that has the key, and that source's name."""
    out = roster
    for name, rows in sources:
        out = out.join(rows.select(key, F.col(value).alias(f"_{name}")), key, "left")
    held = [F.col(f"_{name}") for name, _ in sources]
    source = F.coalesce(*[F.when(c.isNotNull(), name) for c, (name, _) in zip(held, sources, strict=True)], F.lit(rest))
    return out.select(key, F.coalesce(*held, F.lit(default)).alias(value), source.alias("source"))


def acknowledge(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets the flag of the alerts named."""
    named = ids.distinct().withColumn("_named", F.lit(True))
    return alerts.join(named, "alert_id", "left").withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_named", F.lit(False))).drop("_named")


def edit_watchlist(entries: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries after additions, plates upper-cased without blanks and not empty, and removals by id."""
    new = added.withColumn("plate", F.upper(F.regexp_replace("plate", " ", ""))).where("plate <> ''")
    return entries.unionByName(new).join(removed.distinct(), "entry_id", "left_anti").select(*entries.columns)
