"""Traffic buckets, hourly norms and what departs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up
from ..params import Baseline


def buckets(sightings: DataFrame, cameras: DataFrame, first: int | None = None, last: int | None = None, hour_us: int = 3_600_000_000) -> DataFrame:
    """Counts per camera and hour from bucket `first` to `last`, empty hours included; cumulative_total is the running
    count of the camera. Without these bounds, the hours are those from the first sighting to the last, by all cameras.

    Counts are made before the grid of cameras x hours, whose size the number of sightings doesn't change."""
    counted = sightings.groupBy("camera_id", F.floor(F.col("wall_us") / hour_us).alias("bucket")).agg(F.count("*").alias("total"))
    span = sightings.agg(F.min("wall_us").alias("a"), F.max("wall_us").alias("b")).select(
        F.lit(first).cast("long").alias("a") if first is not None else F.floor(F.col("a") / hour_us).alias("a"),
        F.lit(last).cast("long").alias("b") if last is not None else F.floor(F.col("b") / hour_us).alias("b"),
    )
    a, b = span.first()
    every = F.sequence(F.lit(a), F.lit(b)) if a is not None and b is not None and a <= b else F.array().cast("array<long>")
    grid = cameras.select("camera_id").withColumn("bucket", F.explode(every))
    out = grid.join(counted, ["camera_id", "bucket"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    w = Window.partitionBy("camera_id").orderBy("bucket")
    return out.withColumn("cumulative_total", F.sum("total").over(w)).withColumn("hour", F.expr("cast(pmod(bucket, 24) as int)"))


def deltas(counters: DataFrame, by: str = "camera_id", order: str = "bucket", value: str = "counter") -> DataFrame:
    """Growth of a counter since the row before; the whole counter at the first row or after a restart."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    restart = before.isNull() | (F.col(value) < before)
    return counters.withColumn("restart", restart).withColumn("delta", F.when(restart, F.col(value)).otherwise(F.col(value) - before))


def class_deltas(now: Column, before: Column) -> Column:
    """Positive growth by class of two maps of counts; an unknown class counts from nothing."""
    grown = F.map_zip_with(now, before, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return F.map_filter(grown, lambda k, v: v > 0)


def learn(stats: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one sample) and samples per camera and hour. Rows without camera, hour or total
    teach nothing, nor do those of the old format: a total without a cumulative one."""
    fit = stats.where("camera_id is not null and hour is not null and total is not null")
    fit = fit.where(~((F.coalesce("cumulative_total", F.lit(-1)) == 0) & (F.col("total") > 0)))
    return fit.groupBy("camera_id", "hour").agg(
        F.avg("total").alias("mean"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("stdev"), F.count("*").alias("samples")
    )


def assess(readings: DataFrame, norms: DataFrame, params: Baseline = Baseline(), now_us: int | None = None) -> DataFrame:
    """Readings (camera_id, hour, total, bucket_us) with z_score and status. A reading older than the limit is stale and
    not judged; under the least number of samples there is no verdict. Bands are taken on z rounded to two places."""
    r = readings.join(norms, ["camera_id", "hour"], "left")
    z = half_up((F.col("total") - F.col("mean")) / F.greatest("stdev", F.lit(params.stdev_floor)), 2)
    stale = F.lit(False) if now_us is None else (F.lit(now_us) - F.col("bucket_us")) / 1e6 > params.max_bucket_age_s
    judged = ~stale & (F.coalesce("samples", F.lit(0)) >= params.min_samples)
    r = r.withColumn("z_score", F.when(judged, z))
    status = (
        F.when(stale, "stale")
        .when(F.col("z_score").isNull(), "insufficient_data")
        .when((F.col("total") == 0) & (F.col("z_score") <= params.z_low), "quiet")
        .when(F.col("z_score") >= params.z_high, "high")
        .when(F.col("z_score") >= params.z_elevated, "elevated")
        .when(F.col("z_score") <= params.z_low, "low")
        .otherwise("normal")
    )
    return r.withColumn("status", status)


def band(norms: DataFrame, params: Baseline = Baseline()) -> DataFrame:
    """Expected range per camera and hour, only where there are samples enough."""
    sd = F.greatest("stdev", F.lit(params.stdev_floor))
    ok = F.col("samples") >= params.min_samples
    return norms.select("camera_id", "hour", F.when(ok, F.greatest(F.lit(0.0), F.col("mean") - 2 * sd)).alias("low"), F.when(ok, F.col("mean") + 2 * sd).alias("high"))
