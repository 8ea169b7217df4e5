"""What may be deleted, and what must stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def protected(alerts: DataFrame, zone_events: DataFrame) -> DataFrame:
    """Ids of evidence that an open alert or zone event needs."""
    return alerts.where("not acknowledged").select("id").union(zone_events.where("not acknowledged").select("id")).distinct()


def running_total(df: DataFrame, value: str, order: list[str], buckets: int = 64) -> DataFrame:
    """Adds `before`, the sum of `value` over all earlier rows, without bringing all rows to one task: sums by range
    of the first order column, then inside each range. Ranges are cut at quantiles, so they hold about as many rows
    each however the column clusters."""
    cuts = sorted(set(df.approxQuantile(order[0], [i / buckets for i in range(1, buckets)], 0.25 / buckets)))  # `buckets` numbers
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col(order[0]) > cut).cast("int")
    ranged = df.withColumn("_b", F.coalesce(place, F.lit(-1)))
    line = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("_b").agg(F.sum(value).alias("_s")).select("_b", F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_b").withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.drop("_b", "_start")


def prune_files(files: DataFrame, now_us: int, max_bytes: int, max_age_s: int) -> DataFrame:
    """files (id, mtime_us, bytes, open) with a verdict: protected, expired (too old), budget (oldest first until what
    is left fits) or kept."""
    f = files.withColumn("old", (F.lit(now_us) - F.col("mtime_us")) / 1e6 > max_age_s)
    fixed = F.coalesce(F.sum(F.when(F.col("open"), F.col("bytes"))), F.lit(0))
    free = F.coalesce(F.sum(F.when(~F.col("open") & ~F.col("old"), F.col("bytes"))), F.lit(0))
    total = f.agg((fixed + free).alias("t")).first()["t"]
    live = running_total(f.where("not open and not old"), "bytes", ["mtime_us", "id"]).select("*", F.when(F.lit(total) - F.col("before") > max_bytes, "budget").otherwise("kept").alias("verdict"))
    rest = f.where("open or old").withColumn("verdict", F.when(F.col("open"), "protected").otherwise("expired"))
    return live.drop("before").unionByName(rest)


def prune_rows(rows: DataFrame, needed: DataFrame, now_us: int, cap: int, keep_s: int) -> DataFrame:
    """Ids of the oldest rows over the cap that are old enough and that nothing needs. Their number grows with the table,
    so they are told by their rank, not by a limit over all rows."""
    excess = max(0, rows.count() - cap)
    old = rows.where(F.col("wall_us") < now_us - keep_s * 1_000_000).join(needed.distinct(), "id", "left_anti")
    old = stored(old.select("id", "wall_us", F.lit(1).cast("long").alias("one")), "old")  # read three times
    ranked = running_total(old, "one", ["wall_us", "id"])
    return ranked.where(F.col("before") < excess).select("id")


def purge_scene_times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scene_us", F.when(F.coalesce("corroborated", F.lit(False)), F.col("scene_us")))


def with_figures(rows: DataFrame, path: str, figures: dict[str, Column]) -> dict[str, int]:
    """Writes rows to path and returns figures (aggregates of rows) taken while they are written, in the same pass."""
    told = Observation()
    rows.observe(told, *[v.alias(k) for k, v in figures.items()]).write.parquet(path)
    return dict(told.get)


def purged(rows: DataFrame, path: str) -> dict[str, int]:
    """purge_scene_times of rows, written to path; how many rows there are, had a scene time before and have one after."""
    held = F.col("scene_us").isNotNull()
    kept = held & F.coalesce("corroborated", F.lit(False))
    after = rows.withColumn("_had", held).withColumn("scene_us", F.when(kept, F.col("scene_us")))
    told = {"rows": F.count(F.lit(1)), "clocked_before": F.count_if("_had"), "clocked_after": F.count_if(F.col("scene_us").isNotNull())}
    return with_figures(after, path, told)


def pruned_files(files: DataFrame, path: str, now_us: int, max_bytes: int, max_age_s: int) -> dict[str, int]:
    """prune_files, its verdicts written to path; files and bytes before and after, and what the open ones hold."""
    judged = prune_files(files, now_us, max_bytes, max_age_s)
    stays = F.col("verdict").isin("kept", "protected")
    sum_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    told = {
        "files_before": F.count(F.lit(1)), "bytes_before": sum_of(F.lit(True)), "files_after": F.count_if(stays), "bytes_after": sum_of(stays),
        "files_protected": F.count_if(F.col("verdict") == "protected"), "files_expired": F.count_if(F.col("verdict") == "expired"), "files_over_budget": F.count_if(F.col("verdict") == "budget"),
    }
    return with_figures(judged, path, told)


def pruned_rows(rows: DataFrame, needed: DataFrame, path: str, now_us: int, cap: int, keep_s: int) -> dict[str, int]:
    """rows without those of prune_rows, written to path; how many there were and are."""
    gone = prune_rows(rows, needed, now_us, cap, keep_s).withColumn("_gone", F.lit(True))
    marked = rows.join(gone, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    told = {"rows_before": F.count(F.lit(1)), "rows_after": F.count_if(~F.col("_gone"))}
    watch = Observation()
    marked.observe(watch, *[v.alias(k) for k, v in told.items()]).where("not _gone").drop("_gone").write.parquet(path)
    return dict(watch.get)
