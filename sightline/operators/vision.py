"""Per-camera sequences: loop cuts, sampling, clocks, dark streaks, tracks and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, iou, segments_cross, side_of
from ..params import Clock, Dark, Frame, Track
from .folds import Spaced, streamed


def epochs(frames: DataFrame, by: str = "camera_id", order: str = "seq", pts: str = "pts_ms", tolerance_ms: int = Clock.live_tolerance_ms) -> DataFrame:
    """Adds `cut` (the stream clock fell back by more than the tolerance) and `epoch`, the number of cuts so far."""
    w = Window.partitionBy(by).orderBy(order)
    cut = F.coalesce(F.col(pts) + tolerance_ms < F.lag(pts).over(w), F.lit(False))
    marked = frames.withColumn("cut", cut)
    return marked.withColumn("epoch", F.sum(F.col("cut").cast("long")).over(w))


def epochs_in_parts(frames: DataFrame, part: str, by: str = "camera_id", order: str = "seq", pts: str = "pts_ms", tolerance_ms: int = Clock.live_tolerance_ms) -> DataFrame:
    """epochs, where no task holds more than one part of a camera, such as its day: all rows of a part come before those
    of a larger one. What parts hand on is a row each: their first and last stream time and the cuts inside them."""
    w = Window.partitionBy(by, part).orderBy(order)
    before = F.lag(pts).over(w)
    marked = frames.withColumns({"_inner": F.coalesce(F.col(pts) + tolerance_ms < before, F.lit(False)), "_first": F.row_number().over(w) == 1})
    ends = marked.groupBy(by, part).agg(F.min_by(pts, order).alias("_a"), F.max_by(pts, order).alias("_b"), F.count_if("_inner").alias("_cuts"))
    line = Window.partitionBy(by).orderBy(part)  # a row a part
    edge = F.coalesce(F.col("_a") + tolerance_ms < F.lag("_b").over(line), F.lit(False))
    ends = ends.withColumn("_edge", edge)
    earlier = F.sum(F.col("_cuts") + F.col("_edge").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(by, part, "_edge", (F.coalesce(earlier, F.lit(0)) + F.col("_edge").cast("long")).alias("_base"))
    out = marked.join(ends, [by, part]).withColumn("cut", F.col("_inner") | (F.col("_first") & F.col("_edge")))
    return out.withColumn("epoch", F.col("_base") + F.sum(F.col("_inner").cast("long")).over(w)).select(*frames.columns, "cut", "epoch")


def loop_length(frames_with_epochs: DataFrame, by: str = "camera_id") -> DataFrame:
    """Longest stream time of the first complete epoch, one that a cut began and a cut ended; null without one."""
    e = frames_with_epochs.groupBy(by, "epoch").agg(F.max("pts_ms").alias("longest"))
    last = e.groupBy(by).agg(F.max("epoch").alias("last"), F.max(F.when(F.col("epoch") == 1, F.col("longest"))).alias("first_full"))
    return last.select(by, F.when(F.col("last") >= 2, F.col("first_full")).alias("loop_ms"))


def measured_fps(frames: DataFrame, by: list[str], order: str = "seq", span: int = 60, least: int = 10) -> DataFrame:
    """Frames a second over the last `span` frames, null under `least`."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(span - 1), 0)
    n, first, last = F.count("*").over(w), F.first("pts_ms").over(w), F.last("pts_ms").over(w)
    return frames.withColumn("fps", F.when((n >= least) & (last > first), (n - 1) / ((last - first) / 1000.0)))


def sampled(frames: DataFrame, by: list[str], interval_ms: int) -> DataFrame:
    """Frames that are emitted: the first of each group, then those at least the interval after the last emitted."""
    f = frames.select(*by, F.col("id").cast("long").alias("id"), F.col("pts_ms").cast("long").alias("pts_ms"))
    return streamed(f, by, ["pts_ms", "id"], lambda: Spaced("pts_ms", interval_ms, [*by, "id", "pts_ms"]), f.schema)


def cooled(alerts: DataFrame, key: str, cooldown_us: int) -> DataFrame:
    """Alerts that are sent: none within the cooldown of the last one *sent* for its key."""
    a = alerts.select(key, "alert_id", "wall_us")
    return streamed(a, [key], ["wall_us", "alert_id"], lambda: Spaced("wall_us", cooldown_us, [key, "alert_id", "wall_us"]), a.schema)


def corroborated(readings: DataFrame, by: list[str], params: Clock = Clock()) -> DataFrame:
    """Readings (pts_ms, seconds) that anchor a clock: each agrees, within the tolerance, with where the reading before
    it would be by now. A reading that disagrees becomes the one to agree with."""
    w = Window.partitionBy(*by).orderBy("pts_ms", "id")
    expected = F.lag("seconds").over(w) + (F.col("pts_ms") - F.lag("pts_ms").over(w)) / 1000.0
    return readings.withColumn("anchors", F.coalesce(F.abs(F.col("seconds") - expected) <= params.agree_s, F.lit(False)))


def dark_streaks(frames: DataFrame, by: str = "camera_id", order: str = "seq", params: Dark = Dark()) -> DataFrame:
    """Runs of at least `streak` frames that are dark and without a find; any other frame ends a run."""
    w = Window.partitionBy(by).orderBy(order)
    dark = (F.col("luma") < params.luma) & (F.col("found") == 0)
    f = frames.withColumn("dark", dark).withColumn("island", F.sum((~dark).cast("long")).over(w))
    runs = f.where("dark").groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))
    return runs.where(F.col("frames") >= params.streak).drop("island")


def dark_streaks_in_parts(frames: DataFrame, part: str, by: str = "camera_id", order: str = "seq", params: Dark = Dark()) -> DataFrame:
    """dark_streaks, where no task holds more than one part of a camera; see epochs_in_parts. Runs are found inside the
    parts; those that touch the edge of one, two a part at most, are then sewn to those of the next."""
    w = Window.partitionBy(by, part).orderBy(order)
    dark = (F.col("luma") < params.luma) & (F.col("found") == 0)
    f = frames.withColumn("dark", dark).withColumn("island", F.sum((~dark).cast("long")).over(w))
    sizes = f.groupBy(by, part).agg(F.count_if(~F.col("dark")).alias("breaks"))
    sizes = sizes.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(part)))  # a row a part
    runs = f.where("dark").groupBy(by, part, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))
    runs = runs.join(sizes, [by, part]).withColumns({"opens": F.col("island") == 0, "stays": F.col("island") == F.col("breaks")})
    inner = runs.where("not opens and not stays").select(by, "first", "last", "frames")
    line = Window.partitionBy(by).orderBy("first")
    goes_on = F.coalesce(F.col("opens") & F.lag("stays").over(line) & (F.lag("nth").over(line) + 1 == F.col("nth")), F.lit(False))
    edges = runs.where("opens or stays").withColumn("fresh", ~goes_on)
    edges = edges.withColumn("run", F.sum(F.col("fresh").cast("long")).over(line))
    sewn = edges.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("frames").alias("frames"))
    return inner.unionByName(sewn.drop("run")).where(F.col("frames") >= params.streak)


def top_of_frame(detections: DataFrame, params: Frame = Frame()) -> DataFrame:
    """Detections worth an embedding (tall enough, largest first) or a plate read (taller, tallest first)."""
    h, area = F.col("y2") - F.col("y1"), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    d = detections.withColumns({"h": h, "area": area})
    by = lambda ok, c: F.when(ok, F.row_number().over(Window.partitionBy("camera_id", "frame", ok).orderBy(F.desc(c), "id")))
    d = d.withColumn("embed_rank", by(F.col("h") >= params.embed_height, "area")).withColumn("plate_rank", by(F.col("h") >= params.plate_height, "h"))
    return d.withColumn("embed", F.coalesce(F.col("embed_rank") <= params.embed_count, F.lit(False))).withColumn("read_plate", F.coalesce(F.col("plate_rank") <= params.plate_count, F.lit(False)))


def track_shape(points: DataFrame, by: list[str], order: list[str], params: Track = Track()) -> DataFrame:
    """Per track: sightings, dwell and direction of travel from its first to its last centre, null if it hardly moved."""
    ends = points.groupBy(*by).agg(
        F.count("*").alias("sightings"), ((F.max("pts_ms") - F.min("pts_ms")) / 1000.0).alias("dwell_s"),
        F.min_by(F.struct("cx", "cy"), F.struct(*order)).alias("a"), F.max_by(F.struct("cx", "cy"), F.struct(*order)).alias("b"),
        F.max_by("vehicle_class", F.struct(*order)).alias("vehicle_class"),
    )
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    still = (F.col("sightings") < 2) | (F.sqrt(dx * dx + dy * dy) < params.min_travel_px)
    way = F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "down").otherwise("up"))
    return ends.withColumn("direction", F.when(~still, way))


def zone_tests(points: DataFrame, zones: DataFrame, width: int, height: int) -> DataFrame:
    """Rows (zone_id, side and the columns of points) for each zone whose rule a point breaks.

    points (camera_id, vehicle_class, cx, cy, pts_ms, px, py of the track's centre before, since when it is there),
    zones (zone_id, camera_id, rule, points array<struct<x,y>>, classes, dwell_s). Intrusion: in the polygon. Loitering:
    in it, the track's time so far at least dwell_s. Crossing: the last step cuts the line. Zones are a small dimension;
    geometry is expressions.
    """
    z = zones.withColumn("points", F.transform("points", lambda q: F.struct((q["x"] * width).alias("x"), (q["y"] * height).alias("y"))))
    j = points.join(F.broadcast(z), "camera_id").where((F.size("classes") == 0) | F.array_contains("classes", F.col("vehicle_class")))
    inside = in_polygon(F.col("cx"), F.col("cy"), F.col("points"))
    a, b = (F.get("points", F.lit(0))["x"], F.get("points", F.lit(0))["y"]), (F.get("points", F.lit(1))["x"], F.get("points", F.lit(1))["y"])
    crossed = F.coalesce(segments_cross((F.col("px"), F.col("py")), (F.col("cx"), F.col("cy")), a, b), F.lit(False))
    stayed = (F.col("pts_ms") - F.col("since")) / 1000.0 >= F.col("dwell_s")
    hit = F.when(F.col("rule") == "intrusion", inside).when(F.col("rule") == "loitering", inside & stayed).when(F.col("rule") == "crossing", crossed)
    return j.where(hit).withColumn("side", F.when(F.col("rule") == "crossing", side_of(a, b, (F.col("cx"), F.col("cy")))))


def zone_hits(points: DataFrame, zones: DataFrame, width: int, height: int, by: list[str], order: list[str]) -> DataFrame:
    """One row for each zone and track that breaks the zone's rule, at its first sighting that does; see zone_tests.
    points has the columns of `by` and `order` too."""
    w = Window.partitionBy(*by).orderBy(*order)
    p = points.withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w), "since": F.min("pts_ms").over(w)})
    first = Window.partitionBy("zone_id", *by).orderBy(*order)
    return zone_tests(p, zones, width, height).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


CELL = 64  #: pixels of a cell's side


def overlaps(boxes: DataFrame, least: float = Track.base_iou) -> DataFrame:
    """Pairs of boxes of one camera and frame that overlap enough, which is more than nothing.

    Boxes meet in cells of the picture: the one further left stands in every cell that it covers but for the columns too
    near its right edge to leave a share of `least`, the other in those of its left column; the pair counts in the cell
    that has the upper left corner of what they share."""
    if least <= 0:
        raise ValueError("boxes that share nothing don't meet")
    cell = lambda c: F.floor(c / CELL)
    b = boxes.select("camera_id", "frame", "id", "x1", "y1", "x2", "y2")
    rows = F.explode(F.sequence(cell(F.col("y1")), cell(F.col("y2")))).alias("row")
    last = F.greatest(F.col("x1"), F.col("x2") - least * (F.col("x2") - F.col("x1")) + 1)
    left = b.select("*", F.sequence(cell(F.col("x1")), cell(last)).alias("columns"), rows)
    left = left.select(*b.columns, "row", F.explode("columns").alias("column")).alias("a")
    right = b.select("*", cell(F.col("x1")).alias("column"), rows).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("camera_id", "frame", "row", "column")]
    first = (F.col("a.x1") < F.col("b.x1")) | ((F.col("a.x1") == F.col("b.x1")) & (F.col("a.id") < F.col("b.id")))
    j = left.join(right, same[0] & same[1] & same[2] & same[3] & first & (F.col("a.row") == cell(F.greatest("a.y1", "b.y1"))))
    j = j.where(F.col("a.id") != F.col("b.id"))
    side = lambda t: [F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")]
    j = j.withColumn("iou", iou(side("a"), side("b"))).where(F.col("iou") >= least)
    return j.select(F.col("a.camera_id").alias("camera_id"), F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), "iou")
