"""Recordings that play again, sequences cut by day, payloads that say what they bring, figures of a write."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import registry, retention, vision
from sightline.params import Dark
from sightline.sources.recording import Player, recording
from sightline.streaming import keyed, live


def played(spark, path, out, loops, batch):
    s = recording(spark, path, "t", loops, batch)
    return live.run_to_end(s, "played", at=out)


def test_recording_plays_again_over_restarts(spark, tmp_path):
    """Several files and row groups; each run is a trigger; loops begin anew in the middle of one."""
    at = f"{tmp_path}/in"
    spark.range(250).selectExpr("id", "id * 40 + 7 as t", "cast(id as string) as s").repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 512).parquet(at)
    counts = []
    for _ in range(7):
        out = played(spark, at, f"file://{tmp_path}/out", 2, 100)
        counts.append(out.count())
    assert counts == [100, 200, 300, 400, 500, 500, 500]
    want = [(i, i * 40 + 7, str(i), loop, i * 40) for loop in (0, 1) for i in range(250)]
    assert [tuple(r) for r in out.orderBy("loop", "id").select("id", "t", "s", "loop", "pts_ms").collect()] == want
    player = Player(at, "t", 2, 100)
    rows, end = player.read({"loop": 0, "position": 200})
    assert end == {"loop": 1, "position": 50} and [(r[0], r[3]) for r in rows] == [(i, 0) for i in range(200, 250)] + [(i, 1) for i in range(50)]
    assert [r[0] for r in player.readBetweenOffsets({"loop": 0, "position": 90}, {"loop": 0, "position": 130})] == list(range(90, 130))


@pytest.mark.parametrize("step", [90, 250, 1000])
def test_tasks_read_what_the_player_gives(spark, tmp_path, step):
    """Up to `until` a run, the rows and offsets are those of the player; nothing passes through the driver."""
    at = f"{tmp_path}/in"
    spark.range(250).selectExpr("id", "case when id % 9 < 8 then id * 40 + 7 end as t", "cast(id as string) as s").repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 512).parquet(at)
    player = Player(at, "t", 3, 10_000)
    want = list(player.read(player.initialOffset())[0])
    to = 0
    while to < 750:
        to += step
        out = live.run_to_end(recording(spark, at, "t", 3, until=to), "x", at=f"file://{tmp_path}/out")
        assert out.count() == min(to, 750)
    assert [tuple(r) for r in out.orderBy("loop", "id").collect()] == want
    assert live.run_to_end(recording(spark, at, "t", 3, until=to), "x", at=f"file://{tmp_path}/out").count() == 750


def test_empty_recording_until(spark, tmp_path):
    spark.range(0).selectExpr("id", "id as t").write.parquet(f"{tmp_path}/none")
    assert live.run_to_end(recording(spark, f"{tmp_path}/none", "t", 3, until=10), "x", at=f"file://{tmp_path}/out").count() == 0


def test_empty_recording_and_options(spark, tmp_path):
    spark.range(0).selectExpr("id", "id as t").write.parquet(f"{tmp_path}/none")
    assert played(spark, f"{tmp_path}/none", f"file://{tmp_path}/out", 3, 10).count() == 0
    with pytest.raises(Exception, match="time column"):
        spark.readStream.format("recording").option("path", f"{tmp_path}/none").load().writeStream.format("noop").start().processAllAvailable()


def test_played_loops_reset_tracks(spark, tmp_path):
    """The clock that falls back is what ends tracks; ids go on."""
    rows = [(i, 1000 * i, "c", "car", 0, 0, 10, 10, None) for i in range(20)]
    spark.createDataFrame(rows, "id long, t long, camera_id string, vehicle_class string, x1 long, y1 long, x2 long, y2 long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(3):
        s = recording(spark, f"{tmp_path}/in", "t", 3, 25)
        out = live.run_to_end(keyed.live_tracks(s, ["loop", "t"]), "x", at=f"file://{tmp_path}/run", keyed=True)
    assert sorted((r["loop"], r["track"], r["count"]) for r in out.groupBy("loop", "track").count().collect()) == [(0, 1, 20), (1, 2, 20), (2, 3, 20)]


# -- sequences cut by part


@pytest.mark.parametrize("seed", range(4))
def test_parts_change_nothing(spark, seed):
    """Runs and cuts at, over and between the edges of parts, parts without rows, cameras of one row."""
    rng = random.Random(seed)
    rows, pts = [], {}
    for i in range(500):
        c = rng.choice("aab") if i else "one"
        pts[c] = rng.choice([0, pts.get(c, 0) + 500, pts.get(c, 0) + 500, max(0, pts.get(c, 0) - 1900)])
        rows.append((i, c, pts[c], i // (7 + 3 * seed) + (5 if i > 250 else 0), rng.choice([5, 5, 5, 90]) if i % 100 < 80 else 5, int(rng.random() < 0.05)))
    f = spark.createDataFrame(rows, "seq long, camera_id string, pts_ms long, day long, luma long, found long")
    one = lambda df: sorted(map(tuple, df.select("camera_id", "seq", "cut", "epoch").collect()))
    assert one(vision.epochs_in_parts(f, "day")) == one(vision.epochs(f))
    p = Dark(streak=4)
    runs = lambda df: sorted(map(tuple, df.select("camera_id", "first", "last", "frames").collect()))
    assert runs(vision.dark_streaks_in_parts(f, "day", params=p)) == runs(vision.dark_streaks(f, params=p)) != []


def test_a_run_over_many_parts(spark):
    f = spark.range(100).selectExpr("id as seq", "'c' as camera_id", "id div 10 as day", "cast(if(id in (3, 97), 90, 5) as long) as luma", "0L as found")
    assert [tuple(r) for r in vision.dark_streaks_in_parts(f, "day").select("first", "last", "frames").collect()] == [(4, 96, 93)]


# -- payloads


OLD = "camera_id string, name string, city string, lat double, capability string, department string, enabled boolean"


def test_supplied_nulls_overwrite_and_absent_keys_do_not(spark):
    old = spark.createDataFrame([("c1", "One", "Surat", 21.0, "anpr", "Police", False), ("c2", "Two", None, None, "degraded", None, True)], OLD)
    patches = spark.createDataFrame(
        [
            ("c1", 1, ["name", "city"], "First", None, 5.0, None), ("c1", 2, ["lat"], "unsaid", "unsaid", None, None),
            ("c3", 1, ["name"], "Three", "unsaid", 9.0, None), ("c4", 1, ["name", "capability", "what"], "Four", None, None, None),
            ("c4", 2, ["name"], None, None, None, "anpr"), ("c2", 1, [], "unsaid", "unsaid", 1.0, "anpr"), ("c5", 1, None, "unsaid", None, None, None),
        ],
        "camera_id string, seq int, present array<string>, name string, city string, lat double, capability string",
    )
    got = registry.merge_present(old, patches, "camera_id", "seq", registry.CREATE_DEFAULTS)
    assert got.columns == old.columns and got.dtypes == old.dtypes
    assert {r.camera_id: tuple(r)[1:] for r in got.collect()} == {
        "c1": ("First", None, None, "anpr", "Police", False),
        "c2": ("Two", None, None, "degraded", None, True),
        "c3": ("Three", None, None, "vehicle", "Home Department", True),
        "c4": (None, None, None, None, "Home Department", True),
        "c5": (None, None, None, "vehicle", "Home Department", True),
    }


def test_own_feed(spark):
    asked = spark.createDataFrame([("/v/drive.mp4", None, None, None, None, None, None, None, 1), ("/v/b.mp4", "c1", "Mine", "Surat", "D", 1.0, 2.0, "person", 2), ("", "c9", None, None, None, None, None, None, 3)],
        "path string, camera_id string, name string, city string, district string, lat double, lon double, capability string, seq int")
    old = spark.createDataFrame([("c1", "One", "Old", 9.0, "anpr", "Police", False)], OLD)
    got = {r.camera_id: r for r in registry.merge_present(old, registry.own_feeds(asked), "camera_id", "seq", registry.CREATE_DEFAULTS).collect()}
    new = next(r for k, r in got.items() if k.startswith("own"))
    assert len(got) == 2 and (new.name, new.city, new.lat, new.capability, new.department, new.enabled) == ("Own feed - drive.mp4", "Participant footage", None, "anpr", "Participant", True)
    assert tuple(got["c1"]) == ("c1", "Mine", "Surat", 1.0, "person", "Participant", False)


# -- figures


def test_figures_are_those_of_before_and_after(spark, tmp_path):
    s = spark.createDataFrame([(i, i % 4 or None, [True, False, None][i % 3], i * 1000) for i in range(100)], "id long, scene_us long, corroborated boolean, wall_us long")
    told = retention.purged(s, f"{tmp_path}/purge")
    after = spark.read.parquet(f"{tmp_path}/purge")
    assert told == {"rows": 100, "clocked_before": s.where("scene_us is not null").count(), "clocked_after": after.where("scene_us is not null").count()}
    assert sorted(map(str, after.select(*s.columns).collect())) == sorted(map(str, retention.purge_scene_times(s).collect()))
    needed = s.where("id % 9 = 0").select("id")
    told = retention.pruned_rows(s, needed, f"{tmp_path}/rows", 10**12, 60, 1)
    assert told == {"rows_before": 100, "rows_after": 60} and spark.read.parquet(f"{tmp_path}/rows").count() == 60
    files = s.select("id", F.col("wall_us").alias("mtime_us"), F.lit(10).alias("bytes"), (F.col("id") % 10 == 0).alias("open"))
    told = retention.pruned_files(files, f"{tmp_path}/files", 90_000, 300, 10**6)
    left = spark.read.parquet(f"{tmp_path}/files").where("verdict in ('kept', 'protected')")
    assert (told["files_before"], told["files_after"], told["bytes_after"]) == (100, left.count(), 10 * left.count()) and told["bytes_after"] <= 300
    assert retention.purged(s.limit(0), f"{tmp_path}/none") == {"rows": 0, "clocked_before": 0, "clocked_after": 0}
