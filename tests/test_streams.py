"""Streams end with what the batch operators give, and go on after a restart."""

import random

import pandas as pd
from pyspark.sql import functions as F

from sightline.operators import matching, movement, retention, retrieval, traffic, votes
from sightline.params import Vote
from sightline.plans.live import newest_verdicts
from sightline.sources.files import replay
from sightline.streaming import live


def reads(n, seed):
    rng = random.Random(seed)
    plates = ["GJ01AB1234", "GJO1AB1234", "GJ01AX1234", "J01AB1234", "GJ1", "GJ05CD0001"]
    return [(f"cam0{rng.randint(1, 2)}", rng.randint(1, 5), i, rng.choice(plates), rng.randint(1, 9) / 10) for i in range(seed * n, seed * n + n)]


SCHEMA = "camera_id string, track_id long, seq long, plate_text string, conf double"


def test_votes_in_state_go_on_after_a_restart(spark, tmp_path):
    at, source = f"file://{tmp_path}/votes", f"{tmp_path}/in"
    every, rows = None, 0
    for part in (1, 2):
        batch = spark.createDataFrame(reads(60, part), SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(source)
        every = batch if every is None else every.union(batch)
        stream = replay(spark, "parquet", source, batch.schema, pattern="*.parquet").withColumn("text", F.col("plate_text"))
        out = live.run_to_end(live.voted(stream.select("camera_id", "track_id", "seq", "text", "conf")), "votes", at=at)
        want = votes.consensus(every, ["camera_id", "track_id"]).select("camera_id", "track_id", "plate", F.round("confidence", 6), "voters")
        assert sorted(map(tuple, newest_verdicts(out).collect())) == sorted(map(tuple, want.collect()))
        assert out.count() > rows  # the rows of the first run are there still
        rows = out.count()


def test_live_alerts_restart(spark, tmp_path):
    schema = "id long, plate_text string, vehicle_class string, colour string, camera_id string, wall_us long"
    entries = spark.createDataFrame([(1, "GJ01AB1234", "car", "white"), (2, "GJ05CD0001", None, None)], "entry_id long, plate string, entry_class string, entry_colour string")
    path, source, every = f"{tmp_path}/alerts", f"{tmp_path}/in", None
    for part in (0, 1):
        rows = [(10 * part + i, p, "car", "white", "cam01", i) for i, p in enumerate(["GJ01AB1234", "GJ05CD0001", "XX99ZZ9999", None])]
        batch = spark.createDataFrame(rows, schema)
        batch.coalesce(1).write.mode("append").parquet(source)
        every = batch if every is None else every.union(batch)
        live.live_alerts(replay(spark, "parquet", source, batch.schema, pattern="*.parquet"), lambda: entries, path, interval=None).awaitTermination()
        got = spark.read.parquet(f"{path}/rows")
        want = matching.alerts(every, entries)
        key = ["id", "entry_id", "score", "reasons.plate.detail", "reasons.appearance.detail"]
        assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect())) and got.count() == 2 * (part + 1)


def test_hours_are_those_of_the_data(spark):
    hour = 3_600_000_000
    s = spark.createDataFrame([("a", -2 * hour + 5), ("a", 900 * hour), ("b", 900 * hour + 7)], "camera_id string, wall_us long")
    cameras = spark.createDataFrame([("a",), ("b",)], "camera_id string")
    got = traffic.buckets(s, cameras)
    assert got.count() == 2 * 903 and got.agg(F.sum("total")).first()[0] == 3
    assert got.where("total > 0 and camera_id = 'a'").select("bucket", "hour").orderBy("bucket").collect() == [(-2, 22), (900, 12)]
    assert traffic.buckets(s.limit(0), cameras).count() == 0 and traffic.buckets(s, cameras, 0, 9).count() == 20


def test_rows_pruned_by_rank(spark):
    """Times in clusters: the oldest over the cap go, ties by id."""
    rows = [(i, 0 if i % 3 else i % 7 * 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, wall_us long")
    needed = df.where("id % 10 = 0").select("id")
    got = {r.id for r in retention.prune_rows(df, needed, 10**12, 300, 1).collect()}
    old = sorted((t, i) for i, t in rows if i % 10)
    assert got == {i for _, i in old[:200]}


def test_scan_says_what_it_left_out(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, wall_us long")
    for limit, more in ((10, False), (9, True)):
        rows, truncated = movement.newest(df, limit)
        assert truncated is more and sorted(r.id for r in rows.collect()) == list(range(10 - limit, 10))


def test_intent_words_do_not_count_against_a_mention(spark):
    docs = spark.createDataFrame([("GJ-JUN-004", "GJ-JUN-004 Junagadh bypass"), ("GJ-RAJ-002", "GJ-RAJ-002 Rajkot ring road"), ("GJ-SUR-009", "GJ-SUR-009 Surat station")], "doc_id string, text string")
    asked = ["is GJ-JUN-004 down", "camera health GJ-JUN-004", "what is the status of GJ-JUN-004", "is the junagadh bypass camera down", "camera health for rajkot ring road", "coverage in surat"]
    found = retrieval.resolve(docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")).where("place = 1").collect()
    assert {r.query_id: r.doc_id for r in found} == {0: "GJ-JUN-004", 1: "GJ-JUN-004", 2: "GJ-JUN-004", 3: "GJ-JUN-004", 4: "GJ-RAJ-002", 5: "GJ-SUR-009"}


def test_scope_search_and_decline(spark):
    """A mention ahead of its runner-up is answered alone, an ambiguous one is not; no intent is searched or declined."""
    docs = [("GJ-JUN-004", "camera", "GJ-JUN-004 Junagadh bypass"), ("GJ-RAJ-002", "camera", "GJ-RAJ-002 Rajkot ring road"), ("GJ-SUR-009", "camera", "GJ-SUR-009 Surat station"),
            *[(f"GJ-AHM-{i:03}", "camera", f"GJ-AHM-{i:03} Ahmedabad junction") for i in range(5)], ("z1", "zone", "forecourt no parking"), ("z2", "zone", "Surat station steps")]
    asked = {
        "is GJ-JUN-004 down": ("camera_health", "scoped", "GJ-JUN-004"), "camera health for rajkot ring road": ("camera_health", "scoped", "GJ-RAJ-002"),
        "coverage in surat": ("coverage", "scoped", "GJ-SUR-009"), "is the Ahmedabad camera down": ("camera_health", "broad", None), "is the forecourt camera faulty": ("camera_health", "scoped", "z1"),
        "which cameras are down?": ("camera_health", "broad", None), "look up the junagad": ("search", "search", "GJ-JUN-004"), "search for xyzzy": ("search", "nothing", None),
        "junagadh": (None, "search", "GJ-JUN-004"), "banana": (None, "decline", None), "what is the weather in tomorrow": (None, "decline", None), "": ("help", "broad", None),
        "show me the alerts": ("alerts", "broad", None), "where has GJ01AB1234 been seen?": ("find_plate", "broad", None), "find cloned plates": ("cloned_plates", "broad", None),
    }
    df = spark.createDataFrame(docs, "doc_id string, kind string, text string")
    found = retrieval.decided(df, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    got = {r.query_id: (r.intent, r.action, r.doc_id) for r in found.collect()}
    assert {q: got[i] for i, q in enumerate(asked)} == asked


def test_many_tracks_are_few_states(spark, tmp_path):
    """3,000 tracks stand in at most 1,024 rows of state, and their verdicts are those of the batch."""
    at, source = f"file://{tmp_path}/votes", f"{tmp_path}/in"
    rows = spark.range(9_000).selectExpr("concat('cam0', id % 2) as camera_id", "id % 3000 as track_id", "id as seq", "concat('GJ01AB', lpad(cast(id % 3000 + id div 6000 as string), 4, '0')) as plate_text", "id % 7 / 10D as conf")
    rows.coalesce(1).write.parquet(source)
    stream = replay(spark, "parquet", source, rows.schema, pattern="*.parquet").withColumnRenamed("plate_text", "text")
    out = live.run_to_end(live.voted(stream), "votes", at=at)
    want = votes.consensus(rows, ["camera_id", "track_id"]).select("camera_id", "track_id", "plate", F.round("confidence", 6), "voters")
    assert sorted(map(tuple, newest_verdicts(out).collect())) == sorted(map(tuple, want.collect()))
    assert 0 < spark.read.format("statestore").load(f"{at}/state").count() <= 1024


class Held:
    """A part's state, without Spark."""

    def __init__(self):
        self.get, self.exists, self.now, self.due = None, False, 0, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_silent_tracks_are_forgotten_and_others_are_not():
    """A track that has been silent for too long when a batch comes is gone, also if another of its part has reads; a null id is a track's."""
    state, told = Held(), []
    for i, (now, track) in enumerate([(0, "1"), (60, "2"), (110, "2"), (120, "1"), (130, None), (140, None), (400, "")]):
        state.now = now
        b = pd.DataFrame({"camera_id": ["cam01"] * 3, "track": [track] * 3, "seq": [i * 10 + k for k in range(3)], "text": ["GJ01AB1234"] * 3, "conf": [0.5] * 3})
        out = [r for f in live.part_votes(iter([b if track != "" else b[:0]]), state, Vote(), 100) for r in f.itertuples()]
        told += [(r.newest_seq, None if pd.isna(r.track_id) else r.track_id, r.reads) for r in out]
        if now == 60:
            assert state.due == 100  # the first to go
    assert told == [(2, 1, 3), (12, 2, 3), (22, 2, 6), (32, 1, 3), (42, None, 3), (52, None, 6)]
    assert not state.exists
