"""Routes, impossible travel, norms and votes on small cases."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import movement, traffic, votes
from sightline.sources import domain

S = "id long, camera_id string, plate_text string, plate_conf double, scene_us long, corroborated boolean, wall_us long"


def rows(spark, *items):
    """(camera, plate, second, corroborated) each."""
    return spark.createDataFrame([(i, c, p, 0.9, int(t * 1e6), ok, int(t * 1e6)) for i, (c, p, t, ok) in enumerate(items)], S)


def clones(spark, *items):
    return movement.clones(rows(spark, *items), domain.cameras(spark), domain.sessions(spark)).orderBy(F.desc("confidence")).collect()


P = "GJ01AB1234"


@pytest.mark.parametrize(
    "items, n",
    [
        ([("cam04", P, 0, True), ("cam14", P, 2, True)], 1),
        ([("cam04", P, 0, True), ("cam14", P, 180, True)], 0),
        ([("cam04", P, 0, True), ("cam04", P, 2, True)], 0),
        ([("cam04", P, 0, True), ("cam10", P, 2, True)], 0),
        ([("cam20", P, 0, True), ("cam21", P, 2, True)], 0),
        ([("cam04", "AB12", 0, True), ("cam14", "AB12", 2, True)], 0),
        ([("cam04", P, 0, True), ("cam14", "MH99XY8765", 2, True)], 0),
        ([("cam04", P, 0, True), ("cam14", P, 2, False)], 0),
        ([("cam04", P, 0, True), ("cam10", P, 1, True), ("cam14", P, 2, True)], 1),
        ([("cam04", P, 0, True), ("cam14", P, 2, True), ("cam01", P, 4, True)], 2),
        ([], 0),
    ],
)
def test_clones(spark, items, n):
    found = clones(spark, *items)
    assert len(found) == n
    assert all(f.confidence <= 0.99 and f.reason for f in found)


def test_same_second_ranks_below_measured(spark):
    found = clones(spark, ("cam04", P, 0, True), ("cam14", P, 0, True), ("cam03", P, 1, True))
    assert found[0].kmh is not None and found[1].kmh is None and found[0].confidence > found[1].confidence


def route(spark, *items):
    target = spark.createDataFrame([(P,)], "plate string")
    return movement.routes(rows(spark, *items), domain.cameras(spark), domain.sessions(spark), target).first()


def test_route_refuses_other_sessions(spark):
    r = route(spark, ("cam04", P, 0, True), ("cam14", P, 180, True), ("cam10", P, 400, True))
    assert (r.hops, r.other_session, r.impossible, r.unclocked) == (2, 1, 0, 0) and 1.5 < r.total_km < 2.5 and r.duration_s == 180


def test_route_refused_hop_is_not_the_one_before(spark):
    r = route(spark, ("cam04", P, 0, True), ("cam14", P, 2, True), ("cam14", "AB1234", 180, True))
    assert (r.hops, r.impossible) == (2, 1)
    assert route(spark, ("cam04", P, 0, True), ("cam14", P, 180, False)).unclocked == 1


def norms(spark, totals, cumulative=None):
    data = [("c", 5, t, (cumulative or [t + 1 for t in totals])[i]) for i, t in enumerate(totals)]
    return traffic.learn(spark.createDataFrame(data, "camera_id string, hour int, total long, cumulative_total long"))


@pytest.mark.parametrize(
    "history, now, status",
    [
        ([41, 42, 43, 42, 41, 43], 42, "normal"), ([41, 42, 43, 42, 41, 43], 200, "high"), ([41, 42, 43, 42, 41, 43], 0, "quiet"),
        ([41, 42, 43, 42, 41, 43], 30, "low"), ([1, 2, 3], 500, "insufficient_data"), ([0, 2, 1, 0, 3, 1, 0, 2], 0, "normal"),
        ([20] * 8, 21, "normal"), ([20] * 8, 25, "high"), ([20] * 8, 22, "elevated"),
    ],
)
def test_norms(spark, history, now, status):
    reading = spark.createDataFrame([("c", 5, now, 0)], "camera_id string, hour int, total long, bucket_us long")
    assert traffic.assess(reading, norms(spark, history)).first().status == status


def test_stale_and_old_format(spark):
    reading = spark.createDataFrame([("c", 5, 20, 0)], "camera_id string, hour int, total long, bucket_us long")
    n = norms(spark, [20] * 8)
    assert traffic.assess(reading, n, now_us=960_000_000).first().status == "stale"
    assert traffic.assess(reading, n, now_us=899_000_000).first().status == "normal"
    assert norms(spark, [5, 5, 5, 5, 5, 9], [1, 1, 1, 1, 1, 0]).first().samples == 5
    assert norms(spark, [5, 5, 5, 5, 5, 0], [1, 1, 1, 1, 1, 0]).first().samples == 6


def test_deltas(spark):
    d = spark.createDataFrame([("c", i, v) for i, v in enumerate([10, 16, 16, 4, 9])], "camera_id string, bucket long, counter long")
    assert [r.delta for r in traffic.deltas(d).orderBy("bucket").collect()] == [10, 6, 0, 4, 5]
    m = spark.sql("select map('car', 5, 'bus', 2) a, map('car', 3, 'van', 1, 'bus', 2) b").select(traffic.class_deltas(F.col("a"), F.col("b")).alias("d")).first()
    assert m.d == {"car": 2}


def vote(spark, reads):
    data = [("k", i, t, c) for i, (t, c) in enumerate(reads)]
    return votes.consensus(spark.createDataFrame(data, "track string, seq long, plate_text string, conf double"), ["track"]).first()


def test_votes(spark):
    assert vote(spark, [("GJ01AB1234", 0.5), ("GJ01AB1234", 0.5), ("GJ01AB1299", 0.95)]).plate == "GJ01AB1234"
    r = vote(spark, [("GJ01AB1234", 0.5), ("GJ01AB1234", 0.6), ("GJ01AB123", 0.9)])
    assert (r.plate, r.voters) == ("GJ01AB1234", 2)
    r = vote(spark, [("GJ01AB1234", 0.5), ("GJ01AB123", 0.9)])
    assert (r.plate, r.voters) == ("GJ01AB123", 1)
    r = vote(spark, [("GJO1AB1234", 0.5), ("GJ01AB1234", 0.9), ("GJ01AB1234", 0.9)])
    assert r.plate == "GJ01AB1234" and r.confidence > 0.99
    assert vote(spark, [("GJ01AB1234", 0.5)] * 25).voters == 20
    assert vote(spark, [("AB", 0.9), (None, 0.9)]) is None
