"""Tracks, zones, clocks, captions, lookup, journeys, sources and sinks on small cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline import plans
from sightline.functions import captions
from sightline.functions.overlay import parsed_seconds
from sightline.functions.vector import dot
from sightline.operators import camera, journeys, movement, registry, retention, retrieval, vision
from sightline.params import Journey
from sightline.sources import domain, files, sinks

from .conftest import SF

@pytest.mark.parametrize(
    "text, want",
    [
        ("14-06-2026 02:47:22", "2026-06-14 02:47:22"), ("CAM 2026-06-13 17:16:01", "2026-06-13 17:16:01"), ("14/06/2026 02:47:22 PM", "2026-06-14 14:47:22"),
        ("14/06/2026 12:00:00 AM", "2026-06-14 00:00:00"), ("14062026013203", "2026-06-14 01:32:03"), ("1410612026013203", "2026-06-14 01:32:03"),
        ("31-02-2026 10:00:00", None), ("camera 7", None), ("", None), (None, None), ("14-06-2026 02:47:61", None),
    ],
)
def test_overlay(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(F.timestamp_seconds(parsed_seconds(F.col("t"))).cast("string").alias("s"))
    assert df.first().s == want


@pytest.mark.parametrize(
    "caption, want",
    [
        ("A black SUV parked behind a bus", {"body_type": "suv", "colour": "black"}),
        ("a pick-up truck", {"body_type": "pickup"}),
        ("The windows are not tinted", {"tinted_windows": False}),
        ("not tinted at the front ................................... but tinted behind", {"tinted_windows": True}),
        ("A black and white photograph of a street", {"colour": None, "body_type": "unknown"}),
        ("a van with alloy wheels but no roof rack", {"roof_rack": False, "wheels": "alloy"}),
        ("a van that reads 'City Cabs'", {"markings": ["City Cabs"]}),
        ("a car on a road", {"attribute_confidence": 0.0, "description": "a car on a road"}),
        (None, {"attribute_confidence": 0.0, "body_type": "unknown"}),
    ],
)
def test_captions(spark, caption, want):
    row = captions.with_attributes(spark.createDataFrame([(caption,)], "caption string")).first().asDict()
    assert {k: row[k] for k in want} == want


def test_lookup(spark):
    docs = spark.createDataFrame([("cam10", "Junagadh Bypass cam10"), ("cam17", "Rajkot Ring Road cam17"), ("cam18", "Rajkot Station cam18"), *[(f"part-{i}", f"plain name {i}") for i in range(5)]], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "junagad"), (2, "the camera"), (3, "rajkot ring road"), (4, "cam18"), (5, "zebra")], "query_id int, query string")
    found = {}
    for r in retrieval.resolve(docs, asked).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.how))
    assert found[1][0] == ("cam10", "trigram") and found[3][0] == ("cam17", "bm25") and found[4][0] == ("cam18", "bm25")
    assert 2 not in found and 5 not in found


def test_intents(spark):
    asked = ["", "where is GJ 01 AB 1234", "find cloned plates", "which camera is down", "tell me a joke", "look up the bypass"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").select("i", retrieval.intent(F.col("q")).alias("x")).orderBy("i")
    assert [r.x for r in df.collect()] == ["help", "find_plate", "cloned_plates", "camera_health", None, "search"]


def sightings(cams, seconds, vectors):
    return pd.DataFrame({"id": range(len(cams)), "camera_id": cams, "t_us": [int(s * 1e6) for s in seconds], "lat": 23.0, "lon": 72.5, "v": vectors})


def test_journeys():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    found = journeys.chain(sightings(["c1", "c9", "c2", "c3"], [0, 50, 100, 200], [a, b, a, a]), Journey())
    assert [j["hop_ids"] for j in found] == [[0, 2, 3]] and found[0]["confidence"] <= 0.95
    many = journeys.chain(sightings([f"c{i % 2}" for i in range(400)], [i * 10 for i in range(400)], [a] * 400), Journey())
    assert all(j["hop_count"] <= 12 and j["elapsed_s"] <= 3600 for j in many) and any(j["truncated"] for j in many)
    assert journeys.chain(sightings([], [], []), Journey()) == []


@pytest.mark.parametrize("scores, flags", [([0.91, 0.90, 0.82], [True, True, False]), ([0.95, 0.84], [False, False]), ([0.90, 0.88], [True, True]), ([0.9], [False])])
def test_ambiguity(spark, scores, flags):
    df = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate(scores)], "query_id int, vec_id int, similarity double, place int")
    assert [r.ambiguous for r in journeys.flagged(df).orderBy("place").collect()] == flags


def test_dot_of_odd_vectors(spark):
    df = spark.sql("select array(1D, 2D) a, array(3D) b, cast(null as array<double>) c, cast(array() as array<double>) d")
    assert list(df.select(dot(F.col("a"), F.col("a")), dot(F.col("a"), F.col("b")), dot(F.col("a"), F.col("c")), dot(F.col("d"), F.col("d"))).first()) == [5.0, 0.0, 0.0, 0.0]


def test_prune_keeps_what_is_needed(spark):
    day = 86_400_000_000
    f = spark.createDataFrame([(1, 0, 100, True), (2, 1, 100, False), (3, 9 * day, 100, False), (4, 10 * day, 100, False), (5, 10 * day, 100, True)], "id long, mtime_us long, bytes long, open boolean")
    got = {r.id: r.verdict for r in retention.prune_files(f, 10 * day, 300, 7 * 86400).collect()}
    assert got == {1: "protected", 2: "expired", 3: "budget", 4: "kept", 5: "protected"}
    got = {r.id: r.verdict for r in retention.prune_files(f.limit(0), 0, 1, 1).collect()}
    assert got == {}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in registry.upsert(old, new, "k", "at").collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_sources_and_sinks(spark, tmp_path):
    live, snap = str(tmp_path / "live"), str(tmp_path / "snap")
    spark.createDataFrame([("cam01", "One")], "id string, name string").write.json(live)
    rows, answered = files.catalogue(spark, live, snap)
    assert answered and rows.count() == 1
    rows, answered = files.catalogue(spark, str(tmp_path / "none"), snap)
    assert not answered and rows.first().name == "One"
    (tmp_path / "w.csv").write_text('Plate,Category\n"gj 01 ab 1234",stolen\n,wanted\n')
    assert [r.plate for r in files.watchlist_csv(spark, str(tmp_path / "w.csv")).collect()] == ["GJ01AB1234"]
    with pytest.raises(ValueError):
        files.replay(spark, "smoke", live, rows.schema)
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.jpg").write_bytes(b"12345")
    assert files.evidence(spark, str(tmp_path / "ev")).first().bytes == 5
    data = spark.createDataFrame([("g1", 1, None), ("g2", 2, "b")], "g string, n int, s string")
    sinks.replace_groups(data, str(tmp_path / "p"), "g")
    sinks.replace_groups(spark.createDataFrame([("g1", 9, "c")], "g string, n int, s string"), str(tmp_path / "p"), "g")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 9]
    assert sinks.export_csv(data, str(tmp_path / "csv"), ["n"], 1) is True
    html = sinks.html_report(spark, {"A <b>": data}, limit=1)
    assert "A &lt;b&gt;" in html and "Only the first 1 rows" in html
    alerts = spark.createDataFrame([("P", "cam01", "low", "stolen", 0.9), ("Q", "cam01", "critical", "stolen", 0.9)], "plate string, camera_id string, severity string, category string, score double")
    assert [r.plate for r in sinks.notices(alerts).collect()] == ["Q"]


def test_steps_of_the_whole_gap(spark):
    """A step of 25 minutes counts, one of 31 doesn't; the registered query has steps of more than two minutes."""
    v = [1.0, 0.0]
    s = spark.createDataFrame([(1, "cam04", "g", 0, v), (2, "cam14", "g", 1_500_000_000, v), (3, "cam04", "g", 3_360_000_000, v)], "id long, camera_id string, time_group string, t_us long, v array<double>")
    assert [(r.id_a, r.id_b) for r in journeys.steps(s, domain.cameras(spark)).collect()] == [(1, 2)]
    assert plans.load()[0]["journey_candidates"](spark, SF).where("seconds > 120").count() > 0


def test_searches_ask_the_whole_set(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id")
    found = plans.load()[0]["appearance_topk"](spark, SF)
    assert {r.query_id for r in found.where("query_id % 100 <> 0").select("query_id").distinct().collect()} & {r.vec_id for r in e.collect()}


def test_similar_in_blocks(spark):
    """Any blocks give the same rows, and the plan neither broadcasts nor loops over all pairs."""
    rows = [(i, [float(np.cos(i / 40)), float(np.sin(i / 40))]) for i in range(60)] + [(90, None), (91, [])]
    g = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = g.where("vec_id % 20 = 0")
    whole = journeys.similar(g, asked)
    parts = journeys.similar(g, asked, rows=7, queries=2)
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 3 * 25
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan


def test_folds_stream(spark):
    """A hot key passes row by row: its rows are never gathered into one."""
    n = 200_000
    a = spark.range(n).selectExpr("if(id % 4 = 0, concat('P', id), 'HOT') as plate", "id as alert_id", "id * 10 as wall_us")
    sent = vision.cooled(a, "plate", 35)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    ids, last = [], None
    for i in (i for i in range(n) if i % 4):
        if last is None or i * 10 - last >= 35:
            ids.append(i)
            last = i * 10
    assert sorted(r.alert_id for r in sent.where("plate = 'HOT'").collect()) == ids
    assert sent.where("plate <> 'HOT'").count() == n // 4
    f = a.selectExpr("plate as camera_id", "0L as epoch", "alert_id as id", "wall_us as pts_ms")
    assert sorted(r.id for r in vision.sampled(f, ["camera_id", "epoch"], 35).where("camera_id = 'HOT'").collect()) == ids


def test_route_of_a_hot_plate(spark):
    n = 50_000
    s = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'cam04', 'cam14') as camera_id", "'GJ01AB1234' as plate_text", "id * 180000000 as scene_us", "true as corroborated", "id * 180000000 as wall_us")
    target = spark.createDataFrame([("GJ01AB1234",)], "plate string")
    plain = [s, domain.cameras(spark), domain.sessions(spark), target]
    found = movement.routes(*plain)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    r, hops = found.first(), movement.route_hops(*plain)
    assert (r.hops, r.impossible, r.duration_s) == (n, 0, (n - 1) * 180.0)
    assert hops.count() == n and abs(hops.agg(F.sum("leg_km")).first()[0] - r.total_km) < 1e-3


def test_blocks_find_all_that_are_alike_and_few_others(spark):
    """Pairs that may reach the least are those that brute force finds, but for rounding; a limit keeps ties and the best."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0])]
    left, right = (spark.createDataFrame(rows, f"{c} long, v array<double>") for c in "ab")
    like = v @ v.T
    want = {(i, k) for i in range(90) for k in range(90) if i != k and like[i, k] >= 0.8}
    assert {(r.a, r.b) for r in journeys.alike(left, right, 0.8, 30, 40).collect()} == want
    best = {(r.a, r.b) for r in journeys.alike(left, right, 0.8, 1000, 1000, 3).collect()}
    assert best == {(i, k) for i, k in want if sum(like[i, m] > like[i, k] for m in range(90) if m != i) < 3}


def test_overlaps_meet_in_cells_once(spark):
    """Boxes of all sizes, some equal, some off the picture: the pairs of brute force, each once; a plan by cells."""
    rng = np.random.default_rng(4)
    at, size = rng.integers(-90, 500, (120, 2)), rng.integers(1, 300, (120, 2))
    boxes = [("c", 1, i, *map(int, [*p, *(p + s)])) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    boxes += [("c", 1, 200 + b[2], *b[3:]) for b in boxes[:9]] + [("c", 2, 999, 0, 0, 50, 50), ("c", 1, 998, 5, 5, 5, 5)]
    df = spark.createDataFrame(boxes, "camera_id string, frame long, id long, x1 long, y1 long, x2 long, y2 long")

    def share(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0

    want = sorted((a[2], b[2]) for a in boxes for b in boxes if a[1] == b[1] and a[2] < b[2] and share(a, b) >= 0.25)
    got = vision.overlaps(df)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == want and len(want) > 50
    assert "column" in got._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_equal_and_of_alike_vectors(spark):
    """Vectors are compared once: sightings of one vector follow one another, as do those of alike ones."""
    rows = [(i, c, "s", i * 60_000_000, v) for i, (c, v) in enumerate([("cam01", [1.0, 0.0]), ("cam02", [1.0, 0.0]), ("cam01", [0.9, 0.1]), ("cam02", [0.0, 1.0])])]
    s = spark.createDataFrame(rows, "id long, camera_id string, time_group string, t_us long, v array<double>")
    got = journeys.steps(s, domain.cameras(spark))
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == [(0, 1), (1, 2)]
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()  # none is left to the pairs of sightings


def test_a_find_is_compared_with_near_tracks_of_its_class(monkeypatch):
    """200 live tracks of two classes, side by side: each find meets the box of its own track alone."""
    calls, plain = [], camera.box_iou
    monkeypatch.setattr(camera, "box_iou", lambda a, b: calls.append(1) or plain(a, b))
    tracker, out = camera.Tracker(), []
    for frame in range(3):
        for i in range(200):
            find = {"id": frame * 200 + i, "camera_id": "c", "pts_ms": frame * 1000, "vehicle_class": "car" if i % 2 else "bus", "x1": 20 * i, "y1": 0, "x2": 20 * i + 10, "y2": 10, "embedding": None}
            out += tracker.row(find)
    assert [r[3] for r in out] == [i + 1 for i in range(200)] * 3 and [r[4] for r in out] == [False] * 200 + [True] * 200 + [False] * 200
    assert len(calls) == 400


def test_steps_in_blocks_are_those_of_brute_force(spark):
    """However sightings are dealt, with one vector of most of them, vectors of two lengths, null parts and unknown places."""
    rng = np.random.default_rng(6)
    known = {r.camera_id: (r.lat, r.lon) for r in domain.cameras(spark).collect()}
    cams, base = [*sorted(known)[:5], "cam17"], rng.normal(size=(12, 4))
    vectors = [*(0.9 * base[0] + 0.3 * base).tolist(), [3.0, 1.0], None, [1.0, None, 0.0, 0.0], []]
    vectors = [v if not v or None in v else (np.array(v) / np.linalg.norm(v)).tolist() for v in vectors]
    rows = [(i, cams[rng.integers(6)], "gh"[int(rng.integers(2))], int(rng.integers(-4000, 9000)) * 1_000_000, vectors[0 if i % 2 else int(rng.integers(len(vectors)))]) for i in range(240)]
    s = spark.createDataFrame(rows, "id long, camera_id string, time_group string, t_us long, v array<double>")
    places = domain.cameras(spark).withColumn("lat", F.when(F.col("camera_id") != "cam03", F.col("lat")))

    def far(a, b):
        (la, oa), (lb, ob) = (np.radians(known[x]) for x in (a, b))
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - oa) / 2) ** 2))

    want, ready = {}, [r for r in rows if r[4] and None not in r[4] and r[1] != "cam03"]
    for a in ready:
        for b in ready:
            wait = (b[3] - a[3]) / 1e6
            if a[2] == b[2] and a[1] != b[1] and 0 < wait <= 1800 and len(a[4]) == len(b[4]) and far(a[1], b[1]) / (wait / 3600) <= 120:
                if round(like := float(np.dot(a[4], b[4])), 9) >= 0.84:
                    want[a[0], b[0]] = (round(float(far(a[1], b[1])), 6), wait, round(like, 6))
    for n in (7, 40, 131_072):
        got = journeys.steps(s, places, rows=n, digits=6).collect()
        assert {(r.id_a, r.id_b): (r.km, r.seconds, r.similarity) for r in got} == want and len(got) == len(want) > 500


def test_steps_shuffle_sightings_and_no_pairs(spark):
    """400 sightings of 400 vectors that are all alike: no exchange has rows for pairs of a sighting and a vector."""
    s = spark.range(400).selectExpr("id", "concat('cam0', id % 5 + 1) as camera_id", "'g' as time_group", "id * 1000000 as t_us", "array(1D, id / 10000D) as v")
    got = journeys.steps(s, domain.cameras(spark))
    assert len(got.collect()) > 20_000
    moved, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        rows = node.metrics().get("shuffleRecordsWritten")
        moved += [rows.get().value()] if rows.isDefined() else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert moved and max(moved) <= 4_000


def test_nearest_is_round(spark):
    x = [0.5, 1.5, 0.0000005, 0.8400000005, 0.1234565, -0.1234565, 2.675, 0.84 - 1e-16, 1 / 3, 12.0000005]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (2, 6, 9):
        assert journeys.nearest(np.array(x), digits).tolist() == [r[0] for r in df.select(F.round("x", digits)).collect()]
