"""The report, the export, access by key, checks of payloads and colours on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from sightline.functions import colour
from sightline.operators import registry, report
from sightline.params import Report
from sightline.sources import sinks

SEEN = "id long, camera_id string, wall_us long, scene_us long, corroborated boolean, pts_ms long, vehicle_class string, colour string, plate_text string, plate_conf double, confidence double, evidence string"
HOUR = report.HOUR_US


def seen(spark):
    rows = [
        (1, "c1", 0, 0, True, 1500, "car", "red", "AB1", 0.987654, 0.5, "e/1.jpg"),
        (2, "c2", HOUR + 5, None, False, 2500, "bus", None, "ab2", 0.0, 0.25, None),
        (3, None, 2 * HOUR, None, False, 0, "car", "blue", None, None, 0.75, None),
    ]
    return spark.createDataFrame(rows, SEEN)


def roster(spark):
    return spark.createDataFrame(
        [("c1", "One", "X", 1.0, 2.0, "degraded", 12.0, 4.0), ("c2", "Two <b>", None, None, None, "anpr", 100.0, 1.0)],
        "camera_id string, name string, city string, lat double, lon double, capability string, mean_luma double, banding double",
    )


def test_export(spark, tmp_path):
    lines = report.export_page(seen(spark), roster(spark), 0, 2, 72)
    got = sorted(lines.collect(), key=lambda r: r.line)
    assert [r.detection_id for r in got][:2] == ["1", "2"] and got[2].detection_id.startswith("# only the first 2 rows")
    assert [r.timestamp_utc for r in got] == ["1970-01-01T00:00:00+00:00", "1970-01-01T01:00:00.000005+00:00", None]
    assert [r.plate_confidence for r in got] == [0.988, None, None]
    sinks.export_lines(lines, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert text[0].split(",")[:3] == ["detection_id", "camera_id", "camera_name"] and len(text[0].split(",")) == 14 and len(text) == 4
    assert text[1] == "1,c1,One,X,1.0,2.0,1970-01-01T00:00:00+00:00,1500.0,car,red,AB1,0.988,0.5,e/1.jpg"
    assert text[2].startswith("2,c2,Two <b>,,,,1970")
    whole = report.export_page(seen(spark), roster(spark), 0, 3, 72).collect()
    assert sorted(r.detection_id for r in whole) == ["1", "2", "3"]  # a camera out of the roster, no trailer
    assert report.export_page(seen(spark).limit(0), roster(spark), 0, 3, 72).count() == 0


def test_sections(spark):
    alerts = spark.createDataFrame([(7, "c1", 2 * HOUR, "high")], "alert_id long, camera_id string, wall_us long, severity string")
    events = spark.createDataFrame([(8, "c2", 2 * HOUR), (9, "c2", 0)], "event_id long, camera_id string, wall_us long")
    parts = report.sections(seen(spark), alerts, events, roster(spark), F.lit("black"), 3 * HOUR, 0, plate="ab", only=["c2"], params=Report(hours=2, plates=1))
    assert list(parts) == ["Summary", "Plates", "Alerts", "Zone events", "Activity", "Degraded cameras"]
    one = parts["Summary"].first()
    assert (one.total, one.plates, one.recent, one.classes, one.few_plates) == (2, 1, 0, "1 bus, 1 car", False)
    plates = parts["Plates"].collect()
    assert [(r.detection_id, r.clock, r.confidence, r.vehicle) for r in plates] == [(2, "stream 2 s", None, "bus")]
    assert [r.event_id for r in parts["Zone events"].collect()] == [8]
    assert [(r.camera_id, r.condition) for r in parts["Degraded cameras"].collect()] == [("c1", "black, luma 12, banding 4")]
    html = sinks.html_report(spark, parts, limits={"Activity": 1})
    assert "Two &lt;b&gt;" in html and html.count("<section>") == 6 and "Only the first 1 rows" in html
    empty = report.summary(seen(spark).limit(0), 0).first()
    assert (empty.total, empty.plates, empty.recent, empty.few_plates) == (0, 0, 0, False)


def test_access(spark):
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "k"), (4, "x")], "n int, key string")
    keys = spark.createDataFrame([("k", "Ann", "operator")], "key string, name string, role string")
    roles = lambda mode: [r.role for r in registry.principals(asked, keys, mode).orderBy("n").collect()]
    assert roles("open") == ["admin"] * 4 and roles("unreadable") == [None] * 4
    assert roles("enforced") == ["viewer", "viewer", "operator", None]
    with pytest.raises(ValueError):
        registry.principals(asked, keys, "half")


def test_payloads(spark):
    ok = {"camera_id": "c-1", "name": "n", "lat": None, "lon": None, "rtsp_url": "rtsp://h", "hls_url": None, "capability": None, "width": None, "height": None}
    cases = [
        ({}, None), ({"camera_id": "c"}, "id"), ({"name": " "}, "name"), ({"lat": 90.5}, "lat"), ({"lon": -181.0}, "lon"), ({"rtsp_url": " "}, "url"),
        ({"rtsp_url": None, "hls_url": "https://h"}, None), ({"hls_url": "ftp://h"}, "scheme"), ({"capability": "x"}, "capability"), ({"width": "1.5"}, "width"), ({"width": " 640 "}, None), ({"height": ""}, "height"),
    ]
    schema = "camera_id string, name string, lat double, lon double, rtsp_url string, hls_url string, capability string, width string, height string, n int"
    rows = spark.createDataFrame([(*(ok | change).values(), i) for i, (change, _) in enumerate(cases)], schema)
    assert [r.e for r in rows.select("n", registry.payload_error().alias("e")).orderBy("n").collect()] == [e for _, e in cases]


def test_colours(spark):
    rows = [(200.0, 200.0, 200.0, 9), (30.0, 30.0, 160.0, 8), (175.0, 175.0, 175.0, 8), (30.0, 30.0, 160.0, 7), (10.0, None, None, 9)]
    df = spark.createDataFrame(rows, "b double, g double, r double, s int")
    c = [F.col(x) for x in "bgr"]
    got = df.select(colour.nearest_colour(*c, F.col("s"), F.col("s")).alias("c"), colour.luma(*c).alias("y")).collect()
    assert [r.c for r in got] == ["white", "red", "white", None, None]  # the first reference wins ties
    assert math.isclose(got[1].y, 0.114 * 30 + 0.587 * 30 + 0.299 * 160) and got[4].y == 10.0
