"""Plate scores, the candidate join and its proof."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions.text import fold_plate, grams, masked, redact_url, substrings
from sightline.operators import matching
from sightline.params import Match

READS = "id long, plate_text string, vehicle_class string, colour string, camera_id string, wall_us long"
ENTRIES = "entry_id long, plate string, entry_class string, entry_colour string"


def scored(spark, plate, read, classes=("car", "white"), wants=("car", "white")):
    reads = spark.createDataFrame([(1, read, *classes, "cam01", 0)], READS)
    entries = spark.createDataFrame([(1, plate, *wants)], ENTRIES)
    pairs = reads.crossJoin(entries).withColumns({"read_fold": fold_plate(F.col("plate_text")), "entry_fold": fold_plate(F.col("plate"))})
    return matching.with_score(pairs).first()


@pytest.mark.parametrize(
    "plate, read, classes, wants, alert, kind",
    [
        ("GJ01AB1234", "GJ01AB1234", ("bus", "red"), ("car", "white"), True, "exact"),
        ("GJ01AB1234", "GJ01AB1Z34", ("car", "white"), ("car", "white"), True, "exact"),
        ("GJ01AB1234", "AB1234", ("car", "white"), ("car", "white"), True, "fused"),
        ("GJ01AB1234", "AB1234", ("bus", "red"), ("car", "white"), False, "partial"),
        ("GJ01AB1234", "34", ("car", "white"), ("car", "white"), False, "appearance"),
        ("GJ01AB1234", None, ("car", "white"), ("car", "white"), False, "appearance"),
        ("GJ01AB1234", "MH99XY8765", ("car", "white"), ("car", "white"), False, "appearance"),
        ("GJ01AB1234", "GJ01AB1234", ("car", "white"), (None, None), True, "exact"),
    ],
)
def test_score(spark, plate, read, classes, wants, alert, kind):
    r = scored(spark, plate, read, classes, wants)
    assert (r.is_alert, r.match_type) == (alert, kind)
    if kind == "exact":
        assert r.score >= 0.95
    if read == "AB1234":
        assert r.plate_score > 0.5


def test_unsafe_spans():
    assert matching.unsafe_spans() == [4, 5, 7, 8, 11, 14]
    assert all(matching.gram_is_safe(n, 2) for n in range(4, 40))
    assert not any(matching.gram_is_safe(n, 4) for n in range(4, 8))
    assert matching.least_alerting_share(Match(alert_threshold=2.0)) == 1.0


def test_no_alert_is_lost(spark):
    """All reads with up to two wrong characters, and parts of plates: the join keeps every pair that alerts."""
    rng = random.Random(5)
    plates = [f"GJ{rng.randrange(38):02d}{rng.choice('ACEFHJKMN')}{rng.choice('ACEFHJKMN')}{rng.randrange(10000):04d}" for _ in range(40)]
    reads = set(plates)
    for p in plates[:12]:
        for i, j in itertools.combinations(range(len(p)), 2):
            x = list(p)
            x[i], x[j] = rng.choice("XY39"), rng.choice("XY39")
            reads.add("".join(x))
        reads |= {p[a:b] for a in range(8) for b in range(a + 1, 11)}
    reads = sorted(reads) + [None, "", "A"]
    r = spark.createDataFrame([(i, t, "car", "white", "cam01", 0) for i, t in enumerate(reads)], READS)
    e = spark.createDataFrame([(i, p, "car", "white") for i, p in enumerate([*plates, "AB1", "GJ1234", ""])], ENTRIES)
    every = r.crossJoin(e).withColumns({"read_fold": fold_plate(F.col("plate_text")), "entry_fold": fold_plate(F.col("plate"))})
    want = {(x.id, x.entry_id) for x in matching.with_score(every).where("is_alert").select("id", "entry_id").collect()}
    got = [(x.id, x.entry_id) for x in matching.alerts(r, e).select("id", "entry_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_place_keys():
    """Whatever `misses` places differ, one set of places is left whole; longer plates get no more keys."""
    for span, misses in [(4, 1), (8, 2), (10, 2), (10, 0), (13, 3)]:
        keys = matching.place_keys(span, misses)
        assert all(any(not set(gone) & set(k) for k in keys) for gone in itertools.combinations(range(span), misses))
    assert all(len(matching.place_keys(n, n - math.ceil(0.711 * n))) <= matching.KEYS for n in range(4, 64))


def test_plates_that_begin_alike_do_not_meet(spark):
    """600 plates of one beginning: only pairs whose plate can alert are made, and all of them."""
    rng = random.Random(7)
    plates = sorted({f"6J01{rng.choice('ACEFH')}{rng.choice('ACEFH')}{rng.randrange(10000):04d}" for _ in range(600)})
    r = spark.createDataFrame([(p,) for p in [*plates, *(p[2:] for p in plates[:99]), "", "6J"]], "read_fold string")
    e = spark.createDataFrame([(p,) for p in [*plates[::5], "", "6J"]], "entry_fold string")
    got = sorted(map(tuple, matching.plate_pairs(r, e).collect()))
    every = r.crossJoin(e).where(matching.plate_score(F.col("read_fold"), F.col("entry_fold")) >= 0.25 - 1e-9)
    assert got == sorted(map(tuple, every.collect())) and len(got) < r.count() * 12


def test_text_functions(spark):
    row = spark.createDataFrame([("gj-01 Zo", "rtsp://u:p@h/x", "ab", "abcdef")], "a string, u string, s string, l string").select(
        fold_plate(F.col("a")).alias("f"), grams(F.col("l"), 3).alias("g"), redact_url(F.col("u")).alias("r"), masked(F.col("s")).alias("m"),
        masked(F.col("l")).alias("n"), substrings(F.col("l"), 5).alias("t"),
    ).first()
    assert row.f == "6J0120" and row.g == ["abc", "bcd", "cde", "def"] and row.r == "rtsp://h/x"
    assert row.m == "ab" and row.n == "ab…ef" and sorted(row.t) == ["abcde", "abcdef", "bcdef"]


@pytest.mark.parametrize("seed", range(3))
def test_lookups_by_rare_terms_lose_nothing(spark, seed):
    """What is looked for by rarer terms alone is what the plain ranking keeps."""
    from sightline.operators import retrieval
    from sightline.params import Search

    rng = random.Random(seed)
    words = ["ring", "bolt", "brass", "anvil", "copper", "zinc", "lens"]
    text = lambda: " ".join(rng.choices(words, [64, 32, 16, 8, 4, 2, 1], k=rng.randint(0, 5)))
    docs = spark.createDataFrame([(f"d{i}", text()) for i in range(150)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, text() + rng.choice(["", " unheard"])) for i in range(60)], "query_id int, query string")
    p = Search(evidence=rng.choice([0.5, 1.0, 2.0]), coverage=rng.choice([0.3, 0.5, 0.9]))
    plain = retrieval.rank(docs, asked, p).where(f"matched >= {p.evidence}D and matched / wanted >= {p.coverage}D")
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(retrieval.rank(docs, asked, p, enough=True)) == rows(plain) != []


def test_candidates_are_counted_without_pairs(spark):
    """Counts and smallest entries are those of the pairs, whatever the lengths and repeats, and plates that begin alike make no pairs."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("AC13") for _ in range(n))
    plates = ["", "A", "AC1", None, "AAAAAAAAAA", *(word(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 19, 30) for _ in range(6))]
    entries = [(i, p) for i, p in enumerate(plates)] + [(500, plates[40]), (501, plates[70])]
    reads = [*plates, *(word(n) for n in range(1, 24) for _ in range(3)), "MXWY", "MWXYKMWXYK"]
    for some in (entries, [x for x in entries if len(x[1] or "") > 5], []):
        e = spark.createDataFrame(some, "entry_id long, plate string")
        folds = spark.createDataFrame([(r,) for r in reads], "plate string").select(fold_plate(F.col("plate")).alias("fold")).distinct()
        pairs = matching.candidates(folds.select(F.col("fold").alias("id"), F.col("fold").alias("plate_text")), e)
        want = {r.id: (r.n, r.m) for r in pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("entry_id").alias("m")).collect()}
        assert {r.fold: (r.entries, r.first_entry) for r in matching.candidate_counts(folds, e).collect()} == want


def test_candidate_counts_make_no_pairs(spark):
    """2,000 reads and 400 entries of ten characters that all begin alike: 800,000 pairs, but at most 255 rows a plate."""
    folds = spark.range(2_000).selectExpr("'6J0' || lpad(cast(id as string), 7, '0') as fold")
    entries = spark.range(400).selectExpr("id as entry_id", "'6J0' || lpad(cast(id * 5 as string), 7, '0') as plate")
    got = matching.candidate_counts(folds, entries)
    found = [(r.entries, r.first_entry) for r in got.collect()]
    assert found == [(400, 0)] * 2_000
    nodes, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            nodes.append(rows.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert nodes and max(nodes) <= 2_000 * 255


def test_candidate_counts_are_not_broadcast(spark):
    """What grows with the plates does not pass through the driver, however small it looks to Spark."""
    rng = random.Random(8)
    plates = [f"GJ{rng.randrange(38):02d}AB{rng.randrange(10000):04d}" for _ in range(60)]
    folds = spark.createDataFrame([(p,) for p in plates], "fold string").distinct()
    found = matching.candidate_counts(folds, spark.createDataFrame(list(enumerate(plates)), "entry_id long, plate string"))
    assert found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_not_broadcast(spark):
    """Queries and documents may both be many: neither passes through the driver to meet the other."""
    from sightline.operators import retrieval

    docs = spark.range(200).selectExpr("concat('camera-', id) as doc_id", "'camera' as kind", "concat('gate ', id, ' of hall ', id % 7) as text")
    asked = spark.range(50).selectExpr("id as query_id", "case id % 3 when 0 then concat('gate ', id) when 1 then concat('hall ', id % 7) else concat('gatte', id) end as query")
    for found in (retrieval.resolve(docs, asked), retrieval.rank(docs, asked), retrieval.rank(docs, asked, enough=True)):
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
