"""SimHash: fingerprints by the plain rule, links of all pairs by brute force, hubs in connected components."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import components, queries, simhash
from sightline.llm.simhash import Params

from ..conftest import SF


def plain_fingerprint(text, width=3):
    upper = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(upper))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, pairs):
    """Smallest node reachable from each."""
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def near(fps, bits):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits]


def plain(rows, bits=2):
    """doc_id, hex, component of rows (doc_id, text), in any order."""
    fps = [plain_fingerprint(t) for _, t in rows]
    nodes, pairs = sorted(set(fps)), []
    by_id = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            pairs.append((f, by_id.setdefault(i, f)))
    root = groups(nodes, near(nodes, bits) + pairs)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_as_the_plain_rule(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == plain(rows)


def test_many_copies(spark, monkeypatch):
    """Fingerprints of more rows than the limit, with and without a doc_id, beside others."""
    monkeypatch.setattr(components, "LEAST_HUB", 5)
    rows = [(i, "one text of many copies") for i in range(30, 60)] + [(None, "a second one")] * 20 + [(7, None), (8, ""), (9, "alone here now")]
    assert found(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_simhash_pigeonring"](spark, SF)) == plain(rows)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("Aa Bb ccc dd\ne".split(" ")) for _ in range(500))
    want = simhash.fingerprint(text.encode())
    assert want == plain_fingerprint(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n ") == 0


@pytest.mark.parametrize("bits,crowd", [(1, 64), (2, 64), (2, 3), (3, 64), (3, 3)])
def test_links_by_brute_force(spark, bits, crowd):
    """Clusters of fingerprints a few bits apart, near random ones; both ways of linking."""
    rng = random.Random(bits)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits + 2)))
    fps |= {0, 2**64 - 1, 1, 2**63} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(simhash.signed(x) for x in fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), Params(bits=bits, crowd=crowd)).collect()
    every = near(fps, bits)
    assert {(max(e), min(e)) for e in edges} <= {(max(e), min(e)) for e in every}
    assert groups(fps, edges) == groups(fps, every)
    if crowd == 64:  # without crowds no pair is passed over
        assert {(max(e), min(e)) for e in edges} == {(max(e), min(e)) for e in every}


def test_crowded_key_makes_no_square(spark):
    """Fingerprints that share their first 43 bits: as many rows of points, not of pairs."""
    fps = [(simhash.signed((i * 2654435761 % (1 << 21)) << 43 | 5),) for i in range(3000)]
    edges = simhash.links(spark.createDataFrame(fps, "fp long"), Params(crowd=8))
    assert edges.count() <= 65 * len(fps)
    assert groups([x for (x,) in fps], edges.collect()) == groups([x for (x,) in fps], near([x for (x,) in fps], 2))


def test_no_rows_and_clashing_columns(spark, empty, docs):
    assert simhash.near_duplicates(empty).collect() == []
    more = docs.withColumns({c: F.lit(1) for c in ("fp", "head", "component", "id", "a", "b", "key", "start", "bits")})
    assert found(simhash.near_duplicates(more)) == found(simhash.near_duplicates(docs))


@pytest.mark.parametrize("seed", range(3))
def test_hubs_are_split(spark, monkeypatch, seed):
    """Components with hubs in every round, against the plain sets."""
    monkeypatch.setattr(components, "LEAST_HUB", 4)
    monkeypatch.setattr(components, "HUBS", 8)
    monkeypatch.setattr(components, "HELD", 1)
    rng = random.Random(seed)
    edges = [(rng.randrange(12) * 50, rng.randrange(600)) for _ in range(300)] + [(i, i + 1) for i in range(700, 760)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r.id: r.component for r in got.collect()} == groups(nodes, [e for e in edges if e[0] != e[1]])


def test_large_star_meets_in_no_task(spark, monkeypatch):
    """The rows that the edges of a hub are joined in, by task."""
    n = 200_000
    edges = spark.range(1, n, numPartitions=4).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("u"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    dealt = components.with_least(edges, "u", least, 1000).groupBy(F.spark_partition_id().alias("task")).count()
    assert dealt.agg(F.max("count"), F.sum("count")).first() == (n // 4, n - 1)
