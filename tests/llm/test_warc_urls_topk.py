"""op1, op3 and op9 on small tables, against plain Python."""

import base64
import hashlib

import numpy as np
import pytest

from sightline.llm import topk, urlrules, warc

PAGES = "page_id long, url string, html string, digest string, key string, last boolean"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", True) for r in rows], PAGES)


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 700_000
    rows = [(1, "http://a/1", "one"), (2, None, None), (3, "http://a/\r\nX: y", "one"), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "u", "one"), (3, "http://a/3", "one")]
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.chunks) for r in warc.round_trip(pages(spark, rows)).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"one": 3, "": 4, big: 6}
    want = []
    for page_id, _, html in rows:
        size, to = len((html or "").encode()), last[html or ""]
        first = page_id == to
        want.append((page_id or -1, "response" if first else "revisit", None if first else to, size, digest(html), 3 if html == big and first else 1))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_chunks_carry_digests(spark):
    table = warc.read(warc.write(warc.chunked(pages(spark, [(1, "u", "ab" * 40)]), chunk=32)), chunk=32)
    rows = table.orderBy("chunk_no").collect()
    data = b""
    for r in rows:
        data += bytes(r.data)
        assert r.payload_bytes == len(data) and r.digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert data == b"ab" * 40 and [r.last for r in rows] == [False, False, True]


def test_warc_least_size_and_empty_table(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa")]
    assert {r.record_type for r in warc.round_trip(pages(spark, rows), min_revisit_bytes=3).collect()} == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("org", "", "block")]


def fitting(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("block", [50_000, 1])
def test_url_rules(spark, block):
    urls = [None, "", "nothing", "http://", "http://COM/", "http://com", "http://xcom/", "https://www.Example.com/en/1?x=/en/", "http://m.example.com/en/", "http://example.com/EN/", "http://b.a.net/es/x",
            "http://a.net", "http://com.net/es/", "http://x.org?q", "http://É.com/a#b", "a://b://c.com/", "http://www.example.com.net/es/", "http://x.www.example.com/en/#"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[7], "h"), (7, urls[7], "h")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages(spark, rows), rules, block=block).collect()]
    want = [(i, *fitting(u)) for i, u, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert urlrules.judge(pages(spark, []), rules).count() == 0
    assert urlrules.judge(pages(spark, rows), rules.limit(0)).where("rule is not null").count() == 0


def test_a_million_rules(spark):
    """1,000,000 rules, 100,000 of them on one host, against a plain look-up of each prefix of each suffix."""
    from pyspark.sql import functions as F

    rules = spark.range(900_000).select(
        F.concat(F.lit("h"), F.col("id") % 300_000, F.lit(".com")).alias("host"), F.concat(F.lit("/"), F.expr("id div 300000"), F.lit("/")).alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict")
    )
    hot = spark.range(100_000).select(F.lit("hot.org").alias("host"), F.concat(F.lit("/a"), F.regexp_replace(F.col("id").cast("string"), "(.)", "$1/")).alias("path"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("verdict"))
    rules = rules.union(hot).union(spark.createDataFrame([("com", "/", "block"), ("org", "", "block")], rules.schema))
    urls = spark.range(4000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://www.h"), F.col("id") * 97 % 310_000, F.lit(".com/"), F.col("id") % 4, F.lit("/x")))
        .otherwise(F.concat(F.lit("https://x.hot.org/a"), F.regexp_replace((F.col("id") * 31).cast("string"), "(.)", "$1/"), F.lit("7/7/7" + "z" * 3000))).alias("url"),
    )
    verdicts = {(r.host, r.path): r.verdict for r in rules.collect()}
    got = urlrules.judge(urls, rules, block=1000).collect()
    assert len(got) == 4000
    for r in got:
        labels = r.host.split(".")
        best = max(((len(h) + n, len(h), h, r.path[:n]) for i in range(len(labels)) for h in [".".join(labels[i:])] for n in range(min(len(r.path), 40) + 1) if (h, r.path[:n]) in verdicts), default=None)
        assert (r.rule, r.verdict) == ((best[2] + best[3], verdicts[best[2:]]) if best else (None, "allow"))
    assert len({r.rule for r in got}) > 1000


def brute(vectors, k, every):
    x = {i: np.floor(256 * np.array(v, np.float64)) for i, v in vectors}
    out = []
    for i in sorted({i for i in x if i % every == 0}):
        scores = sorted((-int(x[i] @ x[j]), j) for j in x if j != i and len(x[j]) == len(x[i]))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed, scale, rows, queries", [(0, 1, 8192, 1024), (1, 1, 16, 3), (2, 1e5, 16, 3)])
def test_top_k(spark, seed, scale, rows, queries):
    rng = np.random.default_rng(seed)
    vectors = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(90)]
    vectors += [(200 + i, vectors[5][1]) for i in range(12)] + [(300, [0.0] * 8), (301, [1.0, 2.0]), (310, [0.5, 0.5])]
    bad = [(1000, None), (1010, [1.0, None] * 4), (1020, [float("nan")] * 8), (1030, [float("inf")] * 8), (None, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + bad], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 5, 10, rows, queries).collect())
    assert got == brute(vectors, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_threshold_stops_early():
    x = np.array([[float(1000 - i), float(1000 - i)] for i in range(1000)], np.float32)
    lists = topk.Lists(np.arange(1000), x)
    assert lists.search(-1, np.array([1.0, 1.0], np.float32), 2) == [(2000, 0), (1998, 1)] and lists.looked < 100
    assert lists.search(-1, np.array([1.0, 1.0], np.float32), 2, 3000) == [] and lists.search(-1, np.array([1.0, 1.0], np.float32), 3, 1998) == [(2000, 0), (1998, 1)]
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(2000, 16)) * rng.pareto(1.0, 2000)[:, None]  # few long vectors: norms end the search
    lists = topk.Lists(np.arange(2000), np.floor(mixed * 8))
    q = np.floor(rng.normal(size=16) * 8)
    assert [i for _, i in lists.search(-1, q, 3)] == np.lexsort((np.arange(2000), -(lists.x @ q)))[:3].tolist() and lists.looked < 2000


def test_large_components(spark):
    """Exact as long as every score fits a long; beyond, and up to the largest doubles, rows take no part."""
    rows = [(0, [5e6, -3.25]), (50, [-5e6, 5e6]), (1, [8e6, 2.5]), (2, [1e20, 0.0]), (3, [1e307, 1.0]), (100, [-1.7e308, 1.0]), (4, [1.0, 1.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if i in (0, 50, 1, 4)}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
