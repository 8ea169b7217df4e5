"""SimHash near-duplicates: fingerprints of word shingles, linked by the pigeonring filter over consecutive segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_bytes, written
from .components import connected_components, hub_limit, with_least

BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20  # bytes of a text whose words are held at once


@dataclass(frozen=True)
class Params:
    """Fingerprints of shingles of `words` words link at `bits` or fewer differing bits. Segment pairs that more than
    `crowd` fingerprints share are linked through points halfway between them instead of one by one."""

    words: int = 3
    bits: int = 2
    crowd: int = 64
    seed: int = 42

    def __post_init__(self):
        if not 1 <= self.bits <= 4:
            raise ValueError("bits is 1 to 4: points halfway are all within half of it")

    @property
    def segments(self) -> list[tuple[int, int]]:
        """First bit and width of each of bits + 1 segments of the ring."""
        m = self.bits + 1
        cuts = [64 * i // m for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    """An unsigned 64-bit number as the long of the same bits."""
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words, repeats included, block by block; of the whole sequence if it is shorter."""
    at, words, made = 0, [], False
    while at < len(text):
        cut = BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()  # bytes: A-Z only, and cut at the six ASCII white-space characters
        at = end
        if len(words) < width:
            continue
        made = True
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        yield np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)
        words = words[len(words) - width + 1 :]
    if words and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width, seed):
        n += len(h)
        for i in range(0, len(h), 8192):
            ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each row of docs as a long, whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(t.as_py(), params.words, params.seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(points: DataFrame, p: Params) -> DataFrame:
    """Rows (start, key, fp): for each segment a fingerprint's chain may start with, its value and that of the next."""
    ring = p.segments
    chains = []
    for i, seg in enumerate(ring):
        after = ring[(i + 1) % len(ring)]
        key = _segment(F.col("fp"), *seg).bitwiseOR(F.shiftleft(_segment(F.col("fp"), *after), 32))
        chains.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return points.select("fp", F.explode(F.array(*chains)).alias("c")).select("c.start", "c.key", "fp")


def probes(keys: DataFrame, p: Params) -> DataFrame:
    """keys with `turned` false, and for each bit of the next segment that is 0 the key with it set, `turned` true: two
    fingerprints whose chains of two segments keep their budgets, 0 and then 1, meet in one of these from one side."""
    ring = p.segments
    widths = [ring[(i + 1) % len(ring)][1] for i in range(len(ring))]
    bits = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << (32 + b))) for b in range(max(widths)))))
    out = keys.withColumn("bit", bits).where(F.col("key").bitwiseAND(F.col("bit")) == 0)
    for i, w in enumerate(widths):  # segments may differ in width by one bit
        if w < max(widths):
            out = out.where((F.col("start") != i) | (F.shiftrightunsigned("bit", 32 + w) == 0))
    return out.select("start", F.col("key").bitwiseOR(F.col("bit")).alias("key"), "fp", (F.col("bit") != 0).alias("turned"))


def in_budget(p: Params, a: str = "x", b: str = "y") -> Column:
    """Whether the chain from `start` keeps its budget, l * bits / segments for its first l segments, up to the whole
    ring, where that is the full Hamming check."""
    ring, ok = p.segments, F.lit(True)
    differ = F.col(a).bitwiseXOR(F.col(b))
    for length in range(3, len(ring) + 1):
        masks = []
        for i in range(len(ring)):
            chain = [ring[(i + k) % len(ring)] for k in range(length)]
            masks.append(F.lit(signed(sum(((1 << w) - 1) << at for at, w in chain))))
        mask = F.element_at(F.array(*masks), F.col("start") + 1)
        ok = ok & (F.bit_count(differ.bitwiseAND(mask)) <= length * p.bits // len(ring))
    return ok & (F.bit_count(differ) <= p.bits)


def halfway(points: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) between fingerprints of points within `bits` of one another, without pairing them.

    Two such have a point within bits // 2 of one and within the rest of the other. Each fingerprint names all points
    near it; where some name a point as one of the nearer kind, all that name it are within `bits` of the least of
    these. A point is named by at most 65 fingerprints for 2 bits (2,081 for 4), however many there are.
    """
    near, far = p.bits // 2, p.bits - p.bits // 2
    assert sum(comb(64, k) for k in range(far + 1)) <= 2081
    masks = [F.lit(signed(sum(1 << b for b in bits))) for k in range(far + 1) for bits in combinations(range(64), k)]
    named = points.select("fp", F.explode(F.array(*masks)).alias("mask"))
    named = named.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= near).alias("nearer"))
    groups = named.groupBy("point").agg(F.collect_list("fp").alias("fps"), F.min(F.when(F.col("nearer"), F.col("fp"))).alias("b"))
    edges = groups.where("size(fps) > 1 and b is not null").select(F.explode("fps").alias("a"), "b")
    return edges.where("a <> b").distinct()


def links(points: DataFrame, p: Params = Params()) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints points(fp) that differ in at
    most `bits` bits; each edge is such a pair.

    By the pigeonring principle the differences of two such fingerprints, dealt over a ring of bits + 1 segments, have
    a segment from which every chain of l segments holds at most l * bits / (bits + 1) of them: none in the first, at
    most one in the first two, and so on. The first two are met by an equi-join (one side turns each bit of the second
    segment), the rest are checked chain by chain. Keys that over `crowd` fingerprints share would give the square
    of these in pairs; their fingerprints, and those that probe these keys, are linked through `halfway` instead.
    """
    spark = points.sparkSession
    keys = ring_keys(points, p)
    crowded = written(keys.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > p.crowd).drop("n"), "crowded")
    asked, found = probes(keys, p), keys
    edges = None
    if not crowded.isEmpty():
        crowd = written(asked.join(crowded, ["start", "key"], "left_semi").select("fp").distinct(), "crowd")
        edges = written(halfway(crowd, p), "halfway")
        found = keys.join(crowded, ["start", "key"], "left_anti")
        dropped(spark, crowd)
    # sorted and merged: Spark takes exploded rows for as few as the fingerprints, and would send them to all tasks
    pairs = asked.withColumnRenamed("fp", "x").hint("merge").join(found.withColumnRenamed("fp", "y"), ["start", "key"])
    pairs = pairs.where((F.col("turned") | (F.col("x") < F.col("y"))) & in_budget(p))
    met = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    out = written(met if edges is None else met.unionByName(edges), "simhash-links")
    dropped(spark, crowded, *([edges] if edges is not None else []))
    return out


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts are read whole, once, where they are; from then on only (doc_id, fingerprint) moves. Equal fingerprints are one
    class; distinct ones are linked by `links`, and components are taken over the links.

    Null, empty and blank texts have the fingerprint 0 and are linked like any other. Rows that repeat a doc_id are
    one document: their fingerprints are joined. Rows of null doc_id link their neighbours too; their component_id is
    the smallest doc_id of the component, null if it has none. Other columns of docs are ignored. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    rows = written(fingerprints(docs, params), "fingerprints")
    heads = written(rows.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    edges = links(heads.select("fp"), params)
    # rows that repeat a doc_id with other texts
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most")
    same = rows.join(twice.drop("most"), "doc_id").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    found = written(connected_components(edges.unionByName(same)), "simhash-components")
    least = found.join(heads, found["id"] == heads["fp"]).groupBy("component").agg(F.min("head").alias("least"))
    places = found.join(least, "component").select(F.col("id").alias("fp"), "least")
    whole = written(heads.join(places, "fp", "left").select("fp", F.coalesce("least", "head").alias("m"), "n"), "simhash-classes")
    size = heads.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    out = with_least(rows, "fp", whole, hub_limit(size.rows or 0, size.most or 0))  # copies of one text may be a third of all
    out = written(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("m").alias("component_id")), "simhash")
    dropped(spark, rows, heads, edges, found, whole)
    return out
