"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, worker_cache, written
from .components import connected_components

KEEP_WORDS = 1 << 17  # about 25 MB a worker


#: Fixed odd multipliers for the places of a shingle's words.
ODD = np.random.default_rng(1).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Params:
    """`permutations` hash functions give twice as many signature values; `bands` of `rows` values are looked up.

    A pair of similarity s shares no bucket with probability (1 - s**rows)**bands: 8e-7 at 0.85 with the defaults.
    A sketch holds four bits of each of the 2 * permutations values; `alike` is the least number on which two texts
    agree before their full sets are compared: about 1 in a million pairs of similarity 0.85 agree on fewer.
    A bucket in which more than `crowd` texts are unlike its main group is searched through the rarest shingles of its
    texts instead of pair by pair. Clusters are compared in blocks of about `chunk` texts or `block_shingles` shingles.
    """

    words: int = 5
    percent: int = 85
    permutations: int = 64
    bands: int = 24
    rows: int = 5
    alike: int = 89
    crowd: int = 64
    listed: int = 262_144
    chunk: int = 512
    block_shingles: int = 1_000_000
    seed: int = 7

    def __post_init__(self):
        if not (self.permutations == 64 and self.bands * self.rows <= 2 * self.permutations):
            raise ValueError("a sketch is of 128 values, and bands * rows values at most are there")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of the whole sequence if it is shorter."""
    words = text.lower().split()  # bytes: A-Z only, and cut at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    known = worker_cache("words of shingles")
    if len(known) > KEEP_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out += h[i : len(h) - width + 1 + i] * ODD[i]
    return np.unique(_mixed(out))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum, then maximum, of a*x+b under each permutation."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(s), 2048):
        h = s[i : i + 2048, None] * a + b
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.concatenate([low, high])


def _signed(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 2**63, p.permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, p.permutations, np.uint64) * np.uint64(2)
    factors = rng.integers(0, 2**63, p.rows, np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(0, 64, 4, dtype=np.uint64)
    for batch in batches:
        n, marks, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, p.words)
            n.append(len(s))
            marks.append(xxhash.xxh128_digest(s.tobytes()))
            sigs.append(signature(s, a, b))
        sig = np.array(sigs, np.uint64).reshape(-1, 2 * p.permutations)
        banded = sig[:, : p.bands * p.rows].reshape(-1, p.bands, p.rows)
        keys = _mixed((banded * factors).sum(2, dtype=np.uint64)).view(np.int64)
        nibbles = (_mixed(sig) >> np.uint64(60)).reshape(-1, 8, 16)
        sketch = np.bitwise_or.reduce(nibbles << place, axis=2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()),
                pa.array(list(keys), pa.list_(pa.int64())),
                pa.array(list(sketch), pa.list_(pa.int64())),
            ],
            names=["doc_id", "n", "mark", "keys", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t, p.words) for t in batch.column(3).to_pylist()]
        same = [xxhash.xxh128_digest(s.tobytes()) == m for s, m in zip(sets, batch.column(2).to_pylist(), strict=True)]
        out = [batch.column(0), batch.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names=["id", "c", "shingles"]).filter(pa.array(same, pa.bool_()))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest position that it reaches over links 100 * intersection >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, often = np.unique(every, return_inverse=True, return_counts=True)
    inter = np.zeros((len(sets), len(sets)), np.float32)
    np.fill_diagonal(inter, n)
    more = often > 1  # a shingle of one set alone is in no intersection
    order = np.cumsum(more) - 1
    keep = more[column]
    column, owner = order[column[keep]], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    shared = np.zeros_like(inter)
    for start in range(0, int(more.sum()), 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        shared += x @ x.T
    np.fill_diagonal(shared, n)
    union = n[:, None] + n[None, :] - shared
    link = 100 * shared.astype(np.float64) >= percent * union
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None, :], len(sets)).min(1)
        if (new == label).all():
            return label
        label = new


def _confirmed(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    frame = frame.drop_duplicates("id").sort_values("id", ignore_index=True)
    ids = frame["id"].to_numpy()
    label = linked([np.asarray(s, np.int64) for s in frame["shingles"]], percent)
    other = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[other], "b": ids[label[other]]})


SIEVE = 1 << 25  # bits, whatever the data


def _place(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(SIEVE)).astype(np.int64)


def bitmap(ids: DataFrame):
    """A broadcast bitmap of SIEVE bits for the one column of ids, longs without nulls."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    marked = ids.mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    got, field = marked.toPandas(), np.zeros(SIEVE >> 6, np.int64)  # SIEVE / 64 numbers at most
    field[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(field)


def maybe_in(ids: DataFrame, of: Column) -> Column:
    """Whether `of`, a long without nulls, may be in the one column of ids: true for all that are, and for few others
    while there are well below SIEVE of them. Only `of` goes through Python, so that texts beside it stay in the JVM."""
    held = bitmap(ids)

    @F.pandas_udf("boolean")
    def found(x: pd.Series) -> pd.Series:
        worker_cache("sieve")  # lets go what earlier steps keep
        at = _place(x.to_numpy())
        return pd.Series((held.value[at >> 6] >> (at & 63)) & 1 == 1)

    return found(of)


def sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text) whose doc_id may be among wanted(head): all that are, and few others while there are
    well below SIEVE of them. A bitmap of fixed size goes to the tasks, so that the rest needn't be shuffled."""
    return docs.where(maybe_in(wanted.select("head"), F.col("doc_id")))


def sets_of(docs: DataFrame, heads: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """Rows (id, c, shingles) for the classes wanted (id, c): their full sets, once each."""
    wanted = written(wanted.join(heads.select("id", "head", "mark"), "id"), "wanted")
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    # written, so that no task runs two Python workers, one to sift and one to make sets
    sifted = written(sieved(texts, wanted), "sifted")
    rows = sifted.join(wanted, F.col("doc_id") == F.col("head")).select("id", "c", "mark", "text")
    return rows.mapInArrow(lambda batches: _sets(batches, p), "id long, c long, shingles array<long>").dropDuplicates(["id"])


def alike(p: Params, a: str, b: str) -> Column:
    """Whether the sizes and sketches of two rows a, b (structs or aliases with n, sketch) allow for a link."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.lit(0)
    for i in range(8):
        x = F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (100 * F.least(n1, n2) >= p.percent * F.greatest(n1, n2)) & (differ <= 2 * p.permutations - p.alike)


def rare_shingles(sets: DataFrame, p: Params) -> DataFrame:
    """Rows (shingle, id, c): of each set of sets(id, c, shingles) the rarest shingles, so many that two linked sets
    have one of theirs in common.

    Linked sets share at least percent of each; so of either's shingles, in one order that holds for all, the first
    n - ceil(percent * n / 100) + 1 hold a common one. The order is by frequency in these sets, for the `listed` most
    frequent shingles at most, and by hash for the others before them.
    """
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n, pa.int64())], names=["shingle", "n"])

    counted = sets.select("shingles").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1"), "shingle-counts")
    least, held = 64, 0  # the shingles of 2**least and more uses are as many as may be listed
    for row in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect():  # 64 rows
        if held + row["count"] > p.listed:
            break
        least, held = row.k, held + row["count"]
    listed = counted.where(F.floor(F.log2("n")) >= least).orderBy("shingle").toPandas()  # `listed` rows at most
    names, uses = listed["shingle"].to_numpy(np.int64), listed["n"].to_numpy(np.int64)
    known = spark.sparkContext.broadcast((names, uses))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, uses = known.value
        for batch in batches:
            shingle, owner, c = [], [], []
            for i, label, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = s.values.to_numpy()
                often = np.zeros(len(x), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
                    often = np.where(names[at] == x, uses[at], 0)
                many = len(x) - -(-p.percent * len(x) // 100) + 1
                shingle.append(x[np.lexsort((x, often))[:many]])
                owner.append(np.full(len(shingle[-1]), i))
                c.append(np.full(len(shingle[-1]), label))
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y), pa.int64()) for y in (shingle, owner, c)], names=["shingle", "id", "c"])

    out = written(sets.select("id", "c", "shingles").mapInArrow(rarest, "shingle long, id long, c long"), "rare")
    dropped(spark, counted)
    return out


def across(members: DataFrame, keys: list[str], heads: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) between the labels c of members(*keys, id, c) that share their keys, have other labels and are alike.
    In each group those of the commonest label meet only the rest."""
    parts = members.groupBy(*keys, "c").agg(F.count("*").alias("k"))
    most = parts.groupBy(*keys).agg(F.count("*").alias("labels"), F.max_by("c", F.struct("k", "c")).alias("most"))
    most = written(most.where("labels > 1").drop("labels"), "most")
    mixed = members.join(most, keys).join(heads.select("id", "n", "sketch"), "id")
    mixed = written(mixed.select(*keys, "most", F.struct("id", "c", "n", "sketch").alias("x")), "mixed")
    x, y = mixed.where("x.c <> most").drop("most"), mixed.select(*keys, F.col("x").alias("y"))
    pairs = x.join(y, keys).where((F.col("x.c") != F.col("y.c")) & alike(p, "x", "y"))
    edges = written(pairs.select(F.greatest("x.c", "y.c").alias("a"), F.least("x.c", "y.c").alias("b")).distinct(), "across")
    dropped(members.sparkSession, most, mixed)
    return edges


def in_blocks(sets: DataFrame, p: Params) -> DataFrame:
    """sets(id, c, shingles) with the number of blocks of its cluster and the block of each row."""
    size = sets.groupBy("c").agg(
        F.least(
            F.count("*"), F.greatest(F.ceil(F.count("*") / F.lit(p.chunk)), F.ceil(F.sum(F.size("shingles")) / F.lit(p.block_shingles)))
        ).cast("long").alias("blocks")
    )
    return sets.join(size, "c").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))


def first_round(dealt: DataFrame) -> DataFrame:
    """Rows (c, i, j, id, shingles): block 0 of each cluster stands for it and meets every block, itself among them."""
    each = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = dealt.withColumn("j", F.explode(each)).where("blocks = 1 or j > 0")
    return met.select("c", F.lit(0).cast("long").alias("i"), "j", "id", "shingles")


def second_round(dealt: DataFrame, joined: DataFrame, p: Params) -> DataFrame:
    """Rows (c, i, j, id, shingles) for clusters of several blocks: texts that the first round left outside the largest
    component of their cluster, in blocks i, meet all texts of the cluster, in their blocks j."""
    large = dealt.where("blocks > 1").join(joined.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labels = large.groupBy("c", "label").agg(F.count("*").alias("k"))
    most = labels.groupBy("c").agg(F.max_by("label", F.struct("k", "label")).alias("most"), (F.sum("k") - F.max("k")).alias("left"))
    most = most.where("left > 0").withColumn("parts", F.ceil(F.col("left") / F.lit(p.chunk)).cast("long"))
    large = large.join(most, "c")
    x = large.where("label <> most").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), "parts"))
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    y = large.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("j", F.col("block"))
    columns = ["c", "i", "j", "id", "shingles"]
    return x.select(*columns).union(y.select(*columns))


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Steps: (1) one pass over the texts gives the size of each shingle set, a 128-bit mark of it, band keys over
    minima and maxima, and a sketch; (2) texts of equal marks form a class, named by 64 bits of the mark; (3) class
    names that share a bucket and are alike by sketch are joined to the bucket's first name, then across what is left
    of the bucket: pair by pair in small rests, through rare shingles in crowded ones, where texts that share only
    common passages don't meet; this gives candidate clusters; (4) full sets are built for cluster members only;
    each cluster is compared exactly, first all members with one block of them, then those not yet joined with all.
    Nothing is collected, no bucket is capped, and a cluster of any size is dealt out in blocks.

    The work grows with the texts, and with the square of a group only for texts that are nearly, but not, linked to
    one another (similarities of about 0.7 up to the limit).

    Null, empty or blank text: n_shingles 0, linked with nothing, kept. Equal texts are linked. Rows that repeat a
    doc_id count as one document. A null doc_id has a null component_id unless another row of the same text has an
    id; such a row is kept only in the first case. Other columns of docs are ignored. An empty table gives no rows.
    Shingles are known by 64-bit hashes: two that share one count as the same, which can shift a similarity by one
    shingle. Two classes that share the 64 bits of their names (at 10**9 classes, one pair with probability 3 %) lose
    the links of one of them.
    """
    p, spark = params, docs.sparkSession
    small_batches(spark)
    signed = written(
        docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(
            lambda batches: _signed(batches, p),
            "doc_id long, n long, mark binary, keys array<long>, sketch array<long>",
        ),
        "signed",
    )
    classes = (
        signed.where("n > 0 and doc_id is not null")
        .groupBy("mark")
        .agg(F.min("doc_id").alias("head"), F.min(F.struct("n", "keys", "sketch")).alias("x"))
    )
    heads = written(classes.select(F.xxhash64("mark").alias("id"), "head", "mark", "x.*"), "heads")
    rows = heads.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("many"), F.min("id").alias("hub"))
    buckets = written(buckets.where("many > 1").drop("many"), "buckets")
    members = written(rows.join(buckets, ["band", "key"]), "members")
    sketches = heads.select(F.struct("id", "n", "sketch").alias("x"))
    by_hub = members.where("id <> hub").select("id", "hub").distinct()
    by_hub = by_hub.join(sketches, F.col("id") == F.col("x.id")).join(sketches.select(F.col("x").alias("y")), F.col("hub") == F.col("y.id"))
    stars = written(connected_components(by_hub.where(alike(p, "x", "y")).select(F.col("id").alias("a"), F.col("hub").alias("b"))), "stars")
    placed = members.drop("hub").join(stars, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    placed = written(placed, "placed")
    # buckets that still hold several stars: few texts outside the largest, or a crowd of them
    parts = placed.groupBy("band", "key", "c").agg(F.count("*").alias("k"))
    rest = parts.groupBy("band", "key").agg(F.count("*").alias("stars"), (F.sum("k") - F.max("k")).alias("rest")).where("stars > 1")
    rest = written(rest.select("band", "key", (F.col("rest") > p.crowd).alias("crowded")), "rest")
    placed_rest = placed.join(rest, ["band", "key"])
    edges = across(placed_rest.where("not crowded").drop("crowded"), ["band", "key"], heads, p)
    crowd = written(placed_rest.where("crowded").select("id", "c").distinct(), "crowd")
    made = [signed, heads, buckets, members, stars, placed, rest, edges, crowd]
    if not crowd.isEmpty():
        crowd_sets = written(sets_of(docs, heads, crowd, p), "crowd-sets")
        rare = rare_shingles(crowd_sets, p)
        met = across(rare, ["shingle"], heads, p)
        made += [crowd_sets, rare, met]
        edges = edges.union(met)
    clusters = written(connected_components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(edges)), "clusters")
    sets = written(sets_of(docs, heads, clusters.withColumnRenamed("component", "c"), p), "sets")

    def confirmed(dealt: DataFrame) -> DataFrame:
        return written(dealt.groupBy("c", "i", "j").applyInPandas(lambda f: _confirmed(f, p.percent), "a long, b long"), "links")

    dealt = written(in_blocks(sets, p), "dealt")
    links = confirmed(first_round(dealt))
    made += [clusters, sets, dealt, links]
    large = dealt.where("blocks > 1")
    if not large.isEmpty():
        joined = written(connected_components(links.join(large.select(F.col("id").alias("a")), "a", "left_semi")), "joined")
        more = confirmed(second_round(dealt, joined, p))
        made += [joined, more]
        links = links.union(more)
    # a doc_id that heads several classes (repeated rows) is one document
    one = heads.groupBy("head").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).where("size(ids) > 1")
    found = connected_components(links.union(one.select("a", F.explode("ids").alias("b"))))

    # class, then component by its smallest doc_id, of every row; the small tables meet on the mark
    placed_heads = found.join(heads.select("id", "head"), "id")
    least = placed_heads.groupBy("component").agg(F.min("head").alias("least"))
    whole = (
        heads.select("mark", "id", "head")
        .join(found.join(least, "component").select("id", "least"), "id", "left")
        .select("mark", F.coalesce("least", "head").alias("component_id"))
    )
    out = signed.select("doc_id", "n", "mark").join(whole, "mark", "left")
    alone = (F.col("n") == 0) | F.col("component_id").isNull()
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    out = written(out, "near").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped(spark, *made)
    return out
