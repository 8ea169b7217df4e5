"""Connected components of an edge table: alternating large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges that a task holds at once while it makes stars of them, whatever the data.
HELD = 1 << 20
#: Nodes of most edges that are sent to all tasks: 2 * HUBS rows of two longs at most, whatever the data.
HUBS = 1 << 16
LEAST_HUB = 1000


def stars_of(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        hi, lo = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars_of(hi, lo)], names=["hi", "lo"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def degrees_of(edges: DataFrame) -> tuple[bool, int | None]:
    """Whether edges(hi, lo), lo < hi, are stars already: each hi has one lo and is the lo of none. A round leaves such
    edges as they are, so this one count, combined before its shuffle, takes the place of a last round. Then a bound
    on the edges of a node that meet in one task, if a node has more of them: at most 2 * HUBS nodes do."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("lo", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    found = degrees.agg(
        F.count(F.when(F.expr("up > 1 or (up = 1 and down = 1)"), 1)).alias("open"),
        F.sum("n").alias("ends"),
        F.max("n").alias("most"),
    ).first()
    return found.open == 0, hub_limit(found.ends or 0, found.most or 0)


def hub_limit(rows: int, most: int) -> int | None:
    """The rows of a key above which it is a hub, if the key of most rows is one: 2 * HUBS keys can be at most."""
    limit = max(LEAST_HUB, rows // (2 * HUBS))
    return limit if most > limit else None


def with_least(edges: DataFrame, key: str, least: DataFrame, limit: int | None) -> DataFrame:
    """edges with m of least(key, m, n), n the edges of the key. Keys of more than `limit` edges, which are few, go to the
    tasks that hold their edges instead of these edges all to one task."""
    if limit is None:
        return edges.join(least.drop("n"), key)
    hubs = least.where(F.col("n") > limit).select(key, F.col("m").alias("hub"), F.lit(True).alias("known"))
    dealt = edges.join(F.broadcast(hubs), key, "left")
    rest = dealt.where("known is null").drop("hub", "known").join(least.where(F.col("n") <= limit).drop("n"), key)
    return rest.unionByName(dealt.where("known").drop("known").withColumnRenamed("hub", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every node that has an edge to another: component is its smallest reachable id.

    Edges hold non-null longs; loops and repeated edges change nothing. First each task turns the edges that it reads,
    HELD at a time, into stars of the same components, before anything is shuffled. Every round is a few joins over the edges
    that are left, its minima are combined before the shuffle, and its result is written to the shared folder.
    Rounds grow with the logarithm of the longest path; edges that are stars already need none. An empty edge table
    gives no rows.
    """
    spark = edges.sparkSession
    raw = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo"), "cc")
    now = written(raw.mapInArrow(_contracted, "hi long, lo long"), "cc")
    dropped(spark, raw)
    for _ in range(max_rounds):
        done, limit = degrees_of(now)
        if done:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = with_least(both.where("v > u"), "u", least, limit).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        if limit:
            large = written(large, "cc")
        under = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = with_least(large, "hi", under, limit).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = written(small.union(under.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        dropped(spark, now, *([large] if limit else []))
        now = stars
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
