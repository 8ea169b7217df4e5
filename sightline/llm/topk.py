"""Exact top-k inner products by the threshold algorithm over sorted lists, one list a dimension."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


class Lists:
    """Vectors of one block with their sorted per-dimension lists; ids ascending, so ties keep the smaller id.

    `order` has two lists a dimension, best end first for a positive and for a negative weight, and one by norm; a query
    reads the slices that it has come to and copies nothing else. `looked` counts the rows that searches have scored."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], vectors[by]
        columns = np.ascontiguousarray(self.x.T)
        self.norms = np.sqrt((self.x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)  # never too small
        by_norm = np.argsort(-self.norms, kind="stable")[None]
        self.order = np.concatenate([np.argsort(-columns, axis=1, kind="stable"), np.argsort(columns, axis=1, kind="stable"), by_norm])
        self.value = np.take_along_axis(np.concatenate([columns, columns]), self.order[:-1], 1)
        self.looked = 0

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows besides those of id `own`, best first, ties to the smaller id; with a floor,
        those of them that reach it.

        Sorted access: every list is read from its best end for the query's sign, and the list of norms. Random access:
        a row that appears for the first time is scored in full. All rows not seen are bounded by the threshold, the
        score of a row that stood at the present depth in every list, and by the norms of query and row at that depth;
        the search ends once the k-th score, or the floor, is above the bound."""
        dims = np.flatnonzero(q != 0)
        lists, weights = dims + len(q) * (q[dims] < 0), q[dims]
        read = np.append(lists, len(self.order) - 1)
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * (1 + 1e-9)
        n = len(self.ids)
        seen = self.ids == own
        left = n - int(seen.sum())
        score, row = np.empty(0, q.dtype), np.empty(0, np.int64)
        depth, step = 0, max(64, k)
        while left and depth < n:
            end = min(n, depth + step)
            mask = np.zeros(n, bool)
            mask[self.order[read, depth:end]] = True
            mask &= ~seen
            new = np.flatnonzero(mask)
            seen |= mask
            left -= len(new)
            self.looked += len(new)
            found = self.x[new] @ q
            least = score[-1] if len(score) == k else floor
            if least is not None:
                fit = found >= least
                new, found = new[fit], found[fit]
            score, row = np.concatenate([score, found]), np.concatenate([row, new])
            best = np.lexsort((row, -score))[:k]
            score, row = score[best], row[best]
            depth, step = end, step * 2
            least = score[-1] if len(score) == k else floor
            if least is not None:
                bound = self.value[lists, end - 1] @ weights if len(lists) else 0  # a query of zeros: all score 0
                if least > bound or float(least) > length * self.norms[self.order[-1, end - 1]]:
                    break
        return [(int(s), int(i)) for s, i in zip(score, self.ids[row], strict=True)]


def _exact(rows: pd.Series) -> np.ndarray:
    """Integer vectors in the smallest of float, double and Python integers in which products and sums stay exact."""
    x = np.floor(256 * np.array(rows.tolist(), np.float64))
    largest = np.abs(x).max() ** 2 * x.shape[1] if x.size else 0
    if largest >= 2**52:
        return np.array([[int(v) for v in r] for r in x], object)
    return x.astype(np.float32) if largest < 2**24 else x


def _block(k: int, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(candidates) and len(queries):
        both = _exact(pd.concat([candidates["v"], queries["v"]]))
        lists = Lists(candidates["vec_id"].to_numpy(np.int64), both[: len(candidates)])
        for own, q, floor in zip(queries["vec_id"], both[len(candidates) :], queries["floor"], strict=True):
            out += [(own, s, i) for s, i in lists.search(own, q, k, None if pd.isna(floor) else int(floor))]
    return pd.DataFrame(out, columns=["query_id", "score", "vec_id"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, rows: int = 8192, queries: int = 1024) -> DataFrame:
    """For each vec_id divisible by `every`: its k best other rows by inner product of floor(256 * x): query_id, rank,
    vec_id, score.

    Candidates are dealt into blocks of about `rows`, queries into blocks of about `queries`; a task runs the
    threshold algorithm for one pair of blocks, and the k best of each block are merged. Each block of queries goes
    through one block of candidates first; the k-th score found there is its floor in the others, where no row below it
    is kept and a search ends as soon as the bound is. Inside a block the threshold is exact, so nothing is lost.

    Vectors that are null or hold null or non-finite components, and null ids, take no part; nor do vectors with a
    component so large that a score with their like might not fit a long (about 1.5e6 with 64 dimensions). Vectors meet those of
    equal length only. A repeated vec_id is one query (its smallest vector), and each of its rows a candidate for
    others; its rows are dealt over the blocks by their vectors. Ties go to the smaller vec_id. Fewer than k others: all of them. Empty table: no rows.
    """
    fits = "x is not null and not isnan(x) and (abs(double(x)) * 256 + 1) * sqrt(double(size(embedding))) < sqrt(9.2e18D)"
    fine = f"vec_id is not null and embedding is not null and forall(embedding, x -> {fits})"
    v = vectors.where(fine).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    many = v.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    d, b = -(-many.n // rows) or 1, -(-many.q // queries) or 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    by_row = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("dim", F.size("v"))
    left = v.withColumn("db", (by_row % d).cast("int")).withColumn("qb", span(b))
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = asked.withColumn("qb", (block % b).cast("int"))
    keys, first = ["dim", "qb", "db"], F.col("qb") % d

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        return pairs.applyInPandas(lambda x, y: _block(k, x, y), "query_id long, score long, vec_id long")

    opening = asked.withColumn("db", first).withColumn("floor", F.lit(None).cast("string"))
    found = searched(left.where(F.col("db") == first), opening)
    if d > 1:
        found = written(found, "topk")
        floors = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("string")).alias("floor"))
        rest = asked.withColumn("db", span(d)).where(F.col("db") != first).withColumnRenamed("vec_id", "query_id")
        rest = rest.join(floors, "query_id", "left")
        found = found.union(searched(left.where(F.col("db") != first), rest.withColumnRenamed("query_id", "vec_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
