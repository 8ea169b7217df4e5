"""Merkle manifests of a table: trees of a fixed fanout per group and one over the groups, with proofs for every row.

Rows are sorted once by range and written in indexed parts. Each part is read in order by a stack of peaks, one a level,
which closes a node as soon as its last child is there; what a part can't close by itself (its unaligned left edge and
what is open at its end) is closed by one small aggregation a level. Only one row a part goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: What is known of a node's parent when the node is handed out: made by the same stretch, not made yet, or none.
CLOSED, OPEN, TOP = 0, 1, 2
NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("state", pa.int32())])
ABOVE = 1 << 20  # the level under which a block's way upwards is sorted before its nodes


@dataclass(frozen=True)
class Params:
    """Nodes have `fanout` children; proofs are made in blocks of fanout ** `tier` rows; a sorted part holds about
    `part_rows` rows, and there are spark.sql.shuffle.partitions parts at least."""

    fanout: int = 3
    tier: int = 7
    part_rows: int = 1_000_000

    def __post_init__(self):
        if self.fanout < 2 or self.tier < 1:
            raise ValueError("a node has two children or more, and a block one level or more")


@dataclass(frozen=True)
class Manifest:
    """Written tables. leaves: tree, idx, digest and the carried columns. nodes: tree, level, idx, digest, state, of levels
    1 and up and of level 0 where the parent was made by the merge. tops: tree, level, digest. `crown` is the manifest
    of the tree over the tops in the order of their trees, None in itself."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    carried: tuple[str, ...]
    params: Params
    crown: Manifest | None = None


def digest_of(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its UTF-8 byte count, `:` and the value as text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(value: Column) -> Column:
    """A group's key: null before all texts, texts in the order of their UTF-8 bytes."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


class Peaks:
    """The stack of one tree over consecutive leaves: the children of each level whose parent isn't made yet.

    A node goes to `out(level, idx, digest, state)` once it is known whether its parent is made here. That is so if
    all its run was seen, so the first run of a level after an unaligned start is left open.
    """

    def __init__(self, fanout: int, out: Callable[[int, int, str, int], None]):
        self.fanout, self.out, self.levels, self.next = fanout, out, [], -1

    def _hand_out(self, level: int, last: int, state: int) -> list[str]:
        held, self.levels[level] = self.levels[level], []
        for i, digest in enumerate(held, last + 1 - len(held)):
            self.out(level, i, digest, state)
        return held

    def _carry(self, level: int, last: int) -> None:
        """The run at `level` ends with the node `last`."""
        whole = len(self.levels[level]) == last % self.fanout + 1
        held = self._hand_out(level, last, CLOSED if whole else OPEN)
        if whole:
            self._put(level + 1, last // self.fanout, digest_of(*held))

    def _put(self, level: int, idx: int, digest: str) -> None:
        while level >= len(self.levels):
            self.levels.append([])
        self.levels[level].append(digest)
        if idx % self.fanout == self.fanout - 1:
            self._carry(level, idx)

    def add(self, idx: int, digest: str) -> None:
        self._put(0, idx, digest)
        self.next = idx + 1

    def close(self, ended: bool) -> None:
        """The stretch ends: with its tree, whose short runs are hashed as they are, or before it."""
        count, level = self.next, 0  # nodes of the level: all, or those up to where the stretch ends
        while level < len(self.levels):
            if self.levels[level]:
                if ended and count > 1:
                    self._carry(level, count - 1)
                else:
                    self._hand_out(level, count - 1, TOP if ended else OPEN)
            count = -(-count // self.fanout) if ended else count // self.fanout
            level += 1


def _indexed(rows: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """rows(tree, digest, <keys>, <others>) sorted by tree and keys, written, with `idx`, the place in the tree, and
    `ends`, whether the tree ends there. Nothing has to hold about which task reads which rows later on."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // p.part_rows))
    schema = "part int, place long, first boolean, last int, " + ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    names = ["part", "place", "first", "last", *rows.columns]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, place, first, held = TaskContext.get().partitionId(), None, 0, True, None

        def marked(batch: pa.RecordBatch, trees: list[str], after: str | None) -> pa.RecordBatch:
            """last: 1 where the part goes on with another tree, 2 at its end."""
            nonlocal tree, place, first
            places, firsts, lasts = [], [], []
            for name, then in zip(trees, [*trees[1:], after], strict=True):
                if name != tree:
                    first, tree, place = tree is None, name, 0
                places.append(place)
                firsts.append(first)
                lasts.append(2 if then is None else int(then != name))
                place += 1
            own = [pa.array([part] * len(trees), pa.int32()), pa.array(places, pa.int64()), pa.array(firsts, pa.bool_()), pa.array(lasts, pa.int32())]
            return pa.RecordBatch.from_arrays([*own, *batch.columns], names=names)

        for batch in batches:
            if batch.num_rows:
                trees = batch.column(0).to_pylist()
                if held:
                    yield marked(*held, trees[0])
                held = (batch, trees)
        if held:
            yield marked(*held, None)

    order = [F.asc_nulls_first(c) for c in ["tree", *keys, *(c for c in rows.columns if c != "tree" and c not in keys)]]
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(index, schema), "merkle-placed")
    ends = placed.groupBy("part").agg(F.min("tree").alias("low"), F.max(F.when(F.col("last") == 2, F.struct("tree", "place", "first"))).alias("end"))
    found, table, open_tree, so_far = ends.orderBy("part").collect(), [], None, 0  # one row a part
    for i, row in enumerate(found):
        before = so_far if row.low == open_tree else 0  # leaves of the part's first tree in earlier parts
        table.append((row.part, before, i + 1 == len(found) or found[i + 1].low != row.end.tree))
        open_tree, so_far = row.end.tree, row.end.place + 1 + (before if row.end.first else 0)
    at = F.broadcast(spark.createDataFrame(table, "part int, before long, closed boolean"))  # one row a part
    idx = F.col("place") + F.when(F.col("first"), F.col("before")).otherwise(0)
    ended = (F.col("last") == 1) | ((F.col("last") == 2) & F.col("closed"))
    return placed.join(at, "part").select(idx.alias("idx"), ended.alias("ends"), *rows.columns)


def _stacked(leaves: DataFrame, p: Params) -> DataFrame:
    """Nodes of leaves(tree, idx, digest, ends) by the stretches in which they are read. Closed leaves are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        tree, peaks = None, None

        def out(level: int, idx: int, digest: str, state: int) -> None:
            if level or state != CLOSED:
                made.append((tree, level, idx, digest, state))

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), NODE, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=NODE)

        for batch in batches:
            for name, idx, digest, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if peaks is not None and (name != tree or idx != peaks.next):  # another file, or another part of it
                    peaks.close(False)
                    peaks = None
                if peaks is None:
                    tree, peaks = name, Peaks(p.fanout, out)
                peaks.add(idx, digest)
                if ends:
                    peaks.close(True)
                    peaks = None
            if len(made) >= 10_000:
                yield flushed()
        if peaks is not None:
            peaks.close(False)
        if made:
            yield flushed()

    return leaves.select("tree", "idx", "digest", "ends").mapInArrow(run, "tree string, level int, idx long, digest string, state int")


def _merged(nodes: DataFrame, p: Params) -> DataFrame:
    """nodes, and level by level the parents of those left open. A run that no stretch saw whole has `fanout` open nodes
    at most, from whatever parts; open nodes are some 2 * fanout a level of each part."""
    most = nodes.where(F.col("state") == OPEN).agg(F.max("level")).first()[0]
    whole, level, frontier = nodes, 0, nodes.where((F.col("state") == OPEN) & (F.col("level") == 0))
    while most is not None:
        runs = frontier.groupBy("tree", F.expr(f"idx div {p.fanout}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("c"))
        runs = runs.where("run > 0 or size(c) > 1")  # a node alone at the start of its level is the top
        parents = runs.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.sha2(F.array_join("c.digest", ""), 256).alias("digest"), F.lit(OPEN).alias("state"))
        parents = written(parents, "merkle-parents")
        if level >= most and parents.isEmpty():
            break
        whole, level = whole.unionByName(parents), level + 1
        frontier = nodes.where((F.col("state") == OPEN) & (F.col("level") == level)).unionByName(parents)
    return whole


def trees(rows: DataFrame, keys: list[str], params: Params = Params()) -> Manifest:
    """The trees of rows(tree, digest, <keys>, <others>): leaves in the order of the keys, then of the digests."""
    rows = rows.select("tree", "digest", *(c for c in rows.columns if c not in ("tree", "digest")))
    leaves = _indexed(rows, keys, params)
    nodes = _merged(written(_stacked(leaves, params), "merkle-nodes"), params)
    tops = nodes.groupBy("tree").agg(F.max(F.struct("level", "digest")).alias("top")).select("tree", "top.level", "top.digest")
    return Manifest(leaves, nodes, written(tops, "merkle-tops"), tuple(rows.columns[2:]), params)


def build(rows: DataFrame, keys: list[str], params: Params = Params()) -> Manifest:
    """The manifest of rows(tree, digest, <keys>, <others>) with a crown over its trees. The table's root is the crown's
    one top. Equal keys are ordered by digest; no rows give tables without rows."""
    own = trees(rows, keys, params)
    crown = trees(own.tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name")), ["name"], params)
    return Manifest(own.leaves, own.nodes, own.tops, own.carried, params, crown)


def _climbed(m: Manifest, tier: int, ups: DataFrame) -> DataFrame:
    """For each node at the lowest level of the tier its way to the root: rows (tree, g, depth, top, root, path, digest)
    and, at tier 0, the carried columns; g is the node's idx.

    ups(tree, g, depth, top, root, path) has the way of the node above each block. A block is the nodes under it down to
    the tier's lowest level, fanout ** tier leaves at most; tasks hold one block at a time.
    """
    p, low = m.params, tier * m.params.tier
    high, carried = low + p.tier, list(m.carried) if tier == 0 else []
    kinds = dict(m.leaves.dtypes)

    def in_block(level: Column) -> Column:
        return F.floor(F.col("idx") / F.pow(F.lit(float(p.fanout)), F.lit(high) - level)).cast("long")

    none = [F.lit(None).cast(kinds[c]).alias(c) for c in carried]
    nodes = m.nodes.where(F.col("level").between(max(low, 1), high - 1))
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("depth", "int"), ("top", "string"), ("root", "string"), ("path", "string"))]
    rows = nodes.select("tree", in_block(F.col("level")).alias("g"), "level", "idx", "digest", *blank, *none)
    rows = rows.unionByName(ups.select("tree", "g", F.lit(ABOVE).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit("").alias("digest"), "depth", "top", "root", "path", *none))
    if tier == 0:
        rows = rows.unionByName(m.leaves.select("tree", in_block(F.lit(0)).alias("g"), F.lit(0).alias("level"), "idx", "digest", *blank, *carried))
    rows = rows.repartition("tree", "g").sortWithinPartitions("tree", "g", F.desc("level"), "idx")
    out_names = ["tree", "g", "depth", "top", "root", "path", "digest", *carried]
    schema = "tree string, g long, depth int, top string, root string, path string, digest string" + "".join(f", `{c}` {kinds[c]}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, levels, extra = None, None, {}, []

        def block() -> pa.RecordBatch:
            tree, g = key
            depth, top, root, path = above
            end = min(high, depth)
            ways = [path]
            for level in range(end - 1, low - 1, -1):  # from the top: each node's run, then the way of its parent
                held, over, ways = levels[level], ways, []
                for i, _ in enumerate(held):
                    start = i - i % p.fanout
                    own = "".join(held[start:i]) + "." + "".join(held[i + 1 : start + p.fanout])
                    rest = over[i // p.fanout]
                    ways.append(f"{own}/{rest}" if rest else own)
            items = levels[low]
            first = g * p.fanout**p.tier
            n = len(items)
            columns = [[tree] * n, range(first, first + n), [depth] * n, [top] * n, [root] * n, ways, items]
            fields = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, fields, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.concat_arrays(x) for x in zip(*extra, strict=True))], names=out_names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for i, (tree, g, level, _, digest, *way) in enumerate(zip(*columns, strict=True)):
                if (tree, g) != key:
                    if key is not None:
                        yield block()
                    key, levels, extra = (tree, g), {}, []
                if level == ABOVE:
                    above = way
                    continue
                levels.setdefault(level, []).append(digest)
                if level == low and carried:
                    extra.append([c.slice(i, 1) for c in batch.columns[9:]])
        if key is not None:
            yield block()

    return rows.mapInArrow(run, schema)


def _ways(m: Manifest, tops: DataFrame) -> DataFrame:
    """The way of every leaf of m to the root: _climbed at tier 0, from tops(tree, depth, top, root, path)."""
    p = m.params
    deepest = tops.agg(F.max("depth")).first()[0] or 0
    tops = tops.withColumn("g", F.lit(0).cast("long"))
    ups = None
    for tier in range(deepest // p.tier, -1, -1):
        here = tops.where(F.expr(f"depth div {p.tier}") == tier).select("tree", "g", "depth", "top", "root", "path")
        ups = here if ups is None else here.unionByName(ups.select(*here.columns))
        ups = _climbed(m, tier, ups)
        if tier:
            ups = written(ups, "merkle-ways")
    return ups


def proofs(m: Manifest) -> DataFrame:
    """Per leaf: tree, idx, digest, subroot, root, path and the carried columns.

    A path is the levels from the leaf to the root, parted by `/`; each is the digests of the run's nodes left of the way,
    `.`, and those right of it, in hex. A run of one is `.`; a table of one row has the empty path.
    """
    crown = m.crown.tops.select("tree", F.col("level").alias("depth"), F.col("digest").alias("top"), F.col("digest").alias("root"), F.lit("").alias("path"))
    over = written(_ways(m.crown, crown).select(F.col("name").alias("tree"), "root", "path"), "merkle-crown")
    tops = m.tops.select("tree", F.col("level").alias("depth"), F.col("digest").alias("top")).join(over, "tree")
    found = _ways(m, written(tops, "merkle-over"))
    return found.select("tree", F.col("g").alias("idx"), "digest", F.col("top").alias("subroot"), "root", "path", *m.carried)


def siblings(path: Column) -> Column:
    """The digests of a path, left to right, level by level."""
    return F.translate(path, "./", "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    levels = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.aggregate(levels, start, lambda below, x: F.sha2(F.concat(F.split_part(x, F.lit("."), F.lit(1)), below, F.split_part(x, F.lit("."), F.lit(2))), 256))


def verified(docs: DataFrame, by: str, order: str, fields: list[str], altered: dict[str, Column], where: Column, params: Params = Params()) -> DataFrame:
    """Per row of docs: <order>, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are of `fields`, trees of the rows that share `by`, in the order of `order` (null first, ties by leaf). Rows
    for which `where` is true are held against the manifest with the fields `altered` in place of their own, the others
    as they are; folded_root is what such a leaf and the siblings of the manifest lead to, and verified whether that
    is the root. A null `where` counts as false, null fields are `-`, a null `by` is the first group. Rows that are
    equal have leaves of their own. Other columns are not looked at. An empty table gives no rows.
    """
    other = leaf(*(altered.get(c, F.col(c)) for c in fields))
    rows = docs.select(tree_key(F.col(by)).alias("tree"), leaf(*map(F.col, fields)).alias("digest"), F.col(order).alias("key"), F.when(where, other).alias("other"))
    rows = written(rows, "merkle-rows")  # texts are read once
    found = proofs(build(rows, ["key"], params))
    found = found.withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("path")))
    out = found.select(
        F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root"
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    out = written(out, "merkle")
    dropped(docs.sparkSession, rows)
    return out
