"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes, written

PARTS = 8  # windows over one arc
COPIES = 65_536  # equal rows dealt out at a time


def ring(spark, shards: int, points: int) -> DataFrame:
    """Rows (arc, shard, replica, at): virtual nodes in clockwise order, arc counting them. A node's place is the hash
    of (shard, replica), so that another shard adds its own nodes and leaves all others where they are.
    shards * points rows, whatever the data."""
    nodes = spark.range(shards * points, numPartitions=1).select(
        F.expr(f"cast(id div {points} as int)").alias("shard"), F.expr(f"cast(id % {points} as int)").alias("replica")
    )
    nodes = nodes.withColumn("at", F.xxhash64(F.lit("node"), "shard", "replica"))
    line = Window.orderBy("at", "shard", "replica")
    return nodes.select("shard", "replica", "at", (F.row_number().over(line) - 1).cast("int").alias("arc"))


def _arc(key: Column, nodes: Column) -> Column:
    """Number of nodes at or below a key's place, by binary search in the sorted array of the nodes' places."""
    step = lambda acc, _: F.when(
        acc["lo"] < acc["hi"],
        F.when(
            F.get(nodes, ((acc["lo"] + acc["hi"]) / 2).cast("int")) <= key,
            F.struct((((acc["lo"] + acc["hi"]) / 2).cast("int") + 1).alias("lo"), acc["hi"].alias("hi")),
        ).otherwise(F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))),
    ).otherwise(acc)
    start = F.struct(F.lit(0).alias("lo"), F.size(nodes).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step)["lo"]


def part_of() -> Column:
    """The part of its arc that a row is ranked in: by hash of all that tells rows apart."""
    return F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")


def assign(docs: DataFrame, shards: int = 24, points: int = 128, slack: float = 0.0) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, moved.

    A row's place on the ring is the hash of its doc_id; it belongs to the next node clockwise. A shard takes at
    most its capacity: with slack 0 the row count dealt out evenly (counts differ by one at most), else
    ceil((1 + slack) * rows / shards). A shard fills its own arcs in ring order; rows beyond its capacity stand in
    one line, in ring order, and walk clockwise (two laps at most) to shards with room. `moved` marks those. One more
    shard takes the arcs before its own nodes and leaves the other nodes' places and owners as they are; besides
    those rows only some near the edge of a shard's capacity go elsewhere.

    Ranks inside an arc come from `PARTS` windows over it, of about 1 / (shards * points * PARTS) of the rows each;
    rows equal in doc_id, size and CRC are counted before they meet there and dealt out again after, `COPIES` at a
    time, so neither a null id nor a repeated row fills a task. Only the counts of the shards * points arcs are
    gathered in one row, where a fold walks the ring; the result, ranges of ranks, goes back to the rows by a join
    whose small side has at most three rows an arc. Slots follow from ranks, without a window over a shard.

    Null text has size 8 and the CRC of no bytes. A null doc_id has a place like any other. Repeated rows each take
    a slot, rows of one arc in order of part, hash, doc_id, CRC and size. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    body = text_bytes()
    nodes = ring(spark, shards, points)
    at = ",".join(f"{r['at']}L" for r in nodes.orderBy("arc").collect())  # shards * points numbers that no data change
    places = F.expr(f"array({at})")
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    arcs = shards * points
    rows = rows.withColumn("hash", F.xxhash64(F.lit("key"), "doc_id"))
    rows = rows.withColumn("arc", F.pmod(_arc(F.col("hash"), places), F.lit(arcs))).withColumn("part", part_of())
    order = Window.partitionBy("arc", "part").orderBy("hash", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = written(rows.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))), "ring")

    # arcs * PARTS counts at most; where each part of an arc begins
    parts = ranked.groupBy("arc", "part").agg(F.sum("copies").alias("n"))
    ahead = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "ring-parts")
    ranked = ranked.join(F.broadcast(parts.drop("n")), ["arc", "part"]).withColumn("rank", F.col("before") + F.col("ahead"))
    few = ranked.where("copies = 1").select("doc_id", "size", "text_crc32", "arc", "rank")
    many = ranked.where("copies > 1").withColumn("lot", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    many = many.repartition("doc_id", "size", "text_crc32", "lot").withColumn(
        "k", F.explode(F.expr(f"sequence(lot, least(lot + {COPIES}, copies) - 1)"))
    )
    ranked = few.union(many.select("doc_id", "size", "text_crc32", "arc", F.col("rank") + F.col("k")))

    found = parts.groupBy("arc").agg(F.sum("n").alias("n"))
    counts = nodes.join(found, "arc", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    exact = F.floor(total / shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    bounded = F.ceil((1 + slack) * total / shards)
    counts = counts.withColumn("cap", (exact if slack == 0 else bounded).cast("long"))
    own = Window.partitionBy("shard").orderBy("arc")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("base", F.least("cap", before)).withColumn("taken", F.least("n", F.col("cap") - F.col("base")))
    around = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("left", F.sum(F.col("n") - F.col("taken")).over(around))
    counts = written(counts, "ring-counts")

    # the walk: state is how many of the line have found room, the room left by shard, and the ranges so far
    used = F.sum("taken").over(Window.partitionBy("shard"))
    room = F.struct("shard", (F.col("cap") - F.col("used")).alias("room"), "used")
    line = counts.withColumn("used", used).agg(
        F.sort_array(F.collect_list(F.struct("arc", "shard", "left"))).alias("line"),
        F.transform(F.sort_array(F.collect_set(room)), lambda x: F.struct(x["room"].alias("room"), x["used"].alias("used"))).alias("rooms"),
    )
    walk = line.selectExpr(
        """aggregate(
             concat(transform(line, x -> named_struct('shard', x.shard, 'left', x.left)),
                    transform(line, x -> named_struct('shard', x.shard, 'left', line[size(line) - 1].left))),
             named_struct('done', 0L, 'rooms', rooms, 'ranges', cast(array() as array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>)),
             (acc, x) -> if(x.left <= acc.done or rooms[x.shard].room = 0 or acc.rooms[x.shard].room = 0, acc,
               named_struct(
                 'done', acc.done + least(x.left - acc.done, acc.rooms[x.shard].room),
                 'rooms', transform(acc.rooms, (r, i) -> if(i = x.shard, named_struct(
                    'room', r.room - least(x.left - acc.done, r.room), 'used', r.used + least(x.left - acc.done, r.room)), r)),
                 'ranges', concat(acc.ranges, array(named_struct(
                    'lo', acc.done, 'hi', acc.done + least(x.left - acc.done, acc.rooms[x.shard].room),
                    'shard', x.shard, 'slot', acc.rooms[x.shard].used)))))
           ).ranges as ranges"""
    )
    # ranges of ranks by arc: what the shard itself took, and the parts of its rest that went elsewhere
    kept = counts.where("taken > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("taken").alias("hi"), "shard", F.col("base").alias("slot"), F.lit(False).alias("moved"))
    rest = counts.where("n > taken").select("arc", "taken", (F.col("left") - F.col("n") + F.col("taken")).alias("from"), F.col("left").alias("to"))
    r = walk.select(F.explode("ranges").alias("r")).select("r.*")
    gone = rest.join(F.broadcast(r), (F.col("lo") < F.col("to")) & (F.col("hi") > F.col("from"))).select(
        "arc",
        (F.greatest("lo", "from") - F.col("from") + F.col("taken")).alias("lo"),
        (F.least("hi", "to") - F.col("from") + F.col("taken")).alias("hi"),
        "shard",
        (F.col("slot") + F.greatest("lo", "from") - F.col("lo")).alias("slot"),
        F.lit(True).alias("moved"),
    )
    # at most 3 * shards * points ranges: each arc's own, and two more for every stop of the walk
    plan = kept.union(gone).groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot", "moved")).alias("plan"))
    plan = written(plan, "ring-plan")
    hit = F.filter("plan", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    out = ranked.join(F.broadcast(plan), "arc").withColumn("hit", hit)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if slack == 0 else "bounded").alias("law"),
        F.col("hit.shard").alias("shard"),
        (F.col("hit.slot") + F.col("rank") - F.col("hit.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("hit.moved").alias("moved"),
    )
