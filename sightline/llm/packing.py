"""Concatenate and cut: token ids of all documents in one line, cut into windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import PART_CHARS, Encoder, sliced


def encoded(docs: DataFrame, tokenizer: str, end_id: int, keep: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (part, doc_id, before, n, ids): ids as little-endian unsigned 32-bit numbers with the end id, `before`
    the ids of the part's earlier documents. A part is what one task read; the table is written once, so that the
    order in it stays when a task runs again."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = Encoder.of(tokenizer, keep, part_chars), TaskContext.get().partitionId(), 0
        for batch in sliced(batches, size=part_chars):
            before, ids = [], []
            for found in encode.many(batch.column(1).to_pylist()):
                ids.append(found + end)
                before.append(total)
                total += len(ids[-1]) // 4
            n = [len(x) // 4 for x in ids]
            columns = [pa.array([part] * len(n), pa.int32()), batch.column(0), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "before", "n", "ids"])
        pa.default_memory_pool().release_unused()  # else a worker that waits keeps what its arrays took

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "part int, doc_id long, before long, n long, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, keep: int | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, crosses (the document goes on in
    the next sequence), ids (binary, little-endian unsigned 32-bit).

    Pass 1 encodes every text where it is read and writes ids with prefix sums inside each part. The totals of the
    parts, one row a part, give each part's global offset; pass 2 adds it and cuts at multiples of `length`. No text
    or id is shuffled. Sequences are full but for the last, so padding is under `length` ids in all.

    Null text counts as empty: the document is its end id. Repeated rows are packed as often as they occur. A null
    doc_id is carried along. Other columns of docs are ignored. An empty table gives no rows.

    A worker keeps the ids of about `keep` chunks and encodes `part_chars` characters at once: less of either takes
    less memory and more time; the rows are the same.
    """
    ids = encoded(docs, tokenizer, end_id, keep, part_chars)
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base"))
    # one row of 12 bytes for each file split: under 1 MB for 10 TB of splits of 128 MB
    placed = ids.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("before"))
    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at")))
    cut = cut.withColumn("length", F.least("n", (F.col("sequence_id") + 1) * length - F.col("at")) - F.col("start"))
    piece = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select(
        "doc_id",
        "start",
        "length",
        F.crc32(piece).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
        (F.col("start") + F.col("length") < F.col("n")).alias("crosses"),
        piece.alias("ids"),
    )
