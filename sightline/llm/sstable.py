"""Sorted-string-table shards: entries by key in prefix-compressed blocks, with block index, Bloom filter and footer.

File: blocks | index | Bloom filter | footer.
Block, compressed by zlib: entries (shared u16, rest u16, value u32, rest of the key, value), shared 0 every 16 entries.
Index: per block (key length u16, first key, offset u64, length u32). Footer of 48 bytes: offset and length of index
and filter (4 x u64), entries u64, number of hashes u32, magic. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import make_dir, new_dir, opened, written
from .tokens import Encoder, sliced

MAGIC = b"SLT1"
FOOTER = struct.Struct("<5QI4s")
ENTRY = struct.Struct("<HHI")
RESTART = 16
FILE_BYTES = 256 << 20  # a file is closed beyond these bytes of blocks, or these keys
FILE_KEYS = 4_000_000
RANGE_BYTES = 2 << 30  # a range, which one task sorts and encodes, has about these bytes of text at most


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do; null first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


class Writer:
    """Appends entries in key order to a binary stream; holds one block, the index and 8 bytes a key."""

    def __init__(self, out, block_bytes: int = 65536, bits: int = 10):
        self.out, self.block_bytes, self.bits = out, block_bytes, bits
        self.at, self.entries, self.block, self.size, self.last = 0, 0, [], 0, b""
        self.index: list[bytes] = []
        self.hashes = array("Q")
        self.first = b""

    def add(self, key: bytes, value: bytes) -> None:
        n = len(self.block)
        if n == 0:
            self.first = key
        shared = 0
        if n % RESTART:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        entry = ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.entries += 1
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QI", self.at, len(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> int:
        self._flush()
        index, k = b"".join(self.index), 7
        m = max(64, self.bits * self.entries)
        field = np.zeros((m + 7) // 8, np.uint8)
        h = np.frombuffer(self.hashes, np.uint64) if self.hashes else np.zeros(0, np.uint64)
        for i in range(k):
            bit = (h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) % np.uint64(len(field) * 8)
            np.bitwise_or.at(field, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        self.out.write(index)
        self.out.write(field.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(field), self.entries, k, MAGIC))
        self.out.close()
        return self.at + len(index) + len(field) + FOOTER.size


class Reader:
    """A file of Writer: all entries in order, or those of one key by filter, binary search and one block."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - FOOTER.size)
        index_at, index_len, self.filter_at, self.filter_len, self.entries, self.k, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        file.seek(index_at)
        raw, i = file.read(index_len), 0
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while i < len(raw):
            n = struct.unpack_from("<H", raw, i)[0]
            self.firsts.append(raw[i + 2 : i + 2 + n])
            self.places.append(struct.unpack_from("<QI", raw, i + 2 + n))
            i += 14 + n

    def block(self, b: int) -> Iterator[tuple[bytes, bytes]]:
        at, length = self.places[b]
        self.file.seek(at)
        raw, i, key = zlib.decompress(self.file.read(length)), 0, b""
        while i < len(raw):
            shared, rest, value = ENTRY.unpack_from(raw, i)
            i += ENTRY.size
            key = key[:shared] + raw[i : i + rest]
            i += rest
            yield key, raw[i : i + value]
            i += value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.places)):
            yield from self.block(b)

    def may_hold(self, key: bytes) -> bool:
        h, m = xxhash.xxh64_intdigest(key), self.filter_len * 8
        for i in range(self.k):
            bit = (h + i * (h >> 32 | 1)) % 2**64 % m
            self.file.seek(self.filter_at + bit // 8)
            if not self.file.read(1)[0] >> bit % 8 & 1:
                return False
        return True

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key, in file order; equal keys may run over several blocks."""
        if not self.places or not self.may_hold(key):
            return []
        b = bisect_right(self.firsts, key) - 1
        while b > 0 and self.firsts[b] == key:
            b -= 1
        found = []
        for b in range(max(b, 0), len(self.places)):
            if self.firsts[b] > key:
                break
            found += [v for k, v in self.block(b) if k == key]
        return found


def _packed(ids: bytes) -> bytes:
    """Ids at two bytes each where they fit, told by the first byte."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if len(wide) and wide.max() < 65536 else b"\x04" + ids


def _unpacked(value: bytes) -> bytes:
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[0] == 2 else value[1:]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES, file_keys: int = FILE_KEYS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Encodes docs and writes sorted files, one or more for each range of (doc_id, hash of text); returns the manifest
    (shard, path, part, seq, first_id, last_id, docs, tokens, bytes, start), start being the ids of all earlier files.

    Texts move once, to their range; there are as many ranges as range_bytes of text ask for, or as shuffles have
    partitions, if that is more; equal ids may lie in several ranges, and in several files that follow each other.
    Ids are made beside the writer. A file ends at file_bytes of blocks or file_keys keys, so neither its index nor its
    filter grows with the data. Each attempt of a task writes files of its own, and only those named in the manifest
    count, so retried or doubled tasks do no harm.
    """
    spark = docs.sparkSession
    root = make_dir(spark, new_dir(spark, "sst"))
    end = int(end_id).to_bytes(4, "little")
    names = ("part", "seq", "first_id", "last_id", "docs", "tokens", "bytes")
    schema = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        writer, row = None, {}

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"docs": writer.entries, "bytes": writer.close()}], schema)

        for batch in sliced(batches):
            for doc_id, found in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist()), strict=True):
                if writer is not None and (writer.at >= file_bytes or writer.entries >= file_keys):
                    yield closed()
                    writer, seq = None, seq + 1
                if writer is None:
                    row = {"path": f"{root}/{uuid.uuid4().hex}.sst", "part": part, "seq": seq, "first_id": doc_id, "tokens": 0}
                    writer = Writer(opened(row["path"], "wb"))
                ids = found + end
                writer.add(key_of(doc_id), _packed(ids))
                row["last_id"] = doc_id
                row["tokens"] += len(ids) // 4
        if writer is not None:
            yield closed()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    ranged = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    files = written(ranged.mapInArrow(run, "path string, " + ", ".join(f"{c} long" for c in names)), "sst-manifest")
    line = Window.orderBy("part", "seq")  # a row a file; ranges follow each other by number
    return files.select(
        (F.row_number().over(line) - 1).alias("shard"),
        "*",
        F.coalesce(F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every entry of the manifest's files, a file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with opened(path, "rb") as file:
                    for key, value in Reader(file):
                        ids = _unpacked(value)
                        rows.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) >= 50_000:
                            yield out(rows)
                            rows = []
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Ids of each wanted document: the files whose range holds the key, then filter, index and one block."""
    found: dict[int, list[list[int]]] = {i: [] for i in doc_ids}
    for i in doc_ids:
        for row in manifest.where((F.col("last_id") >= i) & (F.coalesce("first_id", F.lit(i)) <= i)).orderBy("shard").collect():
            with opened(row.path, "rb") as file:
                found[i] += [np.frombuffer(_unpacked(v), "<u4").tolist() for v in Reader(file).get(key_of(i))]
    return found


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs as sorted-string tables and reads them back: per row doc_id, start, n_tokens, ids_crc32.

    Null text counts as empty. Repeated doc_ids are kept, in order of the text's hash; null ids come first. Other columns are
    ignored. An empty table writes no file and gives no rows.
    """
    return read_tokens(write_tokens(docs, tokenizer, end_id))
