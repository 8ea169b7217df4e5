"""WARC archives of pages, written and read as rows of record id and chunk number with running digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_dir, new_dir, opened, written

CHUNK = 256 * 1024
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "page_id long, record_type string, refers_to long, target_uri string, chunk_no long, offset long, size long,"
    " payload_bytes long, digest string, last boolean, data binary"
)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def chunked(pages: DataFrame, min_revisit_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, bytes, sha1, refers_to, chunk_no, chunks, data) of the records to write.

    Payloads are compared by SHA-1 and size. The digests are reduced to one row a repeated payload before they meet
    the pages again; the join can split a payload that many pages hold. Chunks of a record stay beside each other.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")
    )
    same = base.groupBy("sha1", "bytes").agg(F.count("*").alias("copies"), F.max("page_id").alias("response"))
    same = same.where(f"copies > 1 and bytes >= {min_revisit_bytes}").drop("copies")
    marked = base.join(same, ["sha1", "bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    marked = marked.withColumn("refers_to", F.when(revisit, F.col("response")))
    count = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk))).cast("int")
    piece = F.when(F.col("refers_to").isNull(), F.expr(f"substring(payload, cast(k * {chunk} + 1 as int), {chunk})"))
    return (
        marked.withColumn("chunks", count)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("page_id", "url", "bytes", "sha1", "refers_to", F.col("k").alias("chunk_no"), "chunks", piece.alias("data"))
    )


def _head(page_id, url, size: int, sha1: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    lines += [f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    length = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


def write(chunks: DataFrame, date: str = "2024-01-01T00:00:00Z", level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of chunked() as .warc.gz files, a gzip member a record; returns (path, records, bytes).

    A writer holds one chunk. A file is named at random and counts only if the table returned names it, so a retried
    or doubled task adds nothing.
    """
    spark = chunks.sparkSession
    root = make_dir(spark, new_dir(spark, "warc"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, total = None, "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, size, sha1, refers_to, chunk_no, count, data = row
                if chunk_no == 0:
                    if out is not None and total >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": total}], schema)
                        out = None
                    if out is None:
                        path, records, total = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = opened(path, "wb")
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    total += out.write(z.compress(_head(page_id, url, size, sha1, refers_to, date))) or 0
                total += out.write(z.compress(data or b"")) or 0
                if chunk_no == count - 1:
                    total += out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": total}], schema)

    return written(chunks.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream, chunk: int = CHUNK, with_data: bool = True) -> Iterator[dict]:
    """Chunk rows of one opened archive. `digest` is the SHA-1 of the payload up to the chunk's end; of a revisit,
    which holds no payload, the row tells size and digest of the payload it stands for."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _headers(stream)
        left = int(head["content-length"])
        row = {"page_id": _page(head.get("warc-record-id")), "record_type": head.get("warc-type"), "refers_to": _page(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri")}
        lines = [stream.readline()]  # the HTTP head
        while lines[-1] not in (b"\r\n", b"\n", b""):
            lines.append(stream.readline())
        left -= sum(map(len, lines))
        http = _headers(io.BytesIO(b"".join(lines[1:])))
        if row["record_type"] == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            yield row | {"chunk_no": 0, "offset": 0, "size": 0, "payload_bytes": int(http.get("content-length", 0)), "digest": digest, "last": True, "data": b""}
            continue
        sha1, at, k = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"record {head.get('warc-record-id')} ends early")
            left -= len(data)
            sha1.update(data)
            at += len(data)
            last = left == 0
            digest = base64.b32encode(sha1.digest()).decode()
            if last and f"sha1:{digest}" != head.get("warc-payload-digest"):
                raise ValueError(f"record {head.get('warc-record-id')}: its payload is not what its header says")
            yield row | {"chunk_no": k, "offset": at - len(data), "size": len(data), "payload_bytes": at, "digest": digest, "last": last, "data": data if with_data else None}
            k += 1
            if last:
                break


def read(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in files(path), an archive a task, a chunk at a time."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())]
        + [(c, pa.int64()) for c in ("chunk_no", "offset", "size", "payload_bytes")]
        + [("digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(path, "rb") as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in records(stream, chunk, with_data):
                        rows.append(row)
                        held += len(row["data"] or b"")
                        if len(rows) >= 5_000 or held >= 16 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) and reads the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri, chunks.

    Null html is an empty payload. Of equal payloads of at least min_revisit_bytes, the record of the largest page_id
    is the response; rows that repeat that id are responses too. A null page_id is never the one referred to unless
    all of its payload's ids are null. Null url: the record id stands as target. Other columns are ignored. An empty
    table gives no archive and no rows.
    """
    rows = read(write(chunked(pages, min_revisit_bytes)), with_data=False).where("last")
    return rows.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "target_uri", (F.col("chunk_no") + 1).alias("chunks")
    )
