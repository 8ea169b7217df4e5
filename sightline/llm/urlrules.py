"""Host and path rules over urls by a sort-merge range join with a stack of open rules."""

from __future__ import annotations

import pickle
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_dir, new_dir, opened, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"


def host_key(host: str) -> str:
    """Labels from the right, each ended by a dot: a host and its subdomains are the keys that begin with its key."""
    return "".join(f"{x}." for x in reversed(host.split(".")))


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    host: Column = F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER)
    out = pages.withColumns({"host": host, "path": F.regexp_extract(text, URL, 2)})
    return out.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))


@dataclass
class Host:
    """The rules of one host by path. The paths that begin with a path form an interval behind it; `outer` tells for
    each path the nearest one whose interval it lies in, or -1."""

    key: str
    paths: list[str] = field(default_factory=list)
    rules: list[tuple[str, str]] = field(default_factory=list)  # rule, verdict
    outer: list[int] = field(default_factory=list)

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in order, of one path the rule to prefer first."""
        if self.paths and self.paths[-1] == path:
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.paths.append(path)
        self.rules.append((rule, verdict))
        self.outer.append(at)

    def find(self, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest of the host's paths that `path` begins with."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.rules[at] if at >= 0 else None


def rule_files(rules: DataFrame, block: int) -> list[str]:
    """Writes the rules, sorted by key and path and grouped by host, into files of the shared folder, one a range of
    keys, in frames of about `block` rules; returns the paths in order of keys. The driver sees no rule."""
    spark = rules.sparkSession
    root = make_dir(spark, new_dir(spark, "rules"))
    schema = pa.schema([("part", pa.int64()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, part, hosts, held = None, "", 0, [], 0

        def framed() -> None:
            data = pickle.dumps([(h.key, h.paths, h.rules, h.outer) for h in hosts])
            out.write(struct.pack("<Q", len(data)) + data)
            hosts.clear()

        for batch in batches:
            for number, key, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    at, part = f"{root}/{uuid.uuid4().hex}.rules", number
                    out = opened(at, "wb")
                if not hosts or hosts[-1].key != key:
                    if held >= block:
                        framed()
                        held = 0
                    hosts.append(Host(key))
                hosts[-1].add(path, rule, verdict)
                held += 1
        if out is not None:
            framed()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": at}], schema)

    named = rules.where("host <> ''").select(F.concat(F.lit("://"), "host").alias("u"), F.col("path").alias("p"), F.concat("host", "path").alias("r"), F.col("verdict").alias("v"))
    by_key = with_host_path(named, "u").select(F.col("key").alias("k"), "p", "r", "v").dropna().distinct()
    tasks = max(1, min(by_key.count() // 100_000, 1024))
    ranged = by_key.repartitionByRange(tasks, "k").select(F.spark_partition_id().cast("long").alias("part"), "k", "p", "r", "v")
    ranged = ranged.sortWithinPartitions("k", "p", F.desc(F.col("v") == "block"), "r")
    return [r.path for r in written(ranged.mapInArrow(run, "part long, path string"), "rule-files").orderBy("part").collect()]


def _hosts(paths: list[str]) -> Iterator[Host]:
    """The hosts of the rule files in order of their keys, a frame at a time."""
    for path in paths:
        with opened(path, "rb") as file:
            while len(head := file.read(8)) == 8:
                for host in pickle.loads(file.read(struct.unpack("<Q", head)[0])):
                    yield Host(*host)


def _swept(batches: Iterator[pa.RecordBatch], paths: list[str], default: str) -> Iterator[pa.RecordBatch]:
    """Rows come by key; each moves the sweep on.

    A host's key opens an interval, the keys that begin with it. Two such intervals are nested or apart, so the open
    ones form a stack: those that the row's key does not begin with are closed, those up to it are opened.
    """
    stack: list[Host] = []
    hosts = _hosts(paths)
    ahead = next(hosts, None)
    for batch in batches:
        page_id, host, path_column, key_column = batch.columns
        rules, verdicts = [], []
        for key, path in zip(key_column.to_pylist(), path_column.to_pylist(), strict=True):
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            while ahead is not None and ahead.key <= key:
                if key.startswith(ahead.key):
                    stack.append(ahead)
                ahead = next(hosts, None)
            best, found = (-1, 0), (None, default)
            for depth, open_host in enumerate(stack, 1):
                hit = open_host.find(path)
                if hit is not None and (len(hit[0]), depth) > best:  # longest first, then the longer host
                    best, found = (len(hit[0]), depth), hit
            rules.append(found[0])
            verdicts.append(found[1])
        columns = [page_id, host, path_column, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", block: int = 50_000) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules (host, path, verdict): a rule fits its host and all subdomains where the url's path begins with its path;
    the longest host + path wins, then the longer host, then block. No rule: `default`.

    Urls are sorted by reversed-host key and path inside the partitions they are in, without a shuffle. The rules lie
    sorted in files of the shared folder; each task reads them once, in one pass beside its urls, and holds one frame
    of about `block` rules and the hosts that are open. Of a host's paths the longest fitting one is found by binary
    search and the intervals it lies in. A host with a third of all pages costs no more than others.

    Null url, or one without `://`: empty host and path, no rule. Null page_id is carried along, repeated rows are
    each judged, very long urls are read whole, rules with a null field or an empty host are void. Other columns of
    pages are ignored. An empty table gives no rows.
    """
    paths = rule_files(rules, block)
    rows = with_host_path(pages.select("page_id", "url")).select("page_id", "host", "path", "key")
    schema = "page_id long, host string, path string, rule string, verdict string"
    return rows.sortWithinPartitions("key", "path").mapInArrow(lambda b: _swept(b, paths, default), schema)
