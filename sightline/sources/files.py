"""Scans: catalogues, watchlists, evidence folders, and replays of stored sightings as streams."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = {"parquet": "parquet", "json": "json", "csv": "csv", "orc": "orc"}


def catalogue(spark: SparkSession, live: str, snapshot: str) -> tuple[DataFrame, bool]:
    """Rows (id, name) of the live list, else of the snapshot; and whether the live list answered. A live list that
    answers replaces the snapshot."""
    try:
        rows = spark.read.schema("id string, name string").option("mode", "FAILFAST").json(live)
        rows.write.mode("overwrite").json(snapshot)
        return spark.read.schema("id string, name string").json(snapshot), True
    except PySparkException:
        return spark.read.schema("id string, name string").json(snapshot), False


def watchlist_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV with a header in any case; plates upper-cased without blanks, rows without a plate dropped."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    return rows.withColumn("plate", F.upper(F.regexp_replace("plate", " ", ""))).where("plate <> ''").fillna("")


def evidence(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Files (path, name, mtime_us, bytes) of a folder tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("bytes"))


def replay(spark: SparkSession, kind: str, folder: str, schema: StructType, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream over the files of a folder, of those whose name fits the pattern if one is given; the number of files a trigger holds back pressure, nothing is dropped."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of source: {kind}")
    reader = spark.readStream.schema(schema).format(KINDS[kind])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)
