"""What the operators share: the shared folder, written tables and access to files from inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; another operator's is let go first, so that a
    chain of operators needs no more memory than one of them."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests, one machine) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='sightline-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sightline/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about BATCH_BYTES (or one larger row), if it has no
    limit of its own: by default a batch of texts is 10,000 rows or 64 MB, which JVM and Python hold several times over."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def make_dir(spark: SparkSession, path: str) -> str:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)
    return path


def opened(uri: str, mode: str):
    """A file of the shared folder from inside a task, whatever file system the folder's URI names."""
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs.open_output_stream(path, compression=None) if mode == "wb" else fs.open_input_file(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
