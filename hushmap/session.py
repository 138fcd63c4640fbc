"""Session-level helpers: shared storage, small fixed tables, spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPREAD_BYTES = 1 << 30


def build_session(app: str = "hushmap", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def local_table(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A small fixed table whose size the optimizer knows."""
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in spark.checkpoint.dir. Only a local session falls back to a
    temporary folder, since there driver and executors are one process.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hushmap-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *paths: str) -> DataFrame:
    """Let all cores take part in a scan of files too small for one split each.

    Pattern scans cost far more than reading, so a few small files would keep most cores idle.
    Files of more than SPREAD_BYTES in all, or of at least one split per core, are not moved:
    smaller splits (spark.sql.files.maxPartitionBytes) serve them better.
    """
    spark = df.sparkSession
    split_bytes = _bytes(spark, "spark.sql.files.maxPartitionBytes", "134217728b")
    cores = spark.sparkContext.defaultParallelism
    if sum(stored_bytes(spark, path) for path in paths) >= min(cores * split_bytes, SPREAD_BYTES):
        return df
    return df.repartition(cores)


def stored_bytes(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def _bytes(spark: SparkSession, name: str, default: str) -> int:
    text = spark.conf.get(name, default)
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
