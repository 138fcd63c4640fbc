"""Incremental passes: scan each new document once, upsert each new catalog batch once.

What was processed is remembered by the stream's checkpoint. Output is keyed by the stream, whose
id lies in the checkpoint, and by the batch: a batch that is run again after a failure replaces
what it wrote itself, and nothing else.

Scans keep a status per file. A file that cannot be read or scanned holds up no other: it is
listed with its error and tried again by the next passes, a few times, then left in quarantine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hushmap.plans.jobs import FILE_COLUMNS, scan_documents, scan_files
from hushmap.rules import TEXT_RULES, Ruleset
from hushmap.sources.catalog import UploadedRows
from hushmap.sources.files import file_metadata, literal_paths

MAX_FILES = 1_000
MAX_ATTEMPTS = 5
# Beside the results; Spark's readers of the results pass over names that begin like this.
FILES, REJECTED = "_files", "_rejected"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
STATUS = "path string, modified timestamp, status string, attempt int, error string"
ERROR_CHARS = 500

#: From the paths of files to result rows and rejected rows (or none).
Scan = Callable[[SparkSession, list[str]], tuple[DataFrame, DataFrame | None]]


def stream_scan(
    spark: SparkSession,
    path: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    lookup: DataFrame,
    col: str = "text",
    keys: Sequence[str] = FILE_COLUMNS,
    rules: Ruleset = TEXT_RULES,
    max_files: int = MAX_FILES,
    max_attempts: int = MAX_ATTEMPTS,
) -> StreamingQuery:
    """Scan the document rows that arrived below ``path`` since the last pass, then stop.

    Files whose rows cannot be read are listed by ``file_status`` and tried again.
    """

    def scan(session: SparkSession, paths: list[str]) -> tuple[DataFrame, None]:
        rows = session.read.schema(schema).parquet(*literal_paths(paths))
        return scan_documents(rows, lookup, col, keys, rules), None

    return _scan_arrived(spark, path, False, scan, out, checkpoint, max_files, max_attempts)


def stream_scan_files(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    lookup: DataFrame,
    source_type: str,
    bucket: str,
    region: str,
    max_files: int = MAX_FILES,
    max_attempts: int = MAX_ATTEMPTS,
) -> StreamingQuery:
    """Scan the files of any format that arrived below ``path`` since the last pass, then stop.

    Texts and tables are read once and go to the scan of their route. Result rows lie in ``out``;
    ``rejected_files`` reads files of other formats and broken records of tables. A file that is
    no UTF-8 text fails; ``file_status`` lists it.
    """

    def scan(session: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
        files = session.read.format("binaryFile").load(literal_paths(paths))
        text = F.col("content").cast("string")
        readable = F.lower("path").rlike(r"\.(txt|csv|json)$")
        checked = F.when(F.is_valid_utf8(text), text).otherwise(
            F.raise_error(F.concat(F.lit("no UTF-8 text: "), F.col("path"))).cast("string")
        )
        named = files.select(
            "path",
            F.substring_index("path", "/", -1).alias("file_name"),
            F.col("length").alias("file_size"),
            F.when(readable, checked).alias("text"),
        )
        found = file_metadata(
            named, F.lit(source_type), F.lit(bucket), F.lit(region), keep=["path", "text"]
        )
        # Files of one name in different folders are told apart by their paths.
        results, rejected = scan_files(found, lookup, keys=["path", *FILE_COLUMNS])
        return results.drop("path"), rejected

    return _scan_arrived(spark, path, True, scan, out, checkpoint, max_files, max_attempts)


def file_status(spark: SparkSession, out: str) -> DataFrame:
    """Files (path, modified, status, attempt, error) that scans into ``out`` took, at their last attempt.

    ``status`` is 'done', 'failed' (the next pass tries again) or 'quarantined'.
    """
    last = F.max_by(F.struct("modified", "status", "attempt", "error"), "attempt").alias("last")
    return _statuses(spark, out).groupBy("path").agg(last).select("path", "last.*")


def rejected_files(spark: SparkSession, out: str) -> DataFrame:
    """Files of formats that no reader takes, and broken records, met by scans into ``out``."""
    return spark.read.parquet(f"{out}/{REJECTED}").drop("stream", "batch")


def _statuses(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{STATUS}, stream string, batch long").parquet(f"{out}/{FILES}")


def _scan_arrived(
    spark: SparkSession,
    path: str,
    nested: bool,
    scan: Scan,
    out: str,
    checkpoint: str,
    max_files: int,
    max_attempts: int,
) -> StreamingQuery:
    """Take the files that failed before once more, then those that arrived.

    The stream lists files only; their contents are read by ``scan``, so that one of them cannot
    fail the batch. A driver holds the paths of one batch.
    """
    if _has_files(spark, f"{out}/{FILES}"):
        _retry(spark, scan, out, checkpoint, max_files, max_attempts)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        files = batch.select("path", F.col("modificationTime").alias("modified"))
        stream = _stream_id(session, checkpoint)
        if _has_files(session, f"{out}/{FILES}"):
            # A batch that is run again leaves files to a later attempt that took them.
            later = _statuses(session, out).where((F.col("stream") == stream) & (F.col("batch") < 0))
            files = files.join(later.select("path").distinct(), "path", "left_anti")
        taken = [(r.path, r.modified, 1) for r in files.collect()]
        _take(session, scan, taken, out, stream, batch_id, max_attempts)

    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files)
    if nested:
        reader = reader.option("recursiveFileLookup", True)
    return _start(reader.load(path).select("path", "modificationTime"), write, checkpoint)


def _retry(
    spark: SparkSession, scan: Scan, out: str, checkpoint: str, max_files: int, max_attempts: int
) -> None:
    """Take the failed files of this stream again; batches of such attempts count down from -1."""
    if not _has_files(spark, f"{checkpoint}/metadata"):
        return
    stream = _stream_id(spark, checkpoint)
    mine = _statuses(spark, out).where(F.col("stream") == stream)
    last = F.max_by(F.struct("modified", "status", "attempt"), "attempt").alias("last")
    failed = mine.groupBy("path").agg(last).select("path", "last.*").where("status = 'failed'")
    batch = min(mine.agg(F.min("batch")).first()[0] or 0, 0) - 1
    found = failed.orderBy("attempt", "path").limit(max_files).collect()
    if found:
        taken = [(r.path, r.modified, r.attempt + 1) for r in found]
        _take(spark, scan, taken, out, stream, batch, max_attempts)


def _take(
    spark: SparkSession,
    scan: Scan,
    files: list[tuple],
    out: str,
    stream: str,
    batch: int,
    max_attempts: int,
) -> None:
    """Scan files (path, modified, attempt); write results, rejected rows and, last, their status.

    All three replace what an earlier run of this batch wrote. The common case is one job over
    all files. Only if that fails, halves of the files are tried without writing, until the files
    that fail by themselves are found; the others are then written in one job.
    """
    place = f"stream={stream}/batch={batch}"

    def write(paths: list[str]) -> None:
        results, rejected = scan(spark, paths)
        results.write.mode("overwrite").parquet(f"{out}/{place}")
        if rejected is not None:
            rejected.write.mode("overwrite").parquet(f"{out}/{REJECTED}/{place}")

    errors: dict[str, str] = {}
    paths = [path for path, _, _ in files]
    if not paths:
        return
    try:
        write(paths)
    except Exception as error:  # noqa: BLE001
        errors = _failing(spark, scan, paths, error)
        good = [path for path in paths if path not in errors]
        if good:
            write(good)
    status = [
        (
            path,
            modified,
            "done" if path not in errors else "failed" if attempt < max_attempts else "quarantined",
            attempt,
            errors.get(path),
        )
        for path, modified, attempt in files
    ]
    rows = spark.createDataFrame(status, STATUS).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{out}/{FILES}/{place}")


def _failing(spark: SparkSession, scan: Scan, paths: list[str], error: Exception) -> dict[str, str]:
    """The files of ``paths``, which failed together, that fail by themselves, and their errors."""
    if len(paths) == 1:
        return {paths[0]: _shown(error)}
    errors: dict[str, str] = {}
    half = len(paths) // 2
    for part in (paths[:half], paths[half:]):
        try:
            for rows in scan(spark, part):
                if rows is not None:
                    rows.write.format("noop").mode("overwrite").save()
        except Exception as inner:  # noqa: BLE001
            errors |= _failing(spark, scan, part, inner)
    return errors


def _shown(error: Exception) -> str:
    text = error.getCondition() if isinstance(error, PySparkException) else None
    return f"{text or type(error).__name__}: {error}"[:ERROR_CHARS]


def _has_files(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id that a stream keeps in its checkpoint from its first start on."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def _start(
    arrived: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Take what has arrived in batches of files, then stop."""
    return (
        arrived.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_upsert(
    spark: SparkSession,
    path: str,
    schema: StructType,
    target: str,
    key: str,
    checkpoint: str,
    max_files: int = MAX_FILES,
    upload: Column | None = None,
) -> StreamingQuery:
    """Upsert the catalog rows that arrived below ``path`` since the last pass, then stop.

    The upload is the unit of replacement, however many files and triggers it takes: its rows
    replace rows of earlier uploads and of the stored table with the same key, and never each
    other. ``upload`` tells a row's upload, by default the folder of its file below ``path``;
    files that lie in ``path`` itself are one upload per pass. Uploads count in the order in which
    they arrived: by batch, in a batch by the time their first file was written.
    """
    rows = UploadedRows(spark, target, key)
    here = f"pass-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = f"{_stream_id(batch.sparkSession, checkpoint)}/{batch_id}"
        UploadedRows(batch.sparkSession, target, key).merge(batch, writer)

    if upload is None:
        root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath()
        folder = F.regexp_extract(F.col("_metadata.file_path"), "^(?:[^:/]+:(?://[^/]*)?)?(.*)/[^/]+$", 1)
        upload = F.when(folder.endswith(root), here).otherwise(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    arrived = reader.option("recursiveFileLookup", True).parquet(path)
    placed = arrived.withColumns(
        {
            rows.UPLOAD: upload,
            rows.WRITTEN: F.col("_metadata.file_modification_time").cast("double"),
        }
    )
    return _start(placed, write, checkpoint)

