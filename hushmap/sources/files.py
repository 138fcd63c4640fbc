"""File inventory: which files to scan, and what is known about them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import batched

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.functions.scalar import file_extension, source_name, sub_service_name
from hushmap.session import local_table

TABLE_FORMATS = ("csv", "json", "xlsx", "xls")
TEXT_FORMATS = ("txt", "pdf", "docx")
IMAGE_FORMATS = ("jpg", "jpeg", "png")
# Formats that the readers here take; other documents and workbooks come as texts and tables.
READ_AS = {"csv": "table", "json": "table", "txt": "text"}
WILDCARD = re.compile(r"[\\{}\[\]*?]")
NAMES_PER_BATCH = 10_000


def literal_paths(paths: Sequence[str]) -> list[str]:
    """Paths that stand for themselves, also with brackets and stars in them."""
    return [WILDCARD.sub(r"\\\g<0>", path) for path in paths]


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The place of a folder that tasks can open by themselves; None for any other path."""
    if WILDCARD.search(path):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or not fs.exists(folder):
        return None
    status = fs.getFileStatus(folder)
    return status.getPath().toUri().getPath() if status.isDirectory() else None


def mounted_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path): the files in and below a mounted folder that Spark's readers would take.

    Names are bytes. Tasks find them, so that the driver holds none: one goes through the folder
    itself, all share what is below its sub-folders.
    """

    def entries(batches):
        for batch in batches:
            for top in batch.column("path").to_pylist():
                for some in batched(_entries(top), NAMES_PER_BATCH):
                    paths, inside = zip(*some)
                    arrays = [pa.array(paths, pa.binary()), pa.array(inside, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "folder"])

    def below(batches):
        for batch in batches:
            folder = batch.column("folder")
            yield batch.filter(pa.compute.invert(folder)).select(["path"])
            for top in batch.filter(folder).column("path").to_pylist():
                for some in batched(_files_below(top), NAMES_PER_BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["path"])

    top = local_table(spark, [(folder.encode(),)], path=pa.binary())
    found = top.mapInArrow(entries, "path binary, folder boolean")
    return found.repartition(spark.sparkContext.defaultParallelism).mapInArrow(below, "path binary")


def _entries(folder: bytes) -> Iterator[tuple[bytes, bool]]:
    """(path, whether it is a folder) of what Spark's readers do not pass over as hidden."""
    with os.scandir(folder) as found:
        for entry in found:
            name, inside = entry.name, entry.is_dir()
            kept = inside and name.startswith((b"_metadata", b"_common_metadata"))
            hidden = name.startswith(b"_") and b"=" not in name or name.startswith(b".")
            if kept or not (hidden or name.endswith(b"._COPYING_")):
                if inside or entry.is_file():  # not a link that leads nowhere
                    yield entry.path, inside


def _files_below(folder: bytes) -> Iterator[bytes]:
    todo = [folder]
    while todo:
        for path, inside in _entries(todo.pop()):
            if inside:
                todo.append(path)
            else:
                yield path


def list_files(
    spark: SparkSession, path: str, formats: Sequence[str] = TABLE_FORMATS + TEXT_FORMATS
) -> DataFrame:
    """Files below a path (path, file_name, file_size, extension, accepted).

    Contents are not read. Files of other formats are returned as not accepted.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            "path",
            F.substring_index("path", "/", -1).alias("file_name"),
            F.col("length").alias("file_size"),
        )
    )
    extension = file_extension(F.col("file_name"))
    return files.withColumn("extension", extension).withColumn(
        "accepted", extension.isin([f.lower() for f in formats])
    )


def file_metadata(
    files: DataFrame,
    source_type: Column,
    bucket: Column,
    region: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Metadata stored with each scanned file, from ``file_name`` and ``file_size``."""
    return files.select(
        *keep,
        bucket.alias("source_bucket"),
        "file_name",
        F.col("file_size").cast("bigint").alias("file_size"),
        F.upper(F.substring_index("file_name", ".", -1)).alias("file_type"),
        source_name(source_type).alias("source"),
        sub_service_name(source_type).alias("sub_service"),
        region.alias("region"),
    )


def route_files(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``route``: the scan that takes the file by its extension, or 'rejected'."""
    extension = file_extension(F.col(name))
    return files.withColumn(
        "route",
        F.when(~F.col(name).contains("."), F.lit("rejected"))
        .when(extension.isin(*TABLE_FORMATS), F.lit("table"))
        .when(extension.isin(*TEXT_FORMATS), F.lit("text"))
        .when(extension.isin(*IMAGE_FORMATS), F.lit("image"))
        .otherwise(F.lit("rejected")),
    )
