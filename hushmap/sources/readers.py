"""Read uploaded tables, records and texts."""

from __future__ import annotations

import bz2
import gzip
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.operators.prepare import quoted
from hushmap.sources.files import literal_paths, mounted_files, mounted_folder

CATALOG_SEPARATOR = ";"
DELIMITERS = (",", ";", "\t", "|")
PREVIEW_LINES = 20
#: Bytes at the start of a file that tell its form.
HEAD_BYTES = 65_536
QUOTED = re.compile(r'"(?:[^"]|"")*"')
#: What tasks read of the texts in a mounted folder, at most: files each, files and bytes at once.
FILES_PER_TASK, BATCH_FILES, BATCH_BYTES = 2_000, 1_000, 1 << 23
OPENERS = {".gz": gzip.open, ".gzip": gzip.open, ".bz2": bz2.open}
#: Characters that stand as %XX in the addresses of Java.
UNSAFE = re.compile(
    r"[^!$&'()*+,\-./0-9:;=@A-Z_a-z~\u00a1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def read_catalog_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    sep: str = CATALOG_SEPARATOR,
    multi_line: bool = True,
) -> DataFrame:
    """Catalog export with header; a schema saves the pass that infers one.

    Quoted values may hold line breaks. ``multi_line=False`` lets large files without such breaks
    be split between tasks; this holds for all CSV readers here.
    """
    reader = _csv(spark, multi_line).option("sep", sep)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_csv_auto(
    spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True
) -> DataFrame:
    """CSV files whose delimiters and headers are told from their first lines, each by its own.

    Files of one delimiter and header are read together; the readers are united by column name,
    and a file without a column has nulls there. Columns whose types differ between readers are
    strings, unless all are numbers.
    """
    parts = []
    for sep, files in _dialects(spark, path):
        reader = _csv(spark, multi_line).option("sep", sep).option("inferSchema", infer)
        parts.append(reader.csv(literal_paths(files)))
    if not parts:
        return _csv(spark, multi_line).option("inferSchema", infer).csv(path)
    return _united(parts)


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    kinds: dict[str, set[T.DataType]] = {}
    for field in (f for part in parts for f in part.schema.fields):
        kinds.setdefault(field.name, set()).add(field.dataType)
    mixed = {
        name
        for name, types in kinds.items()
        if len(types) > 1 and not all(isinstance(t, T.NumericType) for t in types)
    }
    same = [
        part.withColumns({n: F.col(quoted(n)).cast("string") for n in part.columns if n in mixed})
        for part in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def _dialects(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(delimiter, files) of each delimiter and header; one address per file is on the driver."""

    def told(batches):
        for batch in batches:
            heads = [
                head.rsplit("\n", 1)[0] if length > HEAD_BYTES else head
                for head, length in zip(batch.column("head").to_pylist(), batch.column("length").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"),
                    pa.array([_delimiter(head) for head in heads], pa.string()),
                    pa.array([head.lstrip("\ufeff").split("\n", 1)[0].rstrip("\r") for head in heads], pa.string()),
                ],
                ["path", "sep", "header"],
            )

    heads = file_heads(spark, path).where("length > 0")
    found: dict[tuple[str, str], list[str]] = {}
    for row in heads.mapInArrow(told, "path string, sep string, header string").sort("path").collect():
        found.setdefault((row.sep, row.header), []).append(row.path)
    return [(sep, files) for (sep, _), files in found.items()]


def file_heads(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> DataFrame:
    """(path, length, head): the first ``size`` bytes of each file as text, read in tasks.

    Files in stores that these tasks cannot open by themselves are read whole by Spark, and cut.
    """
    listed = spark.read.format("binaryFile").load(path)

    def opened(batches):
        for batch in batches:
            heads = [_head(p, size) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.binary())], ["path", "length", "head"]
            )

    near = listed.select("path", "length").mapInArrow(opened, "path string, length long, head binary")
    far = [r.path for r in near.where("head IS NULL").select("path").collect()]
    heads = near.where("head IS NOT NULL")
    if far:
        whole = spark.read.format("binaryFile").load(literal_paths(far))
        heads = heads.unionByName(whole.select("path", "length", F.substring("content", 1, size).alias("head")))
    return heads.withColumn("head", F.make_valid_utf8(F.col("head").cast("string")))


def _head(path: str, size: int) -> bytes | None:
    try:
        store, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
        with store.open_input_stream(name) as stream:
            return stream.read(size)
    except (OSError, pa.ArrowException, ValueError):
        return None


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter that occurs equally often, and most often, in the first lines.

    What stands in quotes, line breaks included, does not count.
    """
    rows = spark.read.text(path).limit(PREVIEW_LINES).collect()
    return _delimiter("\n".join(row.value for row in rows))


def _delimiter(head: str) -> str:
    first = "\n".join(head.replace("\r\n", "\n").split("\n")[:PREVIEW_LINES])
    bare = QUOTED.sub("", first)
    # A value whose closing quote lies behind the preview takes its record's rest along.
    lines = bare.split('"')[0].split("\n")
    lines = lines[:-1] if '"' in bare else lines

    def rank(delimiter: str) -> tuple[bool, int]:
        counts = [line.count(delimiter) for line in lines if line]
        even = bool(counts) and min(counts) == max(counts) > 0
        return even, counts[0] if counts else 0

    return max(DELIMITERS, key=rank)


def read_csv_strings(
    spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    reader = _csv(spark, multi_line).option("sep", sep)
    return reader.option("inferSchema", False).csv(path)


def _csv(spark: SparkSession, multi_line: bool):
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line)


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Records from JSON lines, JSON arrays and single objects, nested as they are.

    Each file is read in its own form, which the first line of its head that is not blank tells:
    JSON lines begin with a whole object, arrays and indented objects do not.
    """
    line = F.regexp_extract("head", r"^\ufeff?\s*+([^\n]*+)", 1)
    # An object on a line longer than the head has no line feed there.
    cut = (F.col("length") > HEAD_BYTES) & ~F.ltrim("head").contains("\n")
    by_lines = line.startswith("{") & (cut | F.get_json_object(line, "$").isNotNull())
    forms = (
        file_heads(spark, path)
        .select(F.col("path").alias("file"), F.coalesce(by_lines, F.lit(False)).alias("lines"), "head")
        .where(F.trim("head") != "")
        .select("file", "lines")
        .sort("file")
        .collect()
    )
    parts = []
    for by_line in (True, False):
        # One address per file, as Spark's own reader keeps on the driver.
        files = [r.file for r in forms if r.lines == by_line]
        if files:
            reader = spark.read.option("multiLine", not by_line)
            parts.append((reader.schema(schema) if schema else reader).json(literal_paths(files)))
    if not parts:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_text_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Whole files as rows (path, file_name, size, text).

    Spark keeps every file that it lists on the driver. So files below a mounted folder are found
    and read by tasks, except those of rare compressions. Single files, paths with wildcards, other
    stores and folders read without their sub-folders are left to Spark.
    """
    folder = mounted_folder(spark, path) if recursive else None
    if folder is None:
        return _listed_texts(spark, path, recursive)
    files = mounted_files(spark, folder)
    name = F.col("path").cast("string")
    packed = F.lower(F.regexp_extract(name, r"\.[^./]*$", 0)).isin(_packed_endings(spark))
    told = files.agg(
        F.count("*").alias("files"), F.collect_list(F.when(packed, name)).alias("packed")
    ).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-told.files // FILES_PER_TASK))
    texts = _mounted_texts(files.where(~packed).repartition(tasks))
    if not told.packed:
        return texts
    return texts.unionByName(_listed_texts(spark, literal_paths(told.packed), recursive))


def _packed_endings(spark: SparkSession) -> list[str]:
    """Endings of the compressed files that only Spark unpacks."""
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(
        spark._jsc.hadoopConfiguration()
    )
    known = {codec.newInstance().getDefaultExtension().lower() for codec in codecs}
    return sorted((known | {".zst", ".zstd"}) - set(OPENERS))


def _listed_texts(spark: SparkSession, path: str | list[str], recursive: bool) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("text"),
    )


def _mounted_texts(files: DataFrame) -> DataFrame:
    """The rows that Spark's reader makes of files; it takes no empty ones."""
    conf = files.sparkSession.conf
    skip_missing = conf.get("spark.sql.files.ignoreMissingFiles") == "true"
    skip_corrupt = conf.get("spark.sql.files.ignoreCorruptFiles") == "true"

    def read(paths: Iterator[bytes]) -> Iterator[tuple[str, int, bytes]]:
        for path in paths:
            try:
                size = os.stat(path).st_size
                if not size:
                    continue
                with _opener(path)(path, "rb") as file:
                    text = file.read()
            except FileNotFoundError:
                if not skip_missing:
                    raise
            except (OSError, EOFError, zlib.error):
                if not skip_corrupt:
                    raise
            else:
                yield _address(path), size, text

    def batch_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary())
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["path", "file_size", "text"])

    def opened(batches):
        rows, held = [], 0
        for row in read(path for batch in batches for path in batch.column("path").to_pylist()):
            rows.append(row)
            held += len(row[2])
            if held > BATCH_BYTES or len(rows) == BATCH_FILES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(opened, "path string, file_size long, text binary").select(
        "path",
        F.substring_index("path", "/", -1).alias("file_name"),
        "file_size",
        F.col("text").cast("string").alias("text"),
    )


def _opener(path: bytes):
    return OPENERS.get(os.path.splitext(path)[1].lower().decode(errors="replace"), open)


def _address(path: bytes) -> str:
    """The path as Spark shows it."""
    return "file:" + UNSAFE.sub(lambda found: quote(found[0], safe=""), path.decode(errors="replace"))
