"""Token counts of documents in flat token files, found by scanning for separators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.llm.shared import BLANK, Tokenized, running_totals, stored, text_chunks

#: Identifier that ends a document, and the width of all identifiers.
END = 0
WIDTH = np.dtype("<u2")
BLOCK_BYTES = 4 << 20


def hash_ids(batch: pa.Array, space: int = 65_535) -> pa.Array:
    """Texts to bytes of identifiers 1 .. ``space``, one per word, by the word's hash."""
    out = []
    for _, _, data, offsets in text_chunks(batch):
        found = Tokenized(data, offsets, BLANK)
        ids = (found.hashes() % np.uint64(space) + np.uint64(1)).astype(WIDTH)
        out += [ids[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
    return pa.array(out, pa.binary())


def write_token_files(
    docs: DataFrame,
    path: str,
    encode: Callable[[pa.Array], pa.Array] = hash_ids,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Write flat token files below ``path``; return (file_no, ordinal, key) of each document.

    A file is nothing but little-endian identifiers, each document closed by the end identifier
    0, which ``encode`` (Arrow texts to Arrow bytes) never gives. Spark's text writer lays the
    bytes down, one file per task, with the end identifier as its line separator, so that task
    retries commit whole files on any store. Null and empty texts are documents without tokens.
    ``docs`` must be a stored table: it is read a second time, in the same order, for the keys.
    """

    def encoded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([encode(batch.column(0))], ["ids"])

    ids = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(encoded, "ids binary")
    ids.select(F.col("ids").cast("string")).write.option(
        "lineSep", bytes(WIDTH.itemsize).decode()
    ).text(path)
    at = F.monotonically_increasing_id()
    return docs.select(
        F.shiftright(at, 33).cast("int").alias("file_no"),
        at.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"),
        F.col(key).alias(key),
    )


def read_block(path: str, offset: int, length: int) -> bytes:
    """Bytes of a file on any store that pyarrow knows by its address."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as file:
        return file.read_at(length, offset)


def scan_token_files(
    spark: SparkSession,
    path: str,
    end: int = END,
    width: np.dtype = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    pattern: str = "*.txt",
) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in flat files below ``path``.

    Files are cut into blocks of ``block_bytes``, a multiple of the width, without regard to
    documents. Each block is searched for ``end`` in one vectorised comparison. A document that
    began in an earlier block is stitched by prefix scans over block summaries: the number of
    documents ended before the block, and how many tokens stand open when it begins. Tokens
    behind the last separator of a file are a document with ``ended`` false. Empty files have
    no documents. File sizes are not bounded; a task holds one block. The addresses must be of a
    store that pyarrow opens (local or shared folders, HDFS, object stores).
    """
    step = width.itemsize
    if block_bytes % step:
        raise ValueError("block_bytes must be a multiple of the width")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(F.col("path").alias("file"), "length")
        .where(F.col("length") > 0)
    )
    blocks = files.select(
        "file",
        "length",
        F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block_bytes))).alias("offset"),
    ).repartition("file", "offset")

    def search(batches):
        for batch in batches:
            for file, length, offset in zip(*(c.to_pylist() for c in batch.columns[:3])):
                size = min(block_bytes, length - offset)
                tokens = np.frombuffer(read_block(file, offset, size - size % step), width)
                found = np.flatnonzero(tokens == end).astype(np.int64) + offset // step
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([offset], pa.int64()),
                        pa.array([length // step], pa.int64()),
                        pa.array([len(found)], pa.int64()),
                        pa.array([found], pa.list_(pa.int64())),
                    ],
                    ["file", "offset", "tokens", "n", "ends"],
                )

    found = stored(
        blocks.mapInArrow(
            search, "file string, offset long, tokens long, n long, ends array<bigint>"
        )
    )
    # The open document of a block begins behind the last separator of the blocks before it: the
    # sum of how far each block with separators moves that place.
    moved = _last_places(found.select("file", "offset", "n", F.try_element_at("ends", F.lit(-1)).alias("last")))
    placed = found.join(moved, ["file", "offset"])
    # Each document begins behind the end of the one before it, the first of a block at _open.
    begins = F.concat(
        F.array(F.col("_open")),
        F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1),
    )
    closed = (
        placed.where("n > 0")
        .select("file", "_done", F.posexplode(F.arrays_zip(begins.alias("start"), F.col("ends").alias("stop"))).alias("i", "d"))
        .select(
            "file",
            (F.col("_done") + F.col("i")).alias("ordinal"),
            F.col("d.start").alias("start"),
            (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
            F.lit(True).alias("ended"),
        )
    )
    last = placed.groupBy("file").agg(
        F.sum("n").alias("ordinal"),
        F.max(F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0))).alias("start"),
        F.max("tokens").alias("tokens"),
    )
    rest = last.where(F.col("start") < F.col("tokens")).select(
        "file",
        "ordinal",
        "start",
        (F.col("tokens") - F.col("start")).alias("n_tokens"),
        F.lit(False).alias("ended"),
    )
    return closed.unionByName(rest)


def _last_places(blocks: DataFrame) -> DataFrame:
    """Per block: documents ended before it (_done) and the place behind the last end (_open)."""
    order = [F.col("offset")]
    done = stored(running_totals(blocks, "n", ["file"], order, "_done"))
    return running_totals(done, "last", ["file"], order, "_last", greatest=True).select(
        "file", "offset", "_done", F.coalesce(F.col("_last") + 1, F.lit(0)).alias("_open")
    )


def token_counts(
    docs: DataFrame,
    path: str,
    encode: Callable[[pa.Array], pa.Array] = hash_ids,
    text: str = "text",
    key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, n_tokens) per row of ``docs``, counted in the token files written for them.

    Every row gets its count, also repeated rows and rows with a null key. Raises if the files
    and the keys do not agree in number. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = stored(write_token_files(docs, path, encode, text, key))
    scanned = stored(
        scan_token_files(spark, path, block_bytes=block_bytes).select(
            F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no"),
            "ordinal",
            "n_tokens",
        )
    )
    if keys.count() != scanned.count():
        raise RuntimeError("token files and keys differ in the number of documents")
    return keys.join(scanned, ["file_no", "ordinal"]).select(key, "n_tokens")
