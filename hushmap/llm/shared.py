"""What several operators of this package need: words, stored steps, prefix sums, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushmap.session import scratch_path

#: A word is a run of characters other than space and the controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that vectorised passes take at once.
CHUNK_BYTES = 1 << 20
#: Rows of numbers that are broadcast to a join; more are shuffled.
MOST_BROADCAST = 500_000


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there.

    This cuts the lineage: a lost executor costs no earlier step, and no step runs twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A stored table of a few narrow columns, to be broadcast if it has at most ``most`` rows;
    otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def running_totals(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    order: Sequence[Column],
    out: str,
    greatest: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of the whole numbers in ``value`` over the rows before this one, or
    with ``greatest`` their maximum (null where there is none).

    Rows count within ``group`` in ``order``. Range partitions are summed on their own and start
    where the partitions before them end, so that a group of any size is spread over many tasks.
    What is moved between partitions is one row per partition and group. ``df`` should be stored
    or cheap: range partitioning reads it once more for a sample. Rows that tie in ``order`` stand
    in any order among themselves. Null is a group of its own.
    """
    keys = [F.col(g).asc_nulls_last() for g in group]
    placed = stored(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    fold = F.max if greatest else F.sum
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        placed.groupBy("_part", *group)
        .agg(fold(value).alias("_fold"))
        .select(
            F.col("_part").alias("_part2"),
            *[F.col(g).alias(f"_{g}2") for g in group],
            fold("_fold").over(before).alias("_start"),
        )
    )
    same = F.col("_part") == F.col("_part2")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}2"))
    within = (
        Window.partitionBy("_part", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start, inner = F.col("_start"), fold(value).over(within)
    total = (
        F.greatest(start, inner)
        if greatest
        else F.coalesce(start, F.lit(0)) + F.coalesce(inner, F.lit(0))
    )
    return (
        placed.join(starts, same, "left")
        .withColumn(out, total)
        .drop("_part", "_part2", "_start", *[f"_{g}2" for g in group])
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: one row (id, component) per id in ``edges``, component the least id.

    Large-star and small-star passes in turn: each node hands its neighbours the least id it
    sees, until the edges are stars. Only minima and equi-joins are shuffled; the neighbours of a
    node are never gathered. Edges with a null end are left out; loops keep their node.
    """
    pairs = stored(
        edges.select(
            F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
        )
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    for _ in range(max_rounds):
        if _stars(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(
            both.groupBy("u").agg(F.min("v").alias("m")).select(
                F.col("u").alias("n"), F.least("u", "m").alias("m")
            )
        )
        large = stored(
            both.join(least, F.col("u") == F.col("n"))
            .where(F.col("v") >= F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        # Now the second ends are least in their neighbourhood, so few of them meet in one node.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(least, F.col("u") == F.col("n"))
        pairs = stored(
            joined.select(
                F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
            )
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")))
        .groupBy("id")
        .agg(F.min("component").alias("component"))
    )


def _stars(pairs: DataFrame) -> bool:
    """Whether every node but the centres has one edge, which leads to a centre."""
    ends = F.array(
        F.struct(F.col("u").alias("id"), (F.col("u") != F.col("v")).cast("int").alias("leaf"), F.lit(0).alias("centre")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")),
    )
    odd = (
        pairs.select(F.explode(ends).alias("e"))
        .select("e.*")
        .groupBy("id")
        .agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        .where((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0)))
    )
    return odd.isEmpty()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a fixed bijection)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Tokenized:
    """Words of several texts in one byte buffer, found and hashed without a loop over words.

    ``start`` and ``end`` are byte places of the words, ``first`` the index of the first word of
    each text (one more entry closes the last). ``part(begin, end)`` hashes byte ranges that lie
    inside words: a polynomial in the bytes, taken from one running sum.
    """

    STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
    _powers: list[np.ndarray] = []

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray):
        """``gap``: for each of the 256 byte values, whether it separates words."""
        inside = ~gap[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        head, tail = inside.copy(), inside.copy()
        if len(data):
            head[1:] &= ~inside[:-1] | fresh[1:-1]
            tail[:-1] &= ~inside[1:] | fresh[1:-1]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.sums: np.ndarray | None = None

    @classmethod
    def powers(cls, n: int) -> list[np.ndarray]:
        if not cls._powers or len(cls._powers[0]) < n:
            back = np.uint64(pow(int(cls.STEP), -1, 1 << 64))
            made = []
            for step in (cls.STEP, back):
                row = np.full(max(n, CHUNK_BYTES + 1), step, np.uint64)
                row[0] = 1
                made.append(np.multiply.accumulate(row))
            if n > 4 * CHUNK_BYTES:  # one very long text: not worth keeping
                return made
            cls._powers = made
        return cls._powers

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(self.data) + 1)
        if self.sums is None:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.data] * up[: len(self.data)], out=sums[1:])
            self.sums = sums
        return mixed((self.sums[end] - self.sums[begin]) * down[begin])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return self.part(self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)
#: Space and the controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(
    texts: pa.Array, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes.

    The bytes are a view of the Arrow buffer; null counts as empty; a longer text is a run of
    its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind, len(texts) + 1, texts.offset * kind().itemsize)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
