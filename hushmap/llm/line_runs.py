"""Line dedup: documents in batches against levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import string
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.llm.shared import stored, unused
from hushmap.session import scratch_path, shared_dir

#: Stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
KEY = ("h1", "h2")
#: A key with more than this share of all lines is joined by itself; there are fewer than 1,000.
HOT_SHARE = 0.001


def line_keys(text: Column, least_chars: int) -> Column:
    """array<struct<pos, h1, h2>> of the lines whose key has ``least_chars`` code points or more.

    The key is the line without blanks at both ends, A-Z lower-cased. Two 64-bit hashes with
    different seeds stand for it.
    """
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(BLANKS)).alias("s")))
    long = F.filter(lines, lambda x: F.length(x["s"]) >= least_chars)
    lowered = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), _lower(x["s"]).alias("s")))
    return F.transform(
        lowered,
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit(1), x["s"]).alias("h2")
        ),
    )


def _lower(s: Column) -> Column:
    """A-Z lower-cased, other letters as they are; without others, the faster function does it."""
    return F.when(F.length(s) == F.octet_length(s), F.lower(s)).otherwise(
        F.translate(s, string.ascii_uppercase, string.ascii_lowercase)
    )


class LineRuns:
    """The keys seen so far with the place of their holder, in sorted runs on several levels.

    A run is a table of (h1, h2, holder) in hash buckets sorted by key; each key is in exactly one
    run. ``add`` drops from a batch what any run holds, by merge joins for which no run is
    shuffled, as the batch is dealt into the same buckets, and writes the rest as a run of level
    0. ``fan_out`` runs of a level are merged into one of the next, so there are few runs however
    many batches came. The tables lie in a database of their own in the shared folder;
    ``close`` drops it.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 3):
        if fan_out < 2:
            raise ValueError("fan_out must be 2 or more")
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self._made = 0
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{shared_dir(spark)}/{self.database}'")

    def add(self, batch: DataFrame) -> None:
        """Add the keys (h1, h2, holder; each once) that no run holds."""
        for level in self.levels:
            for run in level:
                batch = batch.join(self.spark.table(run).select(*KEY), list(KEY), "left_anti")
        self._place(self.write(batch), 0)

    def write(self, rows: DataFrame) -> str:
        """A new table in the buckets of the runs, sorted by key."""
        name = f"{self.database}.t{self._made}"
        self._made += 1
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def read(self) -> DataFrame:
        """All keys with their holders."""
        runs = [self.spark.table(run) for level in self.levels for run in level]
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")

    def _place(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fan_out:
            return
        old = self.levels[level]
        merged = self.spark.table(old[0])
        for other in old[1:]:
            merged = merged.unionByName(self.spark.table(other))
        new = self.write(merged.repartition(self.buckets, *KEY))
        self.levels[level] = []
        self._place(new, level + 1)
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    keep: Sequence[str] = (),
    least_chars: int = 40,
    least_docs: int = 5,
    batches: int = 6,
    fan_out: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``keep``, ``n_lines``, ``n_dropped``, ``kept_text``.

    Lines whose key (``line_keys``) stands in ``least_docs`` rows or more are dropped, except in
    the row with the largest ``key``; the other lines stay, joined by line feeds. Rows are
    documents: rows that share a key value count one each, and the one read last is the largest of
    them; null is smaller than all. A row that holds a line twice counts once, and keeps both as
    the holder. Null and empty texts are one empty line. An empty table gives an empty result.
    Other columns are not read; results whose names are taken get underscores before them.

    ``batches`` ranges of the key, largest first, are added to ``LineRuns`` one after the other,
    so the batch that brings a line in brings its holder. Keys are counted and told apart
    before lines are shuffled, so a line in a third of all documents is one row per task there.
    Only where lines learn their holder they move one by one; the fewer than 1,000 keys with over a
    thousandth of all lines are broadcast to them, the others shuffled.
    """
    spark = docs.sparkSession
    ids = [key, *[k for k in keep if k != key]]
    row, t = "_row", "_text"
    named = {name: f"_{i}_key" for i, name in enumerate(ids)}
    rows = stored(
        docs.select(
            *[F.col(name).alias(alias) for name, alias in named.items()],
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t),
        ).withColumn(row, F.monotonically_increasing_id())
    )
    at = F.col(named[key]).cast("long")
    bounds = _bounds(rows, at, batches)
    digests = _digests(rows, at, bounds, least_chars, scratch_path(spark, "lines"))
    runs = LineRuns(spark, fan_out)
    try:
        drops = stored(_drops(digests, runs, len(bounds) + 1, least_docs))
    finally:
        runs.close()
    return _without(rows, drops).select(
        *[F.col(alias).alias(name) for name, alias in named.items()],
        *[
            F.col(c).alias(unused(docs.select(*ids), c))
            for c in ("n_lines", "n_dropped", "kept_text")
        ],
    )


def _bounds(rows: DataFrame, at: Column, batches: int) -> list[int]:
    """At most ``batches - 1`` values of the key that part the rows about evenly."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx(at, shares, 1_000)).first()[0]
    return sorted(set(found or []))


def _digests(rows: DataFrame, at: Column, bounds: list[int], least_chars: int, path: str) -> DataFrame:
    """(row, place, batch, lines) of rows with long lines, stored by batch.

    ``place`` is unique and ascends with the key: 19 digits of the key, 19 of the row number.
    ``lines`` are sorted by hash, with a mark on the first of equal ones.
    """
    wide = F.coalesce(at.cast("decimal(38,0)"), F.lit("-9300000000000000000").cast("decimal(38,0)"))
    place = (wide * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("_row")).cast("decimal(38,0)")
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + F.coalesce(at < bound, F.lit(True)).cast("int")
    by_hash = F.array_sort(
        F.transform(
            line_keys(F.col("_text"), least_chars),
            lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos")),
        )
    )

    def marked(x: Column, i: Column) -> Column:
        before = F.get("_lines", i - 1)
        again = before["h1"].eqNullSafe(x["h1"]) & before["h2"].eqNullSafe(x["h2"])
        return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~again).alias("first"))

    found = rows.where(F.octet_length("_text") >= least_chars).select(
        "_row", place.alias("place"), batch.alias("batch"), by_hash.alias("_lines")
    )
    marks = found.where(F.size("_lines") > 0).withColumn("lines", F.transform("_lines", marked)).drop("_lines")
    marks.write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(marks.schema).parquet(path)


def _drops(digests: DataFrame, runs: LineRuns, batches: int, least_docs: int) -> DataFrame:
    """(row, positions): places of the lines that a row loses, ascending."""
    spark = digests.sparkSession
    lines = digests.select("_row", "place", "batch", F.inline("lines"))
    counted = lines.groupBy(*KEY).agg(
        F.sum(F.col("first").cast("long")).alias("n"), F.count(F.lit(1)).alias("n_all")
    )
    frequent = spark.table(runs.write(counted.where(F.col("n") >= least_docs)))
    for batch in range(batches):
        keys = lines.where(F.col("batch") == batch).groupBy(*KEY).agg(F.max("place").alias("holder"))
        runs.add(keys.join(frequent.select(*KEY), list(KEY), "left_semi"))
    held = runs.read()
    total = digests.agg(F.sum(F.size("lines"))).first()[0] or 0
    hot = F.broadcast(
        frequent.where(F.col("n_all") > HOT_SHARE * total).join(held, list(KEY)).select(*KEY, "holder")
    )
    many = lines.join(hot, list(KEY))
    few = lines.join(hot.select(*KEY), list(KEY), "left_anti").join(held, list(KEY))
    return (
        many.select("_row", "place", "pos", "holder")
        .unionByName(few.select("_row", "place", "pos", "holder"))
        .where("place <> holder")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    )


def _without(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """The rows with ``n_lines``, ``n_dropped`` and ``kept_text``.

    What stays is put together from the stretches between dropped lines, so the work is linear in
    the lines of a text. Texts are shuffled to their places once, at every size, and not sorted:
    a partition's places are a small part of its texts.
    """
    t, at = F.col("_text"), F.col("positions")
    n_lines = (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).cast("long")
    dropped = F.coalesce(F.size(at), F.lit(0)).cast("long")

    def stretch(end: Column, k: Column) -> Column:
        begin = F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
        return F.slice(F.col("_split"), begin + 1, end - begin)

    joined = (
        rows.join(
            drops.withColumnRenamed("_row", "_dropped").hint("shuffle_hash"),
            F.col("_row") == F.col("_dropped"),
            "left",
        )
        .withColumn("n_lines", n_lines)
        .withColumn("n_dropped", F.when(at.isNull(), F.lit(0).cast("long")).otherwise(dropped))
        .withColumn("_split", F.when(at.isNotNull(), F.split(t, "\n")))
        .withColumn("_ends", F.concat(at, F.array(F.size("_split"))))
    )
    kept = F.array_join(F.flatten(F.transform("_ends", stretch)), "\n")
    return joined.withColumn("kept_text", F.when(at.isNull(), t).otherwise(kept))
