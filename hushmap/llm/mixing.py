"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmap.llm.shared import count_words, if_few, running_totals, stored, unused

#: One expected copy in the whole numbers that are summed.
SHIFT = 24
UNIT = 1 << SHIFT
#: No document is taken more often.
MOST = 3
WEIGHTS = (1, 2, 3)


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, n_docs, target, rate.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all sizes. A
    target stops at ``most`` times its source's size and what it leaves goes to the others by
    weight: all open targets are one level times their weight, so sorting sources by the level at
    which they fill up gives the level by prefix sums. ``rate`` is target by source_size, 0 for a
    source without words.
    """
    totals = stored(
        sizes.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
        )
    ).withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(totals, "_one", [], [F.col("source").asc_nulls_last()], "_at")
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]),
        (F.col("_at") % len(weights) + 1).cast("int"),
    )
    weighed = stored(
        placed.withColumn("_weight", weight).withColumn(
            "_full", F.lit(float(most)) * F.col("source_size") / F.col("_weight")
        )
    )
    order = [F.col("_full"), F.col("_at")]
    filled = running_totals(weighed, "source_size", [], order, "_size_before")
    filled = stored(running_totals(filled, "_weight", [], order, "_weight_before"))
    all_size, all_weight = filled.agg(F.sum("source_size"), F.sum("_weight")).first()
    if all_size is None:
        return filled.select(
            "source", "source_size", "n_docs",
            F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"),
        )
    level = (F.lit(float(all_size)) - F.lit(float(most)) * F.col("_size_before")) / (
        F.lit(float(all_weight)) - F.col("_weight_before")
    )
    # The level is right at the first source that stays below its limit at this level.
    found = filled.where(level <= F.col("_full")).agg(F.min_by(level, F.struct(*["_full", "_at"]))).first()[0]
    target = F.least(
        F.lit(float(most)) * F.col("source_size"), F.lit(float(found or 0.0)) * F.col("_weight")
    )
    return filled.select(
        "source",
        "source_size",
        "n_docs",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size"))
        .otherwise(F.lit(0.0))
        .alias("rate"),
    )


def mix(
    docs: DataFrame,
    seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    text: str = "text",
    key: str = "doc_id",
    row: str | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row of ``docs``.

    ``copies`` says how often the mix takes the row. Each document of a source is expected
    target/size times; the expectations are summed up in order of size, one offset drawn from
    ``seed`` and the source is added, and a document is taken once per whole number that its
    stretch of the sum crosses. The order by size keeps the words taken near the target. Sums are
    whole numbers of 2^-24 copies, so nothing depends on rounding, and no document is taken more
    than ``most`` times. Null and empty texts have size 0. A null source is a source. Rows that
    repeat a document count as documents; rows alike in source, size and key are interchangeable.
    ``row`` names a column that tells all rows apart; it orders these, too, and is added to the
    result. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    own = [] if row is None else [F.col(row).alias("_row")]
    sizes = stored(
        docs.select(
            *own,
            F.col(key).alias("_key"),
            F.col("source").cast("string").alias("source"),
            count_words(F.col(text)).alias("size"),
        )
    )
    rates = stored(targets(sizes, weights, most))
    shares = rates.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.least(F.floor(F.col("rate") * UNIT), F.lit(most * UNIT)).alias("_units"),
    )
    expected = stored(
        sizes.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    )
    order = [F.col("size"), F.col("_key").asc_nulls_last()] + [F.col("_row")] * len(own)
    summed = running_totals(expected, "_units", ["source"], order, "_before")
    offset = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10
    ).cast("long")
    low = F.col("_before") + offset
    copies = F.shiftright(low + F.col("_units"), SHIFT) - F.shiftright(low, SHIFT)
    return summed.select(
        F.col("_key").alias(key), "source", "size", "source_size", "target",
        copies.alias("copies"), *[F.col("_row").alias(row) for _ in own],
    )


def emit(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, each as often as ``mixed`` says for its key.

    A key that ``mixed`` has more than once does not tell which row has which copies, and raises
    ValueError. Tables with null or repeated keys need the ``row`` of ``mix`` as their key here.
    """
    own, n = unused(docs, "_key"), unused(docs, "_copies")
    copies = mixed.groupBy(F.col(key).alias(own)).agg(
        F.sum("copies").cast("int").alias(n), F.count(F.lit(1)).alias("_lines")
    )
    copies = stored(copies.where((F.col(n) > 0) | (F.col("_lines") > 1)))
    if not copies.where("_lines > 1").isEmpty():
        raise ValueError(f"{key} is not unique: mix with a row column")
    taken = if_few(copies.drop("_lines"))
    return (
        docs.join(taken, F.col(key).eqNullSafe(F.col(own)))
        .withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n))))
        .drop(own, n)
    )
