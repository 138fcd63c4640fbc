"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    max_chars: int,
    text: str = "text",
    key: str = "doc_id",
) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` documents of each class that are not held out.

    Documents with the least hash of their id are taken, so reruns agree; documents labelled both
    ways, null labels and texts over ``max_chars`` characters are no training rows. The driver
    gets at most 2 * ``per_class`` * ``max_chars`` characters.
    """
    agreed = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
        .where(F.col("_label") == F.col("_most"))
        .select("_key", "_label", F.xxhash64("_key").alias("_order"))
    )
    taken = [
        agreed.where(F.col("_label") == c).orderBy("_order", "_key").limit(per_class)
        for c in (0, 1)
    ]
    # At most 2 * per_class rows, so their size is bounded.
    rows = (
        docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
        .join(F.broadcast(taken[0].unionByName(taken[1])), F.col("_doc") == F.col("_key"))
        .where(F.length("_text") <= max_chars)
        .groupBy("_key")
        .agg(F.min("_text").alias("t"), F.min("_label").alias("y"))
        .collect()
    )
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: r["_key"])]
