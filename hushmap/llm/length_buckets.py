"""Batches of documents of like length: bucket bounds of least padding, token-budget batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.llm.shared import running_totals, stored

#: Lengths up to this count one by one; beyond, each doubling has this many steps.
FINE = 512


def length_bin(length: Column, fine: int = FINE) -> Column:
    """Least histogram bound that holds the length: exact to ``fine``, then in relative steps.

    This bounds the number of bins by ``fine`` times the doublings of the greatest length,
    whatever the number of documents. ``fine`` is a power of two.
    """
    # Steps are powers of two chosen by the length's own doubling.
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length - 1, F.lit(1)) / F.lit(float(fine)))))
    step = F.greatest(step, F.lit(1.0)).cast("long")
    return F.when(length <= fine, length).otherwise(
        (F.floor((length + step - 1) / step) * step).cast("long")
    )


def best_bounds(bins: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bounds, the last one the greatest bin, for which padding to the next bound is least.

    ``bins`` ascend. best[j] is the least padded volume of the bins up to j; one more bucket adds
    the choice of its first bin. Padded volume minus the fixed sum of lengths is the padding, so
    both are least together. Ties go to fewer buckets, then to the smaller bounds.
    """
    n = len(bins)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = bins * before[1:]
    chosen: list[np.ndarray] = []
    lengths = bins.astype(np.float64)
    for _ in range(min(n_buckets, n) - 1):
        made = np.empty(n)
        came = np.full(n, -1)
        for low in range(0, n, 256):  # rows j, columns i < j: last bucket holds i+1 .. j
            high = min(low + 256, n)
            cost = best[None, : high] + lengths[low:high, None] * (
                before[low + 1 : high + 1, None] - before[None, 1 : high + 1]
            )
            cost[np.arange(high)[None, :] >= np.arange(low, high)[:, None]] = np.inf
            at = cost.argmin(axis=1)
            least = cost[np.arange(high - low), at]
            better = least < best[low:high]
            made[low:high] = np.where(better, least, best[low:high])
            came[low:high] = np.where(better, at, -2)
        chosen.append(came)
        if made[n - 1] >= best[n - 1]:
            chosen.pop()
            break
        best = made
    bounds, j, level = [int(bins[n - 1])], n - 1, len(chosen) - 1
    while level >= 0 and j >= 0:
        i = int(chosen[level][j])
        if i >= 0:
            j = i
            bounds.append(int(bins[j]))
        level -= 1
    return bounds[::-1]


def pack_by_length(
    df: DataFrame,
    length: Column,
    key: str = "doc_id",
    n_buckets: int = 16,
    budget: int = 65_536,
    fine: int = FINE,
) -> DataFrame:
    """One row per row of ``df``: key, n_tokens, bucket, bucket_len, batch, slot.

    ``length`` gives the tokens of a row; null counts as 0. Bucket bounds come from dynamic
    programming over the histogram of all lengths, of which the driver sees at most ``fine`` bins
    per doubling of the greatest length. A batch holds as many rows of one bucket as stay within
    ``budget`` tokens when padded to bucket_len, at least one. Batches are numbered from 0 in
    each bucket, slots from 0 in each batch, in the order of a hash of the key. Rows of length 0
    lie in the first bucket. Rows with equal or null keys are kept, each with a place of its own.
    An empty table gives an empty result.
    """
    sized = stored(
        df.select(
            F.col(key).alias("_key"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens")
        ).withColumns(
            {"_bin": length_bin(F.col("n_tokens"), fine), "_one": F.lit(1).cast("long")}
        )
    )
    histogram = sized.groupBy("_bin").agg(F.sum("_one").alias("n")).orderBy("_bin").toPandas()
    bounds = best_bounds(
        histogram["_bin"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), n_buckets
    ) or [0]
    spark = df.sparkSession
    buckets = []
    at = 0
    for b in histogram["_bin"].tolist():
        while bounds[at] < b:
            at += 1
        buckets.append((b, at, bounds[at], max(1, budget // max(1, bounds[at]))))
    table = spark.createDataFrame(
        pa.table(
            list(map(pa.array, zip(*buckets))) if buckets else [pa.array([], pa.int64())] * 4,
            names=["_bin2", "bucket", "bucket_len", "_rows"],
        )
    )
    # At most ``fine`` rows per doubling of the greatest length, so its size is bounded.
    placed = stored(
        sized.join(F.broadcast(table), F.col("_bin") == F.col("_bin2")).select(
            "_key", "n_tokens", "bucket", "bucket_len", "_rows", "_one",
            F.xxhash64("_key").alias("_order"),
        )
    )
    ranked = running_totals(
        placed, "_one", ["bucket"], [F.col("_order"), F.col("_key").asc_nulls_last()], "_rank"
    )
    return ranked.select(
        F.col("_key").alias(key),
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        "bucket_len",
        F.expr("_rank div _rows").alias("batch"),
        (F.col("_rank") % F.col("_rows")).cast("long").alias("slot"),
    )
