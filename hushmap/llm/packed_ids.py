"""Pack documents' identifiers into rows of fixed length: best fit decreasing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmap.llm.shared import BLANK, Tokenized, text_chunks

WIDTH = np.dtype("<u4")
PAD = 0
#: Identifiers that are packed together; about as many are held by a task at once.
GROUP_TOKENS = 1 << 21
SCHEMA = (
    "row_id long, ids binary, n_tokens int, doc_ids array<bigint>, doc_offsets array<bigint>,"
    " cu_seqlens array<int>, resets array<int>"
)


def hash_ids(batch: pa.Array) -> list[np.ndarray]:
    """Identifiers 1 .. 2^32 - 1 of each text, one per word, by the word's hash."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_chunks(batch):
        found = Tokenized(data, offsets, BLANK)
        ids = (found.hashes() % np.uint64(2**32 - 1) + np.uint64(1)).astype(WIDTH)
        out += [ids[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
    return out


class _Capacities:
    """Rows by free capacity 0 .. size, with a segment tree that finds the least sufficient one.

    Leaf c of the tree says whether a row with c free places is open; an inner node whether any
    leaf below is.
    """

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.any = [False] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = self.half + capacity
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity of at least ``needed``, no longer open."""
        at = self.half + needed
        if not self.any[at]:
            # Up to the first ancestor that has an open right side, then down to its left end.
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.half:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.half
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.any[at] = False
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = False
                at >>= 1
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each 1 .. size), each row of ``size`` places at most.

    The longest come first, ties in the given order; each goes where the least space stays free.
    """
    free = _Capacities(size)
    rows: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found = size, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        if capacity > n:
            free.put(capacity - n, row)
    return rows


def pack_ids(
    docs: DataFrame,
    size: int = 4096,
    encode: Callable[[pa.Array], list[np.ndarray]] = hash_ids,
    text: str = "text",
    key: str = "doc_id",
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Rows of ``size`` identifiers packed from the texts of ``docs``, without a shuffle.

    Documents over ``size`` are cut into pieces of ``size`` and a rest; nothing is lost. Each
    task packs its documents in groups of about ``group_tokens`` tokens, so its memory is bounded
    and the space left free is a few rows per group. Columns: ``ids`` the row's little-endian
    32-bit identifiers, filled up with 0; ``n_tokens`` how many are not filling; per piece
    ``doc_ids`` and ``doc_offsets`` (place of its first token in the document); ``cu_seqlens`` the
    cumulative lengths of pieces, from 0 to n_tokens; ``resets`` the places at which positions
    start again at 0. Pieces stand in order of falling length. Null and empty texts have no
    tokens and no piece. A null key stays null. Rows that repeat a document are packed once each.
    An empty table gives an empty result.
    """
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))

    def packed(batches):
        keys, texts, held, at = [], [], 0, 0

        def flush():
            nonlocal keys, texts, held, at
            pieces = [
                (k, o, ids[o : o + size])
                for k, ids in zip(keys, texts)
                for o in range(0, len(ids), size)
            ]
            rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), size)
            if rows:
                yield _batch(rows, pieces, size, at)
            at += len(rows)
            keys, texts, held = [], [], 0

        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                ids = encode(part.column(1))
                keys += part.column(0).to_pylist()
                texts += ids
                held += sum(map(len, ids))
                if held >= group_tokens:
                    yield from flush()
        yield from flush()

    out = source.mapInArrow(packed, SCHEMA)
    # The number in the task, behind the task's own, makes the row's number unique.
    part = F.spark_partition_id().cast("long")
    return out.withColumn("row_id", F.shiftleft(part, 33) + F.col("row_id"))


def _batch(rows: list[list[int]], pieces: list, size: int, at: int) -> pa.RecordBatch:
    matrix = np.full((len(rows), size), PAD, WIDTH)
    ends = []
    for r, row in enumerate(rows):
        cu = [0]
        for i in row:
            ids = pieces[i][2]
            matrix[r, cu[-1] : cu[-1] + len(ids)] = ids
            cu.append(cu[-1] + len(ids))
        ends.append(cu)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(at, at + len(rows)), pa.int64()),
            pa.array([m.tobytes() for m in matrix], pa.binary()),
            pa.array([cu[-1] for cu in ends], pa.int32()),
            pa.array([[pieces[i][0] for i in row] for row in rows], pa.list_(pa.int64())),
            pa.array([[pieces[i][1] for i in row] for row in rows], pa.list_(pa.int64())),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([cu[:-1] for cu in ends], pa.list_(pa.int32())),
        ],
        ["row_id", "ids", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "resets"],
    )


def positions(cu_seqlens: list[int], size: int) -> np.ndarray:
    """Position of each place of a row within its piece; 0 in the filling."""
    out = np.zeros(size, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
