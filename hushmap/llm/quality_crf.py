"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from hushmap.llm.shared import BLANK, Tokenized, text_chunks
from hushmap.llm.training import held_out, labelled_sample

#: Documents of each class that the model is trained on, and the longest taken.
TRAIN_PER_CLASS = 1_500
TRAIN_MAX_CHARS = 20_000
PREDICT_FROM = 0.3

_CLASS = np.zeros(256, np.uint8)  # 0: letters and all bytes of other scripts
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"!")] = 3
_CLASS[list(b"#*$%&")] = 4
_CLASS[list(b"|<>")] = 7
_CLASS[list(b".,;:?")] = 5
_CLASS[list(b"\"'()+-/=@[\\]^_`{}~")] = 6


def line_features(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line that has a word, bytes of the line, first line of each text)."""
    found = Tokenized(data, offsets, BLANK)
    breaks = np.flatnonzero(data == 10) + 1
    start = np.unique(np.concatenate([offsets[:-1], breaks]))
    start = start[start < len(data)]
    first = np.searchsorted(found.start, start)
    count = np.diff(np.append(first, len(found.start)))
    end = np.append(start[1:], len(data))
    keep = count > 0
    start, end, first, count = start[keep], end[keep], first[keep], count[keep]
    columns = [np.log1p(count)]
    size = (end - start).astype(np.float64)
    kinds = _CLASS[data]
    for k in range(1, 8):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == k, out=sums[1:])
        # The root keeps small shares apart from none.
        columns.append(np.sqrt((sums[end] - sums[start]) / (size if k < 3 else count)))
    hashes = found.hashes()
    same = np.zeros(len(hashes) + 1, np.int32)
    np.cumsum(hashes[1:] == hashes[:-1], out=same[2:] if len(hashes) > 1 else same[:0])
    # same[i]: words before i that equal the word before them; a line's first word is left out.
    columns.append(np.sqrt((same[first + count] - same[first + 1]) / count))
    letters = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(found.end - found.start, out=letters[1:])
    mean = (letters[first + count] - letters[first]) / count
    columns += [np.log(mean), np.abs(np.log(mean / 5.0))]
    return np.stack(columns, 1), size, np.searchsorted(start, offsets)


def with_neighbours(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines beside it in its text, and whether there are any."""
    n = len(base)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    some = np.diff(first) > 0
    opens[first[:-1][some]] = True
    closes[first[1:][some] - 1] = True
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[opens] = 0
    after[closes] = 0
    flags = np.stack([opens, closes, np.ones(n)], 1)
    return np.concatenate([base, before, after, flags], 1)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # features: log-odds of good against bad
    moves: np.ndarray  # 2 x 2: from state, to state
    prior: float  # score of texts without words

    def inputs(self, base: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((base - self.mean) / self.spread, -6, 6), first)


def forward_backward(
    odds: np.ndarray, first: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward log sums, both lines x 2; unary scores; log total of each line's text).

    All texts advance together, line by line; those with fewer lines drop out.
    """
    counts = np.diff(first)
    unary = np.stack([np.zeros_like(odds), odds], 1)
    forward, backward = unary.copy(), np.zeros_like(unary)
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    starts = first[:-1][order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # texts with over t lines
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        prior = forward[at - 1]
        for s in (0, 1):
            forward[at, s] += np.logaddexp(prior[:, 0] + moves[0, s], prior[:, 1] + moves[1, s])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        later = backward[at + 1] + unary[at + 1]
        for s in (0, 1):
            backward[at, s] = np.logaddexp(later[:, 0] + moves[s, 0], later[:, 1] + moves[s, 1])
    total = np.logaddexp(forward[:, 0] + backward[:, 0], forward[:, 1] + backward[:, 1])
    return forward, backward, unary, total


def train(sample: list[tuple[str, int]], steps: int = 120, decay: float = 1e-3) -> Model | None:
    """Fit by gradient ascent (Adam) on the conditional likelihood of the lines' labels.

    Each line has its document's label. None if a class is missing.
    """
    labels = np.array([y for _, y in sample])
    if not len(labels) or labels.min() == labels.max():
        return None
    bases, firsts, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_chunks(pa.array([t for t, _ in sample], pa.string())):
        base, _, first = line_features(data, offsets)
        bases.append(base)
        firsts.append(first[1:] + at)
        at += len(base)
    base, first = np.concatenate(bases), np.concatenate(firsts)
    model = Model(base.mean(0), base.std(0) + 1e-6, np.zeros(0), np.zeros((2, 2)), labels.mean())
    x = model.inputs(base, first)
    counts = np.diff(first)
    y = np.repeat(labels, counts)
    joined = np.ones(len(y), bool)  # lines that have a line of their text before them
    joined[first[:-1][counts > 0]] = False
    to = np.flatnonzero(joined)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    # Every text counts alike, whatever its number of lines.
    weight = np.repeat(1.0 / np.maximum(counts, 1), counts)
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (y[to - 1], y[to]), weight[to])
    model.weights = np.zeros(x.shape[1])
    first_moment = [np.zeros_like(model.weights), np.zeros((2, 2))]
    second_moment = [np.zeros_like(model.weights), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        forward, backward, unary, total = forward_backward(x @ model.weights, first, model.moves)
        good = np.exp(forward[:, 1] + backward[:, 1] - total)
        pair = np.empty((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                score = forward[to - 1, a] + model.moves[a, b] + unary[to, b] + backward[to, b]
                pair[a, b] = (weight[to] * np.exp(score - total[to])).sum()
        slopes = [
            (x.T @ (weight * (y - good))) / len(sample) - decay * model.weights,
            (wanted - pair) / len(sample) - 10 * decay * model.moves,
        ]
        for i, (value, slope) in enumerate(zip([model.weights, model.moves], slopes)):
            first_moment[i] = 0.9 * first_moment[i] + 0.1 * slope
            second_moment[i] = 0.99 * second_moment[i] + 0.01 * slope**2
            value += (
                0.08 * (first_moment[i] / (1 - 0.9**step))
                / (np.sqrt(second_moment[i] / (1 - 0.99**step)) + 1e-8)
            )
    return model


def line_marginals(model: Model, data: np.ndarray, offsets: np.ndarray):
    """(probability of good for each line with a word, its bytes, first line of each text)."""
    base, size, first = line_features(data, offsets)
    forward, backward, _, total = forward_backward(
        model.inputs(base, first) @ model.weights, first, model.moves
    )
    return np.exp(forward[:, 1] + backward[:, 1] - total), size, first


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean probability of good over the lines of each text, weighted by their length."""
    out = []
    for _, _, data, offsets in text_chunks(texts):
        good, size, first = line_marginals(model, data, offsets)
        sums = np.zeros((2, len(good) + 1))
        np.cumsum(good * size, out=sums[0, 1:])
        np.cumsum(size, out=sums[1, 1:])
        part = sums[:, first[1:]] - sums[:, first[:-1]]
        out.append(np.where(part[1] > 0, part[0] / np.maximum(part[1], 1), model.prior))
    return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    per_class: int = TRAIN_PER_CLASS,
    max_chars: int = TRAIN_MAX_CHARS,
) -> DataFrame:
    """Add held_out, score and predicted to every row of ``docs``.

    The model learns from a bounded sample of ``labels`` (key, quality); see labelled_sample.
    Only the text is an input of a score. Null and empty texts, and texts of blanks, get the share
    of good documents in training as their score. Without labels of both classes every score is
    0.5. Repeated rows score alike; null keys are not held out. Columns of ``docs`` stay, those
    named held_out, score or predicted are replaced. An empty table gives an empty result.
    """
    model = train(labelled_sample(docs, labels, "quality", per_class, max_chars, text, key))
    base = docs.drop("held_out", "score", "predicted")
    return scored(base, text, lambda t: scores(model, t) if model else np.full(len(t), 0.5)).select(
        "*",
        held_out(F.col(key)).alias("held_out"),
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )


def scored(df: DataFrame, text: str, score) -> DataFrame:
    """Add ``score``: the numbers that ``score`` gives for Arrow texts, batch by batch."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            out = score(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"]
            )

    made = StructType([*df.schema.fields]).add("score", DoubleType())
    return df.mapInArrow(run, made)
