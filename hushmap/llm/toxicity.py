"""Toxicity of documents: a bidirectional gated recurrent network with attention, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmap.llm.quality_crf import scored
from hushmap.llm.shared import LOWER, Tokenized, mixed, text_chunks
from hushmap.llm.training import held_out, labelled_sample

#: Documents of each class that the model is trained on, and the longest taken.
TRAIN_PER_CLASS = 800
TRAIN_MAX_CHARS = 8_000
PREDICT_FROM = 0.5
#: Words in a window and from one window to the next.
WINDOW = 16
STRIDE = 8
#: Known words and character groups.
VOCABULARY = 6_000
WIDTH = 8  # of an input, and of a hidden state
SLOT_BITS = 20
CHUNK = 1 << 19

#: Words of this model: runs of letters, digits and bytes of other scripts.
_GAP = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_low:_high] = False
#: Character groups of a word: first 3, 4, 5 bytes and last 3, 4.
_HEADS, _TAILS = (3, 4, 5), (3, 4)
KINDS = 1 + len(_HEADS) + len(_TAILS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word and its character groups, words x KINDS; first word of each text).

    Groups longer than the word are 0.
    """
    found = Tokenized(LOWER[data], offsets, _GAP)
    out = np.empty((len(found.start), KINDS), np.uint64)
    out[:, 0] = found.hashes()
    size = found.end - found.start
    for k, n in enumerate(_HEADS, 1):
        end = np.minimum(found.start + n, found.end)
        out[:, k] = found.part(found.start, end) + np.uint64(k)
        out[size < n, k] = 0
    for k, n in enumerate(_TAILS, 1 + len(_HEADS)):
        begin = np.maximum(found.end - n, found.start)
        out[:, k] = found.part(begin, found.end) + np.uint64(k << 8)
        out[size < n, k] = 0
    return out, found.first


class Vocabulary:
    """Known hashes, numbered from 1; 0 stands for all others."""

    def __init__(self, keys: np.ndarray):
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        kept: list[int] = []
        shift = np.uint64(64 - SLOT_BITS)
        for key in keys.tolist():  # a slot goes to the first that wants it
            slot = int(mixed(np.array([key], np.uint64))[0] >> shift)
            if key and not self.slots[slot]:
                kept.append(key)
                self.slots[slot] = len(kept)
        self.keys = np.array([0, *kept], np.uint64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots[mixed(hashes) >> np.uint64(64 - SLOT_BITS)]
        return np.where(self.keys[at] == hashes, at, 0)


@dataclass
class Model:
    words: Vocabulary
    values: dict[str, np.ndarray]
    slope: float
    shift: float


def _start(size: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = WIDTH

    def some(*shape: int, scale: float = 0.3) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    made = {"table": some(size, h, scale=0.1), "look": some(2 * h, h), "key": some(h), "out": some(2 * h)}
    for side in "fb":
        made |= {f"x{side}": some(h, 3 * h), f"u{side}": some(h, 3 * h), f"b{side}": some(3 * h, scale=0.0)}
    return made | {"lookb": some(h, scale=0.0), "outb": some(1, scale=0.0)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(values: dict, inputs, steps: int, rows: int, keep: bool):
    """Hidden states of both directions, steps x rows x 2 * WIDTH, and what backward needs.

    ``inputs(side, t)`` are the projected inputs of step t, rows x 3 * WIDTH.
    """
    h = WIDTH
    states = np.empty((steps, rows, 2 * h), np.float32)
    saved: dict[tuple[str, int], tuple] = {}
    for side, times in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        u = values[f"u{side}"]
        state = np.zeros((rows, h), np.float32)
        low = 0 if side == "f" else h
        for t in times:
            x = inputs(side, t)
            inner = state @ u
            gates = _sigmoid(x[:, : 2 * h] + inner[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            fresh = np.tanh(x[:, 2 * h :] + reset * inner[:, 2 * h :])
            if keep:
                saved[side, t] = state, update, reset, fresh, inner[:, 2 * h :]
            state = fresh + update * (state - fresh)
            states[t, :, low : low + h] = state
    return states, saved


def _pool(values: dict, states: np.ndarray, mask: np.ndarray):
    """Attention over the steps where ``mask`` (steps x rows) holds, and the score."""
    look = np.tanh(states @ values["look"] + values["lookb"])
    weight = look @ values["key"]
    weight = np.where(mask, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight *= mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return look, weight, pooled, pooled @ values["out"] + values["outb"][0]


def _gradients(values: dict, numbers: np.ndarray, mask: np.ndarray, y: np.ndarray, cost: np.ndarray):
    """Gradients of the weighted log loss of windows (rows x steps x KINDS, mask rows x steps)."""
    h, (rows, steps, _) = WIDTH, numbers.shape
    x = values["table"][numbers].sum(2)  # rows x steps x WIDTH; row 0 of the table is 0
    projected = {s: x @ values[f"x{s}"] + values[f"b{s}"] for s in "fb"}
    states, saved = _run(values, lambda s, t: projected[s][:, t], steps, rows, True)
    on = mask.T
    look, weight, pooled, score = _pool(values, states, on)
    d_score = ((_sigmoid(score) - y) * cost / rows).astype(np.float32)
    made = {"out": pooled.T @ d_score, "outb": d_score.sum(keepdims=True)}
    d_pooled = d_score[:, None] * values["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_weight = weight * (d_weight - (weight * d_weight).sum(0))
    made["key"] = np.einsum("tb,tbh->h", d_weight, look)
    d_look = d_weight[:, :, None] * values["key"] * (1 - look**2)
    made["look"] = np.einsum("tbi,tbj->ij", states, d_look)
    made["lookb"] = d_look.sum((0, 1))
    d_states += d_look @ values["look"].T
    d_x = np.zeros_like(x)
    for side, times in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        u, low = values[f"u{side}"], 0 if side == "f" else h
        d_u = np.zeros_like(u)
        d_in = np.empty((rows, steps, 3 * h), np.float32)
        carried = np.zeros((rows, h), np.float32)
        for t in times:
            state, update, reset, fresh, inner = saved[side, t]
            d_h = d_states[t, :, low : low + h] + carried
            d_fresh = d_h * (1 - update) * (1 - fresh**2)
            d_gates = np.concatenate(
                [
                    d_h * (state - fresh) * update * (1 - update),
                    d_fresh * inner * reset * (1 - reset),
                    d_fresh,
                ],
                1,
            )
            d_in[:, t] = d_gates
            d_inner = d_gates.copy()
            d_inner[:, 2 * h :] *= reset
            d_u += state.T @ d_inner
            carried = d_h * update + d_inner @ u.T
        made[f"u{side}"] = d_u
        made[f"b{side}"] = d_in.sum((0, 1))
        made[f"x{side}"] = np.einsum("bti,btj->ij", x, d_in)
        d_x += d_in @ values[f"x{side}"].T
    table = np.zeros_like(values["table"])
    np.add.at(table, numbers, d_x[:, :, None, :])
    table[0] = 0
    made["table"] = table
    return made


def _windows(first: np.ndarray) -> np.ndarray:
    """First words of all windows of the texts; a text with a word has one at least."""
    counts = np.diff(first)
    each = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    total = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(total[-1]) - np.repeat(total[:-1], each)
    return np.repeat(first[:-1], each) + at * STRIDE, np.repeat(np.arange(len(counts)), each)


def window_scores(model_values: dict, numbers: np.ndarray, first: np.ndarray):
    """(log-odds of each window, text of each window); words x KINDS numbers of known groups."""
    starts, owner = _windows(first)
    out = np.empty(len(starts), np.float32)
    if not len(starts):
        return out, owner
    x = model_values["table"][numbers[:, 0]]
    for k in range(1, KINDS):
        x = x + model_values["table"][numbers[:, k]]
    x = np.concatenate([x, np.zeros((WINDOW, WIDTH), np.float32)])
    projected = {s: x @ model_values[f"x{s}"] + model_values[f"b{s}"] for s in "fb"}
    ends = first[1:][owner]
    for low in range(0, len(starts), 4096):
        at = starts[low : low + 4096]
        on = (at + np.arange(WINDOW)[:, None]) < ends[low : low + 4096]
        blank = {s: model_values[f"b{s}"] for s in "fb"}

        def inputs(side, t):
            part = projected[side][at + t]
            off = ~on[t]
            if off.any():
                part[off] = blank[side]
            return part

        states, _ = _run(model_values, inputs, WINDOW, len(at), False)
        out[low : low + 4096] = _pool(model_values, states, on)[3]
    return out, owner


def _all_scores(values: dict, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of all windows, some texts at a time."""
    out = []
    for low in range(0, len(first) - 1, 64):
        part = first[low : low + 65]
        out.append(window_scores(values, numbers[part[0] : part[-1]], part - part[0])[0])
    return np.concatenate(out)


def _most(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf, np.float32)
    np.maximum.at(out, owner, scores)
    return out


def _chosen(hashes: np.ndarray, first: np.ndarray, labels: np.ndarray):
    """(known hashes, their log-odds): half those that tell the classes apart, half the common."""
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    pairs = []
    for k in range(KINDS):
        both = np.stack([hashes[:, k], doc.astype(np.uint64)], 1)
        both = both[both[:, 0] != 0]
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        fresh = np.ones(len(both), bool)
        fresh[1:] = (both[1:] != both[:-1]).any(1)
        pairs.append(both[fresh])
    both = np.concatenate(pairs)
    keys, inverse = np.unique(both[:, 0], return_inverse=True)
    toxic = labels[both[:, 1].astype(np.int64)] == 1
    yes = np.bincount(inverse[toxic], minlength=len(keys))
    no = np.bincount(inverse[~toxic], minlength=len(keys))
    odds = np.log((yes + 0.5) / (labels.sum() + 1)) - np.log((no + 0.5) / ((labels == 0).sum() + 1))
    seen = yes + no
    telling = np.argsort(-np.abs(odds) * np.sqrt(seen) * (seen >= 5), kind="stable")
    common = np.argsort(-seen, kind="stable")
    half = VOCABULARY // 2
    at = np.unique(np.concatenate([telling[:half], common[:half]]))
    at = at[seen[at] >= 3]
    return keys[at], odds[at] * np.sqrt(np.minimum(seen[at], 25) / 25)


def train(sample: list[tuple[str, int]], steps: int = 200, seed: int = 5) -> Model | None:
    """Fit the network to windows, then the document's score to the highest window.

    A label says that a document has a toxic place, not where. Windows of clean documents are
    clean. A toxic document stands for its most telling window: first by the log-odds of the
    known groups in it, later by the network itself. A fifth of the sample only sets the scale
    of the score. There are about ``steps`` steps of 256 windows, at least 8 passes and at most
    60. None if a class is missing.
    """
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    epochs = int(np.clip(steps * 256 // (labels.sum() + 5 * (labels == 0).sum()), 8, 60))
    rng = np.random.default_rng(seed)
    parts, firsts, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_chunks(pa.array([t for t, _ in sample], pa.string())):
        hashes, first = features(data, offsets)
        parts.append(hashes)
        firsts.append(first[1:] + at)
        at += len(hashes)
    hashes, first = np.concatenate(parts), np.concatenate(firsts)
    keys, odds = _chosen(hashes, first, labels)
    words = Vocabulary(keys)
    worth = np.zeros(len(words.keys), np.float32)
    place = {k: i for i, k in enumerate(keys.tolist())}
    worth[1:] = [odds[place[k]] for k in words.keys[1:].tolist()]
    numbers = np.stack([words.numbers(hashes[:, k]).astype(np.int32) for k in range(KINDS)], 1)
    del parts, hashes
    values = _start(len(words.keys), rng)
    values["table"][0] = 0
    starts, owner = _windows(first)
    ends = first[1:][owner]
    fit = rng.random(len(labels)) < 0.8
    fit = fit if len(set(labels[fit].tolist())) == 2 else np.ones(len(labels), bool)
    word_worth = np.concatenate([worth[numbers].max(1), np.zeros(WINDOW, np.float32)])
    ahead = np.arange(WINDOW)
    window_worth = np.where(
        starts[:, None] + ahead < ends[:, None], word_worth[starts[:, None] + ahead], -9
    ).max(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    count = 0
    for epoch in range(epochs):
        if epoch == epochs // 2:
            window_worth = _all_scores(values, numbers, first)
        order = np.lexsort((-window_worth, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = labels[owner[order]] == 1
        drawn = rng.random(len(order)) < 3 / np.maximum(1, np.diff(np.append(_ends(owner, len(labels)), len(owner))))[owner[order]]
        use = order[fit[owner[order]] & np.where(toxic, rank < 1, (rank < 2) | drawn)]
        rng.shuffle(use)
        for low in range(0, len(use), 256):
            rows = use[low : low + 256]
            where = starts[rows][:, None] + ahead
            on = where < ends[rows][:, None]
            ids = np.where(on[:, :, None], numbers[np.minimum(where, len(numbers) - 1)], 0)
            y = labels[owner[rows]].astype(np.float32)
            count += 1
            cost = np.where(y == 1, 2.0, 1.0)
            for name, slope in _gradients(values, ids, on, y, cost).items():
                a, b = moments[name]
                a += 0.1 * (slope - a)
                b += 0.01 * (slope**2 - b)
                values[name] -= (
                    0.01 * (a / (1 - 0.9**count)) / (np.sqrt(b / (1 - 0.99**count)) + 1e-6)
                ).astype(np.float32)
    most = _most(_all_scores(values, numbers, first), owner, len(labels))
    rest = ~fit if len(set(labels[~fit].tolist())) == 2 else fit
    rest &= np.isfinite(most)
    slope, shift = _scale(most[rest].astype(np.float64), labels[rest])
    return Model(words, values, slope, shift)


def _ends(owner: np.ndarray, n: int) -> np.ndarray:
    """First window of each text."""
    return np.searchsorted(owner, np.arange(n))


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with a little shrinkage, by Newton steps."""
    centre, spread = x.mean(), x.std() + 1e-6
    design = np.stack([(x - centre) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = _sigmoid(np.clip(design @ w, -30, 30))
        slope = design.T @ (y - p) - 0.1 * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w = w + np.linalg.solve(bend, slope)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Score of each text: that of its most toxic window; without words, the least score 0."""
    out = []
    for _, _, data, offsets in text_chunks(texts, CHUNK):
        hashes, first = features(data, offsets)
        found, owner = window_scores(model.values, model.words.numbers(hashes), first)
        most = _most(found, owner, len(offsets) - 1).astype(np.float64)
        out.append(_sigmoid(np.clip(model.slope * most + model.shift, -700, 700)))
        out[-1][~np.isfinite(most)] = 0.0
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    per_class: int = TRAIN_PER_CLASS,
    max_chars: int = TRAIN_MAX_CHARS,
) -> DataFrame:
    """Add held_out, score and predicted to every row of ``docs``.

    All overlapping windows of the whole text are scored. The model learns from a bounded sample
    of ``labels`` (key, toxic); see labelled_sample. Only the text is an input of a score. Null
    and empty texts and texts without a word score 0. Without labels of both classes every score
    is 0. Repeated rows score alike; null keys are not held out. Columns of ``docs`` stay, those
    named held_out, score or predicted are replaced. An empty table gives an empty result.
    """
    model = train(labelled_sample(docs, labels, "toxic", per_class, max_chars, text, key))
    base = docs.drop("held_out", "score", "predicted")
    return scored(base, text, lambda t: scores(model, t) if model else np.zeros(len(t))).select(
        "*",
        held_out(F.col(key)).alias("held_out"),
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )
