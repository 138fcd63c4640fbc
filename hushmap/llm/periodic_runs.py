"""Runs in texts: stretches of words that repeat with a period, found by a suffix automaton."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.llm.shared import BLANK, Tokenized, mixed, text_chunks, unused

#: Least words of a run.
LEAST = 12
#: A run is at least LEAST words and twice its period long, so this many words in a row equal those
#: one period before.
GRAM = LEAST // 2
#: Passes that narrow the stretches in which runs may lie.
PASSES = 4
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


class LastEnds:
    """A suffix automaton over words whose link tree keeps, for each state, where the words that it
    stands for ended last.

    The link tree is held as a link-cut tree. A path that was last accessed as a whole is one
    splay tree with one colour, the place at which that access ended; only the root of a splay
    tree holds its colour. State 0, the empty word, is in no splay tree, so 0 also means "none".
    """

    def __init__(self, n: int):
        size = 2 * n + 2
        zeros = array("i", bytes(4 * size))
        self.length, self.link = zeros[:], zeros[:]
        # The first way out of a state; states with several keep the others in ``more``.
        self.word, self.to = array("i", b"\xff" * (4 * size)), zeros[:]
        self.more: dict[int, dict[int, int]] = {}
        self.left, self.right, self.up = zeros[:], zeros[:], zeros[:]
        self.colour = array("i", b"\xff" * (4 * size))
        self.link[0] = -1
        self.states, self.last = 1, 0

    def append(self, c: int) -> int:
        """Add a word; the state of the whole text so far."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        new = self.states
        self.states += 1
        length[new] = length[self.last] + 1
        p = self.last
        q = 0
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if p >= 0 and length[p] + 1 != length[q]:
            q = self._split(p, q, c)
        link[new] = self.up[new] = q
        self.last = new
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        """Part the shorter words of state ``q`` from it; their state stands above it."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        part = self.states
        self.states += 1
        length[part] = length[p] + 1
        word[part], to[part] = word[q], to[q]
        if q in more:
            more[part] = dict(more[q])
        while p >= 0:
            if word[p] == c:
                if to[p] != q:
                    break
                to[p] = part
            elif more[p][c] == q:
                more[p][c] = part
            else:
                break
            p = link[p]
        link[part] = link[q]
        link[q] = part
        # Both ended last at the same place: the new state joins the path just above q.
        self._splay(q)
        above = self.left[q]
        self.left[part] = above
        if above:
            self.up[above] = part
        self.left[q] = part
        self.up[part] = q
        return part

    def _splay(self, x: int) -> None:
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p)
                self._rotate(x)
            elif inner:
                self._rotate(x)
                self._rotate(x)
            else:
                colour[x] = colour[p]
                self._rotate(x)
                return
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                colour[x] = colour[g]

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            moved = right[x]
            left[p] = moved
            right[x] = p
        else:
            moved = left[x]
            right[p] = moved
            left[x] = p
        if moved:
            up[moved] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x] = g
        up[p] = x

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Colour the path from the root to ``state`` with ``end``; yield, for each segment of it
        that had a colour, that earlier end and the length of the longest word of the segment."""
        right, up, colour, length = self.right, self.up, self.colour, self.length
        below, x = 0, state
        while x:
            self._splay(x)
            before = colour[x]
            if before >= 0:
                yield before, length[x]
            off = right[x]
            if off:
                colour[off] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = end


def maximal_runs(ids: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by end, of numbered words.

    When word i is appended, a segment of the path to the text's state says that its longest word,
    ``long`` words ending at i, ended last at ``before``. Then d = i - before is the smallest
    period of the long + d words that end at i, and no word to the left extends them. With
    d <= long they hold a square; if the next word differs from the one d before it, they are a
    run.
    """
    n = len(ids)
    ends = LastEnds(n)
    out = []
    for i, c in enumerate(ids):
        for before, long in ends.access(ends.append(c), i):
            d = i - before
            if d <= long and long + d >= least and (i + 1 == n or ids[i + 1] != ids[i + 1 - d]):
                out.append((i + 1 - long - d, long + d, d))
    return out


def stretches(found: Tokenized) -> list[tuple[int, int]]:
    """Word ranges that hold all runs, disjoint and each within one text.

    All words of a run lie in GRAM words in a row that occur again one period to the left or the
    right, in the same run. So words outside such places, which are at most half the stretch of
    such words apart, lie in no run; what is left over falls into shorter stretches, for which
    the same holds. Equal words have equal hashes, so no run is lost; words that only share a
    hash make a stretch longer than needed.
    """
    n = len(found.start) - GRAM + 1
    if n <= 0:
        return []
    hashes, doc = found.hashes(), found.doc_of_word()
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram *= Tokenized.STEP
        gram += hashes[k : k + n]
    place = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    group, reach = doc[place].astype(np.uint64), np.full(len(place), len(doc))
    for _ in range(PASSES):
        key = mixed(gram[place] + group * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        near = (key[order[1:]] == key[order[:-1]]) & (
            place[order[1:]] - place[order[:-1]] <= reach[order[1:]]
        )
        twice = np.zeros(len(place), bool)
        twice[order[1:][near]] = True
        twice[order[:-1][near]] = True
        before, place = len(place), place[twice]
        begin, size, words = _touching(place, doc)
        stays = np.repeat(words >= LEAST, size)
        place = place[stays]
        group = np.repeat(np.arange(len(size)), size)[stays].astype(np.uint64)
        reach = np.repeat(words // 2, size)[stays]
        if len(place) in (0, before):
            break
    begin, _, words = _touching(place, doc)
    return [(a, a + w) for a, w in zip(place[begin].tolist(), words.tolist())]


def _touching(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first place, number of places, number of words) of each stretch of places
    whose words leave no gap within a text."""
    head = np.ones(len(place), bool)
    head[1:] = (np.diff(place) > GRAM) | (np.diff(doc[place]) != 0)
    begin = np.flatnonzero(head)
    after = np.append(begin[1:], len(place)).astype(np.int64)
    words = place[after - 1] - place[begin] + GRAM if len(place) else begin
    return begin, after - begin if len(place) else begin, words


def _text_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list, str]]:
    """(number of words, runs, collapsed text) of each text of a chunk."""
    found = Tokenized(data, offsets, BLANK)
    raw, start, end, first = data.tobytes(), found.start, found.end, found.first
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(found):
        at = int(np.searchsorted(first, a, "right")) - 1
        numbers: dict[bytes, int] = {}
        ids = [
            numbers.setdefault(raw[s:e], len(numbers))
            for s, e in zip(start[a:b].tolist(), end[a:b].tolist())
        ]
        shift = a - int(first[at])
        runs.setdefault(at, []).extend((s + shift, n, p) for s, n, p in maximal_runs(ids))
    for at in range(len(offsets) - 1):
        words = raw[offsets[at] : offsets[at + 1]].split()
        mine = sorted(runs.get(at, ()), key=lambda r: (r[0], r[2]))
        n = len(words)
        if mine:
            change = np.zeros(n + 1, np.int64)
            for s, long, p in mine:
                change[s + p] += 1
                change[s + long] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        yield n, mine, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, and ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` lists (start, length, period), by start, then period, of all runs of the words of the
    text: stretches with that smallest period, at least LEAST words and twice the period long,
    that no neighbouring word extends. ``collapsed`` is the text without the words that any run
    contains after its first period, joined by single spaces.

    Texts are taken whole and one by one, in the task that reads them: no shuffle. The automaton
    runs over the stretches of a text that may hold a run (``stretches``), which loses none.
    Memory grows with the longest text, by about 150 bytes a word of a stretch. Null and empty
    texts have no words, no runs and an empty collapsed text. Repeated rows give repeated
    results, an empty table an empty one. Other columns are not read. A result whose name is
    among ``keep`` gets underscores before its name. Two kept columns of one name are an error.
    """
    keep = list(keep)
    names = [unused(docs.select(*keep), name) for name in ("n_words", "runs", "collapsed")]
    kinds = ["long", T.ArrayType(RUN), "string"]
    schema = T.StructType([docs.schema[k] for k in keep])
    for name, kind in zip(names, kinds):
        schema = schema.add(name, kind)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in batches:
            *held, texts = batch.columns
            for at, to, data, offsets in text_chunks(texts):
                counts, runs, collapsed = zip(*_text_runs(data, offsets))
                made = [
                    pa.array(counts, pa.int64()),
                    pa.array(
                        [[dict(zip(("start", "length", "period"), r)) for r in row] for row in runs],
                        kind,
                    ),
                    pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in held), *made], [*keep, *names]
                )

    source = docs.select(*keep, F.col(text).cast("string").alias(unused(docs.select(*keep), "_text")))
    return source.mapInArrow(find, schema)
