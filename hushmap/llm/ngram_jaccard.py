"""Documents whose word n-gram sets overlap: a token-group matrix over similar groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.llm.shared import (
    BLANK,
    LOWER,
    Tokenized,
    components,
    if_few,
    mixed,
    stored,
    text_chunks,
)

N = 5
#: A link needs this many hundredths of the union in common.
PERCENT = 75
#: Two sets must share one more of their first elements for every COMMON_STEP elements of the
#: smaller one. Results do not depend on it: smaller steps read more elements, and ask less.
COMMON_STEP = 32
#: Frequencies are counted in 2 ** ORDER_BITS buckets of element hashes. They only order elements;
#: results do not depend on them.
ORDER_BITS = 18
#: Rows of one element, or questions to one set, that share a part of a join; at most so many parts.
HOT, MOST_PARTS = 512, 64
#: Elements of the sets in a block of questions or members, 8 bytes each, when a group is opened.
BLOCK = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text, A-Z lower-cased.

    A text of 1 to n - 1 words has one element, its whole word sequence; without words, none.
    """
    found = Tokenized(LOWER[data], offsets, BLANK)
    words = found.hashes()
    total = max(len(words) - n + 1, 0)
    grams = np.zeros(total, np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + total]
    grams = mixed(grams)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= n:
            out.append(_distinct(grams[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mixed(np.array([whole ^ w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def _over_texts(df: DataFrame, schema: str, row: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Columns (id, text) to (id, *row(set)) for each text."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in text_chunks(batch.column(1)):
                rows = [row(s) for s in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at)]
                    + [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])],
                    names,
                )

    return df.mapInArrow(run, schema)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _signature(values: np.ndarray) -> tuple[int, int, int]:
    if not len(values):
        return 0, 0, 0
    with np.errstate(over="ignore"):
        sums = (values.sum(dtype=np.uint64), mixed(values ^ np.uint64(0xA5A5)).sum(dtype=np.uint64))
    a, b = _signed(np.array(sums, np.uint64)).tolist()
    return len(values), a, b


def least_common(n: int) -> int:
    """How many of their first elements two linked sets share, the smaller having ``n``."""
    return 1 + n // COMMON_STEP


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(short, long): first elements, rarest first, to look at in a set of ``n``.

    Linked sets of n <= m elements have at least 2 * percent / (100 + percent) of n, and percent
    hundredths of m, in common. In any order of all elements, the first ``least_common(n)`` of
    these are then among the first short(n) of the one and the first long(m) of the other.
    """
    smaller = -(-2 * percent * n // (100 + percent))
    larger = -(-percent * n // 100)
    return n - smaller + least_common(n), n - larger + least_common(n)


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def token_order(texts: DataFrame, bits: int = ORDER_BITS) -> np.ndarray:
    """Rank of each bucket of element hashes: how many sets have elements in it, in steps of an
    eighth. A table of 2 ** bits bytes, whatever the size of the corpus."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                found = np.concatenate(shingle_sets(data, offsets))
                counts += np.bincount(_bucket(found, bits), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "c"])

    found = texts.mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    ranks = np.zeros(1 << bits, np.uint8)
    steps = np.floor(6 * np.log2(1 + found["c"].to_numpy().astype(float)))
    ranks[found["at"].to_numpy()] = np.minimum(steps, 255)
    return ranks


def prefix(values: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first elements of a sorted set, by rank and then by hash: as many as ``prefix_sizes``
    says for its part as the larger of two sets."""
    order = np.argsort(ranks[_bucket(values, int(len(ranks)).bit_length() - 1)], kind="stable")
    return values[order[: prefix_sizes(len(values), percent)[1]]]


def similar_documents(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    percent: int = PERCENT,
    order_bits: int = ORDER_BITS,
) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Two rows link when 100 * shared >= ``percent`` * union of their shingle sets. Every two linked
    rows have one component_id, the least key that links reach. Documents without words, and null
    texts, link with nothing; their component_id is their key. Rows are judged one by one: rows
    with repeated keys each give a row, and rows with a null key are linked like others, their
    component_id being null where no key is in reach. Extra columns are not read. An empty table
    gives an empty result.

    1. Sets that are equal are one class, which has a number; one row stands for it.
    2. Elements are ordered by how often they occur, rarest first. Two linked sets share a known
       number of their first elements (``prefix_sizes``). Sets that do not share enough of them
       with any sets, the great majority, can have no link.
    3. The rest falls into groups: each first element leads to the least changed set that has
       it; sets form groups with the ones that most of their elements lead to, and are compared
       exactly with these.
    4. The token-group matrix holds the union of the first elements of each group's sets. The
       smaller of two linked sets asks: a group qualifies if the set's first elements have enough
       in common with that union.
    5. Only qualifying groups are opened, block by block: members that share enough first elements
       with the asking set are compared exactly, unless links join the two already.

    No step rests on chance beside the 64-bit hashes that stand for shingles. No step gathers a
    group: classes, leaders and unions are aggregates. Elements with many rows are joined in parts.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    signed = stored(_over_texts(texts, "id long, n long, a long, b long", _signature))
    # Equal sets: two independent 64-bit sums over the elements and the size agree.
    classes = stored(
        signed.where("n > 0")
        .groupBy("n", "a", "b")
        .agg(F.min("id").alias("least"))
        .withColumnsRenamed({"n": "n2", "a": "a2", "b": "b2"})
        .withColumn("rep", F.monotonically_increasing_id())
    )
    sets = _Sets(texts, signed, classes)
    ranks = token_order(texts, order_bits)
    spots, sizes = _spots(sets, ranks, percent)
    led = _leaders(spots, sizes, percent)
    links = stored(_linked(led, sets, percent))
    joined = stored(components(links, "rep", "with").withColumnsRenamed({"id": "id2"}))
    groups = stored(components(led, "rep", "with").withColumnsRenamed({"id": "id3", "component": "g"}))
    placed = stored(
        sizes.join(joined, F.col("rep") == F.col("id2"), "left")
        .join(groups, F.col("rep") == F.col("id3"), "left")
        .select("rep", "n", F.coalesce("component", "rep").alias("linked"), F.coalesce("g", "rep").alias("g"))
    )
    passed = _questions(spots, sizes, placed, percent)
    if not passed.isEmpty():
        links = links.unionByName(stored(_opened(passed, placed, sets, ranks, percent)))
        joined = stored(components(links, "rep", "with").withColumnsRenamed({"id": "id2"}))
    # The least key of each class's component.
    found = classes.join(joined, F.col("rep") == F.col("id2"), "left").select(
        "n2", "a2", "b2", "least", F.coalesce("component", "rep").alias("component")
    )
    keys = found.groupBy(F.col("component").alias("c2")).agg(F.min("least").alias("component_id"))
    named = found.join(keys, F.col("component") == F.col("c2")).select("n2", "a2", "b2", "component_id")
    return signed.join(named, _same_set(), "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _same_set() -> Column:
    return (F.col("n") == F.col("n2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))


class _Sets:
    """The sets of classes, made from the texts whenever they are asked for."""

    schema = "id long, n long, a long, b long, s array<bigint>"

    def __init__(self, texts: DataFrame, signed: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes
        # With a key of its own for each row, the least key of a class tells its row.
        self.keyed = signed.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty()

    def arrays(self, row: Callable[[np.ndarray], np.ndarray], only: DataFrame | None = None) -> DataFrame:
        """(rep, n, s): what ``row`` makes of the set of each class, or of those in ``only`` (rep).

        Where rows share keys, more than one may stand for a class; they are equal, and one is
        kept, within map tasks first.
        """
        texts, classes = self.texts, self.classes
        if only is not None:
            named = only.select(F.col("rep").alias("rep3"))
            classes = stored(classes.join(named, F.col("rep") == F.col("rep3"), "left_semi"))
        least = classes.select(F.col("least").alias("id2"), "rep")
        made = lambda v: (len(v), _signed(row(v)))
        if self.keyed and only is not None:
            # One join picks the rows and names their classes, before sets are made.
            rows = texts.join(if_few(least), F.col("id") == F.col("id2")).select("rep", "t")
            return _over_texts(rows, "rep long, n long, s array<bigint>", made)
        if self.keyed:
            rows = _over_texts(texts, "id long, n long, s array<bigint>", made)
            return rows.join(least, F.col("id") == F.col("id2")).select("rep", "n", "s")
        if only is not None:
            ids = classes.select(F.col("least").alias("id4")).distinct()
            texts = texts.join(
                if_few(stored(ids)), F.col("id").eqNullSafe(F.col("id4")), "left_semi"
            )
        rows = _over_texts(texts, self.schema, lambda v: (*_signature(v), _signed(row(v))))
        chosen = _same_set() & F.col("id").eqNullSafe(F.col("least"))
        return rows.join(classes, chosen).groupBy("rep").agg(F.first("n").alias("n"), F.first("s").alias("s"))


def _spots(sets: _Sets, ranks: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """First elements that several sets have, as (rep, brief, x, share), and the sizes (rep, n).

    ``brief``: the element is among those of the set as the smaller of two; ``share``: how much of
    the set's first elements others have, with a little of its own so that sets do not tie. Sets
    that have too few such elements for any link are left out.
    """
    firsts = sets.arrays(lambda v: prefix(v, ranks, percent))
    short = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + _least_common(F.col("n"))
    # The number of a set and whether the element is brief share a column, as many rows move.
    tokens = firsts.select("rep", short.alias("short"), F.posexplode("s").alias("at", "x")).select(
        (F.col("rep") * 2 + (F.col("at") < F.col("short")).cast("long")).alias("spot"), "x"
    )
    rep = F.shiftright("spot", 1)
    common = stored(
        tokens.select("x", rep.alias("rep"))
        .groupBy("x")
        .agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("low < high")
        .select(F.col("x").alias("x2"))
    )
    spots = stored(
        tokens.join(common, F.col("x") == F.col("x2")).select(
            rep.alias("rep"), (F.col("spot") % 2 == 1).alias("brief"), "x"
        )
    )
    sizes = sets.classes.select(F.col("rep").alias("rep2"), F.col("n2").alias("n"))
    able = stored(_enough(spots, sizes, percent))
    firsts_of = F.col("n") - F.ceil(F.col("n") * percent / 100) + _least_common(F.col("n"))
    own = F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) * 1e-12
    named = able.select(F.col("rep").alias("rep3"), (F.col("c") / firsts_of + own).alias("share"))
    return spots.join(named, F.col("rep") == F.col("rep3")).drop("rep3"), able


def _leaders(spots: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(rep, with): for each set the one to compare it with first.

    Each element leads to the set with the largest share among those that have it, which of a
    family of copies is the one least changed; of its leaders, a set takes the one that most of
    its elements lead to, if these are enough for a link.
    """
    spots = stored(spots)
    leaders = spots.groupBy(F.col("x").alias("x2")).agg(F.max_by("rep", "share").alias("leader"))
    best = (
        spots.join(leaders, F.col("x") == F.col("x2"))
        .where("leader <> rep")
        .groupBy("rep", "leader")
        .agg(F.count(F.lit(1)).alias("common"))
        .groupBy("rep")
        .agg(F.max_by("leader", "common").alias("with"), F.max("common").alias("common"))
    )
    named = sizes.select(F.col("rep").alias("rep2"), "n")
    enough = F.col("common") >= _least_common(F.ceil(F.col("n") * percent / 100))
    return stored(best.join(named, F.col("rep") == F.col("rep2")).where(enough).select("rep", "with"))


def _least_common(n: Column) -> Column:
    return F.floor(n / COMMON_STEP) + 1


def _enough(spots: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(rep, n, c) of sets with as many spots as a link needs with the smallest set they link with."""
    counted = spots.groupBy("rep").agg(F.count(F.lit(1)).alias("c"))
    smallest = F.ceil(F.col("n") * percent / 100)
    return (
        counted.join(sizes, F.col("rep") == F.col("rep2"))
        .where(F.col("c") >= _least_common(smallest))
        .select("rep", "n", "c")
    )


def _questions(
    spots: DataFrame, sizes: DataFrame, placed: DataFrame, percent: int
) -> DataFrame:
    """(rep, n, h): groups that may hold a partner of a set, through the token-group matrix.

    A set asks its own group, unless links join all of that already, and other groups whose union
    of first elements has enough in common with its own.
    """
    own = placed.groupBy(F.col("g").alias("h")).agg(
        F.min("linked").alias("low"), F.max("linked").alias("high")
    ).where("low < high")
    inside = placed.join(own, F.col("g") == F.col("h")).select("rep", "n", "h")
    named = placed.select(F.col("rep").alias("rep4"), "g")
    grouped = stored(
        spots.join(named, F.col("rep") == F.col("rep4")).select("rep", "brief", "x", "g")
    )
    between = stored(
        grouped.groupBy("x")
        .agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("c"))
        .where("low < high")
        .select(
            F.col("x").alias("x2"),
            F.least(F.floor(F.col("c") / HOT) + 1, F.lit(MOST_PARTS)).alias("parts"),
        )
    )
    met = stored(
        grouped.join(between, F.col("x") == F.col("x2")).select("rep", "brief", "x", "g", "parts")
    )
    sizes = sizes.select(F.col("rep").alias("rep2"), "n")
    left = stored(_enough(met, sizes, percent))
    named = left.select(F.col("rep").alias("rep3"), "n")
    met = stored(
        met.join(named, F.col("rep") == F.col("rep3")).select("rep", "n", "brief", "x", "g", "parts")
    )
    # Hot elements: the asking sets are dealt to parts, the other side goes to each part.
    asking = met.where("brief").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    each_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part2")
    matrix = (
        met.groupBy(F.col("x").alias("x2"), F.col("g").alias("h"), "parts")
        .agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))
        .select("x2", "h", "smallest", "largest", each_part)
    )
    here = (F.col("x") == F.col("x2")) & (F.col("part") == F.col("part2"))
    fits = (F.col("largest") >= F.col("n")) & (percent * F.col("smallest") <= 100 * F.col("n"))
    across = (
        asking.join(matrix, here & (F.col("g") != F.col("h")) & fits)
        .groupBy("rep", "n", "h")
        .agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("c") >= _least_common(F.col("n")))
        .select("rep", "n", "h")
    )
    return stored(inside.unionByName(across))


def _opened(
    passed: DataFrame, placed: DataFrame, sets: _Sets, ranks: np.ndarray, percent: int
) -> DataFrame:
    """Links (rep, with) that join all sets whose questions (rep, n, h) members of h answer.

    The questions to a group and its members ``placed`` (rep, n, linked, g) are dealt to blocks of
    about BLOCK elements, and each block of questions meets each block of members. There, members
    that share enough first elements with a set are compared exactly, those that share most first,
    unless known links, or those found in the block, join the two already.
    """
    blocks = lambda n: F.floor(F.sum(n) / BLOCK) + 1
    asks = passed.groupBy("h").agg(blocks("n").alias("rows"))
    has = placed.groupBy("g").agg(blocks("n").alias("cols"))
    grid = stored(asks.join(has, F.col("h") == F.col("g")).select(F.col("h").alias("h2"), "rows", "cols"))
    dealt = lambda of: F.pmod(F.xxhash64("rep"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    linked = placed.select(F.col("rep").alias("rep4"), "linked")
    questions = stored(
        passed.join(grid, F.col("h") == F.col("h2"))
        .join(linked, F.col("rep") == F.col("rep4"))
        .select(
            F.col("rep").alias("rep2"), "linked", "h", dealt("rows").alias("i"), every("cols").alias("j")
        )
    )
    members = stored(
        placed.join(grid, F.col("g") == F.col("h2")).select(
            F.col("rep").alias("rep2"),
            "linked",
            F.col("g").alias("h"),
            every("rows").alias("i"),
            dealt("cols").alias("j"),
        )
    )

    def with_sets(spread: DataFrame) -> DataFrame:
        only = stored(spread.select(F.col("rep2").alias("rep")).distinct())
        return (
            sets.arrays(lambda v: v, only)
            .join(if_few(spread), F.col("rep") == F.col("rep2"))
            .select(*[F.col(c).alias(c) for c in ("h", "i", "j", "rep", "linked", "s")])
            .groupBy("h", "i", "j")
        )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _first_links(_rows(left), _rows(right), ranks, percent)
        return pa.table(
            {"rep": pa.array([a for a, _ in found], pa.int64()), "with": pa.array([b for _, b in found], pa.int64())}
        )

    return (
        with_sets(questions).cogroup(with_sets(members)).applyInArrow(compare, "rep long, with long")
    )


def _rows(table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    arrays = [
        chunk.values.to_numpy()[a:b].view(np.uint64)
        for chunk in table["s"].chunks
        for a, b in zip(chunk.offsets.to_numpy()[:-1], chunk.offsets.to_numpy()[1:])
    ]
    return list(zip(table["rep"].to_pylist(), table["linked"].to_pylist(), arrays))


def _first_links(
    asking: list[tuple[int, int, np.ndarray]],
    members: list[tuple[int, int, np.ndarray]],
    ranks: np.ndarray,
    percent: int,
) -> list[tuple[int, int]]:
    """Links between asking sets and members no smaller, rows (set, what it is linked to, elements),
    as far as they join sets that no other link joins."""
    if not asking or not members:
        return []
    above: dict[int, int] = {}

    def top(k: int) -> int:
        while k in above:
            k = above[k]
        return k

    firsts = [prefix(s, ranks, percent) for _, _, s in members]
    elements = np.concatenate(firsts)
    owner = np.repeat(np.arange(len(members)), [len(f) for f in firsts])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    sizes = np.array([len(s) for _, _, s in members])
    out = []
    for rep, linked, values in asking:
        n = len(values)
        asked = prefix(values, ranks, percent)[: prefix_sizes(n, percent)[0]]
        low, high = np.searchsorted(elements, asked), np.searchsorted(elements, asked, "right")
        spans = high - low
        at = np.arange(spans.sum()) + np.repeat(low - np.cumsum(spans) + spans, spans)
        common = np.bincount(owner[at], minlength=len(members))
        fit = np.flatnonzero(
            (common >= least_common(n)) & (sizes >= n) & (100 * n >= percent * sizes)
        )
        for k in fit[np.argsort(-common[fit], kind="stable")].tolist():
            other, to, its = members[k]
            mine, theirs = top(linked), top(to)
            if mine == theirs:
                continue
            shared = _shared(values, its)
            if 100 * shared >= percent * (n + len(its) - shared):
                out.append((rep, other))
                above[mine] = theirs
    return out


def _linked(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Pairs (rep, with) whose sets overlap enough, by exact comparison.

    The second set is sent once for each part of the pairs that need it.
    """
    if pairs.isEmpty():
        return pairs
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(MOST_PARTS)))
    needed = dealt.select(F.col("with").alias("with2"), F.col("part").alias("part2")).distinct()
    one = sets.arrays(lambda v: v, stored(pairs.select("rep").distinct()))
    two = sets.arrays(lambda v: v, stored(pairs.select(F.col("with").alias("rep")).distinct()))
    dealt = if_few(dealt.select(F.col("rep").alias("rep2"), "with", "part"))
    first = one.join(dealt, F.col("rep") == F.col("rep2")).select(
        "rep", "with", "part", F.col("s").alias("s1")
    )
    second = two.join(if_few(stored(needed)), F.col("rep") == F.col("with2")).select(
        "with2", "part2", F.col("s").alias("s2")
    )
    both = first.join(
        second, (F.col("with") == F.col("with2")) & (F.col("part") == F.col("part2"))
    ).select("rep", "with", "s1", "s2")

    def compare(batches):
        for batch in batches:
            sides = []
            for c in (2, 3):
                column = batch.column(c)
                places = column.offsets.to_numpy()
                sides.append((column.values.to_numpy(), places))
            keep = []
            for i in range(len(batch)):
                a, b = (v[p[i] : p[i + 1]] for v, p in sides)
                n = _shared(a.view(np.uint64), b.view(np.uint64))
                keep.append(100 * n >= percent * (len(a) + len(b) - n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "rep long, with long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
