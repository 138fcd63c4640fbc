import math
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushmap.llm import length_buckets, mixing, quality_rules
from hushmap.llm.shared import components, count_words, running_totals
from tests.llm.helpers import ODD, Groups, clashing, documents, words


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), failed,
    )


REPEATS = [
    (20, "a b c d e f g h " * 2 + "x", "s"),
    (21, "a b c d e f g h i j a b c d e f g h i j k", "s"),
    (22, " ".join(map(str, range(30))), "s"),
    (23, "l 1\nl 1\n\n\nl 2\r\nl 1", "s"),
    (24, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(8))), "s"),
]


def test_base_counts_follow_a_plain_loop(spark):
    rows = ODD + REPEATS
    got = quality_rules.base_counts(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        ) == plain_counts(text), r.doc_id


def test_verdict_does_not_depend_on_order_or_sample(spark):
    docs = documents(spark, ODD + REPEATS)
    judged = quality_rules.base_counts(docs)
    base = quality_rules.Rule("base", lambda t: F.col("base_failed"))
    rules = [base, *quality_rules.RULES]
    one = quality_rules.cascade(judged, rules).where("rejected_by is null")
    two = quality_rules.cascade(judged, rules[::-1]).where("rejected_by is null")
    kept = quality_rules.quality_rules(docs, sample_rows=2).where("kept")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in two.collect()}
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in kept.collect()}


def test_rules_are_ordered_by_rejection_per_cost():
    a, b, c = (quality_rules.Rule(n, lambda t: t.isNull()) for n in "abc")
    measured = [(a, 2.0, 0.5), (b, 1.0, 0.5), (c, 1.0, 0.0)]
    assert [r.name for r in quality_rules.ordered(measured)] == ["b", "a", "c"]


def test_stutter_counts_over_all_gaps(spark):
    gaps = [" ", "\n", "\t", "  ", "\r\n", " \n\t ", "\x0b"]
    rows = [(k, " ".join(f"w{i}{gap}w{i}" for i in range(25)), "s") for k, gap in enumerate(gaps)]
    rows += [(50, "\n".join(f"w{i}\tx{i} w{i}w{i}" for i in range(25)), "s"), (51, "a\n\na a aa\ta", "s")]
    docs = documents(spark, rows)
    share = {r.doc_id: r.s for r in docs.select("doc_id", quality_rules._adjacent(F.col("text")).alias("s")).collect()}
    for i, text, _ in rows:
        w = words(text)
        assert math.isclose(share[i], sum(a == b for a, b in zip(w, w[1:])) / len(w)), i
    kept = quality_rules.quality_rules(docs).where("kept").collect()
    assert {r.doc_id for r in kept} == {50}


def test_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(documents(spark, []).limit(0)).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Hand out what full sources leave, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            full.add(s)


def test_targets_fill_up_as_by_hand(spark):
    cases = [
        {"a": 100, "b": 5, "c": 1, "é": 50, "z": 0, None: 9},
        {"a": 1},
        {"a": 0, "b": 0},
        {f"s{i}": 3**i for i in range(9)},
    ]
    for case in cases:
        df = spark.createDataFrame(list(case.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(case)
        assert got.keys() == want.keys()
        for s in want:
            assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9), (case, s)


def test_mix_takes_near_target_and_agrees_with_itself(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "ab"[i % 5 == 0]) for i in range(400)]
    docs = clashing(documents(spark, rows + ODD)).repartition(5)
    one = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    two = sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert one == two and len(one) == len(rows) + len(ODD)
    taken, target = defaultdict(int), {}
    for _, source, size, _, goal, copies in one:
        assert 0 <= copies <= 3
        taken[source] += size * copies
        target[source] = goal
    for s in ("a", "b"):
        assert abs(taken[s] - target[s]) <= 3000 + 0.02 * target[s]


def test_emit_repeats_rows(spark):
    docs = documents(spark, [(1, "a", "s"), (2, "b", "s"), (None, "c", "s")])
    mixed = spark.createDataFrame([(1, 3), (2, 0), (None, 1)], "doc_id long, copies long")
    got = mixing.emit(docs, mixed)
    assert got.columns == docs.columns
    assert Counter(r.text for r in got.collect()) == {"a": 3, "c": 1}


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0


def test_running_totals_follow_a_plain_loop(spark):
    rows = [(("g" if i % 3 else None), i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    for greatest in (False, True):
        got = running_totals(df, "v", ["g"], [F.col("o"), F.col("v")], "t", greatest).collect()
        assert len(got) == 500
        for r in got:
            before = [v for g, o, v in rows if g == r.g and (o, v) < (r.o, r.v)]
            assert r.t == ((max(before) if before else None) if greatest else sum(before))


def test_components_follow_union_find(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 900), (160, 2), (None, 4)]
    edges += [(1000, i) for i in range(1001, 1300)]
    groups = Groups()
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {a: groups.find(a) for a in groups.parent}


def padded(bins, counts, bounds):
    return sum(c * next(b for b in bounds if b >= n) for n, c in zip(bins, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_the_best_of_all(histogram, n):
    import itertools

    import numpy as np

    bins = sorted(histogram)
    counts = [histogram[b] for b in bins]
    got = length_buckets.best_bounds(np.array(bins), np.array(counts), n)
    assert got[-1] == bins[-1] and len(got) <= n and got == sorted(set(got))
    best = min(
        padded(bins, counts, [*chosen, bins[-1]])
        for k in range(min(n, len(bins)))
        for chosen in itertools.combinations(bins[:-1], k)
    )
    assert padded(bins, counts, got) == best


def test_length_bins_hold_their_lengths(spark):
    lengths = spark.range(0, 20_000).select("id", length_buckets.length_bin(F.col("id"), 64).alias("b"))
    rows = lengths.collect()
    assert all(r.b >= r.id and (r.id > 64 or r.b == r.id) for r in rows)
    assert all(r.b <= r.id * (1 + 1 / 32) + 1 for r in rows)
    assert len({r.b for r in rows}) <= 64 * 10


def test_batches_hold_their_budget(spark):
    rows = ODD + [(i, "w " * (i % 90), "a") for i in range(100, 400)] + [(100, "again", "b"), (None, "n", "b")]
    docs = clashing(documents(spark, rows))
    got = length_buckets.pack_by_length(docs, count_words(F.col("text")), budget=500).collect()
    assert len(got) == len(rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_len
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), members in batches.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_len <= 500
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    empty = documents(spark, []).limit(0)
    assert length_buckets.pack_by_length(empty, count_words(F.col("text"))).count() == 0
