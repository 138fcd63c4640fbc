"""Line dedup, periodic runs and the Merkle manifest against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushmap.llm import line_runs, merkle_manifest, periodic_runs, queries
from tests.llm.helpers import ODD, clashing, documents, words

STRIP = " \t\n\x0b\x0c\r"
AZ = {c: c + 32 for c in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Line dedup


def dedup(rows, least_docs=5):
    """rows: (id, text) in the order in which they are read."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    found = defaultdict(list)
    for k in order:
        for key in {line.strip(STRIP).translate(AZ) for line in (rows[k][1] or "").split("\n")}:
            if len(key) >= 40:
                found[key].append(k)
    out = []
    for k, (i, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            holders = found.get(line.strip(STRIP).translate(AZ), [])
            if len(holders) < least_docs or holders[-1] == k:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed, n, ids):
    rng = random.Random(seed)
    pool = [f"Diese Zeile Nummer {k} ist lang genug für den Abgleich ÄÖ" for k in range(12)]
    out = []
    for k in range(n):
        lines = []
        for _ in range(rng.randrange(9)):
            line = rng.choice(pool + ["short", "", f"a line of its own, written once only: {rng.random()}"])
            line = rng.choice([line, line.upper().replace("ß", "ß"), f" \t{line}\x0c ", line])
            lines.append(line)
        out.append((ids(k), rng.choice(["\n".join(lines)] * 6 + [None, "", "\n\n"])))
    return out


def deduped(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = line_runs.dedup_lines(table, **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in made), key=str)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (4, 2), (7, 3)])
def test_lines_equal_a_plain_loop_however_many_batches_come(spark, batches, fan_out):
    rows = line_rows(batches, 60, lambda k: (k * 37) % 61 - 20)
    assert deduped(spark, rows, batches=batches, fan_out=fan_out) == dedup(rows)


def test_lines_of_rows_with_null_and_repeated_ids(spark):
    rows = line_rows(3, 50, lambda k: None if k % 3 == 0 else k // 6)
    assert deduped(spark, rows) == dedup(rows)
    rows = [(7, "one line of forty code points or so, repeated\nx")] * 8
    got = deduped(spark, rows)
    assert sorted(r[2] for r in got) == [0] + [1] * 7


def test_lines_of_the_greatest_ids(spark):
    line = "this line stands in all of the documents given here"
    ids = [-(2**63), 2**63 - 1, 2**63 - 2, 0, -1, None]
    got = {r[0]: r[2] for r in deduped(spark, [(i, line) for i in ids])}
    assert got == {i: int(i != 2**63 - 1) for i in ids}


def test_lines_of_odd_and_empty_tables(spark):
    table = clashing(documents(spark, ODD))
    made = line_runs.dedup_lines(table, keep=("size", "score")).collect()
    assert {(r.doc_id, r.kept_text) for r in made} == {(i, t or "") for i, t, _ in ODD}
    assert all(r.size == r.score == "clash" and r.n_dropped == 0 for r in made)
    assert line_runs.dedup_lines(table.limit(0)).collect() == []
    renamed = table.select(F.col("doc_id").alias("n_lines"), "text")
    assert set(line_runs.dedup_lines(renamed, key="n_lines").columns) == {
        "n_lines", "_n_lines", "n_dropped", "kept_text",
    }


def test_a_text_of_many_dropped_lines(spark):
    lines = [f"line {k} of a long text which all of the documents repeat" for k in range(20_000)]
    rows = [(i, "\n".join(lines[i:] + ["own"])) for i in range(6)]
    got = deduped(spark, rows)
    assert got == dedup(rows)


def test_runs_hold_each_key_once_and_merge_by_level(spark):
    runs = line_runs.LineRuns(spark, fan_out=2)
    try:
        for batch in range(7):
            keys = [(k, 0, batch) for k in range(batch * 5, batch * 5 + 12)]
            runs.add(spark.createDataFrame(keys, "h1 long, h2 long, holder int"))
        assert [len(level) for level in runs.levels] == [1, 1, 1]
        held = {r.h1: r.holder for r in runs.read().collect()}
        assert runs.read().count() == len(held) == 42
        assert held == {k: 0 if k < 12 else (k - 7) // 5 for k in range(42)}
        plan = runs.read().select("h1", "h2").limit(1)
        assert plan.count() == 1
    finally:
        database = runs.database
        runs.close()
    assert not spark.catalog.databaseExists(database)


# Periodic runs


def plain_runs(w, least=12):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            part = w[s : s + n]
            if n >= max(least, 2 * p) and not any(
                all(part[k] == part[k + q] for k in range(n - q)) for q in range(1, p)
            ):
                out.append((s, n, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 14))
def test_automaton_finds_all_runs(w, least):
    found = periodic_runs.maximal_runs(w, least)
    assert sorted(found, key=lambda r: (r[0], r[2])) == plain_runs(w, least)


def run_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 4, 60]))}" for _ in range(rng.randrange(90))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randrange(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        out.append(rng.choice([" ", "\n", "\t \r"]).join(w))
    return out


def test_runs_equal_a_plain_loop(spark):
    texts = [*run_texts(5, 400), None, "", " ", "é ü " * 9]
    rows = [(k if k % 7 else None, t, "clash") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    made = periodic_runs.periodic_runs(table, keep=("doc_id", "text", "runs")).collect()
    assert len(made) == len(rows)
    for r in made:
        w = words(r.text)
        want = plain_runs(w)
        assert [tuple(x) for x in r["_runs"]] == want and r.n_words == len(w) and r.runs == "clash"
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.periodic_runs(table.limit(0)).collect() == []


def test_stretches_hold_all_runs():
    for seed in range(40):
        texts = run_texts(seed, 12)
        for _, _, data, offsets in periodic_runs.text_chunks(pa.array(texts)):
            found = periodic_runs.Tokenized(data, offsets, periodic_runs.BLANK)
            held = periodic_runs.stretches(found)
            for at, text in enumerate(texts):
                shift = int(found.first[at])
                for s, n, _ in plain_runs(text.split()):
                    assert any(a <= s + shift and s + shift + n <= b for a, b in held)


def test_a_very_long_run(spark):
    text = " ".join(f"w{i % 1000}" for i in range(200_000))
    made = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in made.runs] == [(0, 200_000, 1000)]
    assert made.collapsed == " ".join(f"w{i}" for i in range(1000))


def test_planted_runs_follow_the_id(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 50))) for k in range(300)] + [(None, "a b"), (5, None)]
    made = queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(made) == len(rows)
    for (i, text), r in zip(rows, made):
        want, h = text, zlib.crc32(str(i).encode())
        w = words(text)
        if i is not None and h % 10 == 0 and w:
            a, n = h // 10 % len(w), len(w)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            want = " ".join(w[k if k < a else a + (k - a) % p] for k in range(n))
        assert r.text == want


# Merkle manifest


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes, fan_out):
    """(root, for each leaf its list of (lefts, rights))."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k in range(len(paths)):
            first = at[k] // fan_out * fan_out
            family = hashes[first : first + fan_out]
            slot = at[k] - first
            paths[k].append(("".join(family[:slot]), "".join(family[slot + 1 :])))
            at[k] //= fan_out
        hashes = [sha(*hashes[k : k + fan_out]) for k in range(0, len(hashes), fan_out)]
    return hashes[0], paths


def plain_manifest(rows, fan_out):
    """rows (id, text, group) -> sorted (id, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for i, text, group in rows:
        groups[group].append((i is not None, i or 0, leaf_of((i, group, text)), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan_out) for g in names}
    root, tops = tree([made[g][0] for g in names], fan_out)
    out = []
    for g, top in zip(names, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1]):
            out.append((x[3], x[2], made[g][0], root, path + top))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_out,n", [(2, 45), (3, 100), (3, 1), (5, 33)])
def test_manifest_equals_a_plain_tree(spark, fan_out, n):
    rng = random.Random(n)
    names = ["a", "a", "a", None, "", "ä", "z", "Z"]
    rows = [
        (rng.choice([k, k // 2, None]), rng.choice(["text", "ü\n", None, ""]), rng.choice(names))
        for k in range(n)
    ]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    made = merkle_manifest.manifest(
        table.repartition(3), ("doc_id", "source", "text"), "source", "doc_id", fan_out=fan_out
    )
    checked = made.withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("path"))).collect()
    got = sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in checked), key=str
    )
    assert got == plain_manifest(rows, fan_out)
    assert all(r.again == r.root for r in checked)


def test_a_changed_row_is_told(spark):
    rows = [(k, f"text {k}", "a") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    other = merkle_manifest.row_digest(F.col("doc_id"), F.col("source"), F.lit("changed"))
    made = merkle_manifest.manifest(
        table, ("doc_id", "source", "text"), "source", "doc_id", {"other": other}
    )
    assert made.where(merkle_manifest.folded(F.col("other"), F.col("path")) == F.col("root")).isEmpty()


def test_manifest_of_an_empty_table_and_a_key_named_like_a_result(spark):
    empty = spark.createDataFrame([], "leaf long, text string, source string")
    made = merkle_manifest.manifest(empty, ("leaf", "text"), "source", "leaf")
    assert made.columns == ["leaf", "_leaf", "subroot", "root", "path"] and made.collect() == []
