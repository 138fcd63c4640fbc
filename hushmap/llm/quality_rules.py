"""Quality rules as a short-circuit cascade, wholly in column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.llm.shared import count_words, unused, words

#: Words in a window whose repetition counts.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from the text column, a condition that is true for bad texts."""

    name: str
    rejects: Callable[[Column], Column]


def _share(text: Column, pattern: str) -> Column:
    """Characters that match per word."""
    bare = F.regexp_replace(text, pattern, "")
    n = F.greatest(count_words(text), F.lit(1))
    return (F.length(text) - F.length(bare)) / n


def _adjacent(text: Column) -> Column:
    """Share of words that repeat the word before them."""
    same = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))"))
    return same / F.greatest(count_words(text), F.lit(1))


#: Production rules beside the base test. Plain prose lies far from all of them.
RULES = (
    Rule("symbols", lambda t: _share(t, SYMBOLS) > 0.3),
    Rule("shouting", lambda t: _share(t, "!") > 0.5),
    Rule(
        "capitals",
        lambda t: (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) > 0.5 * F.length(t),
    ),
    Rule(
        "long_words",
        lambda t: F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]", "")) > 25 * count_words(t),
    ),
    Rule("stutter", lambda t: _adjacent(t) > 0.3),
)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts count 0 everywhere and fail for having under 20 words. Whatever columns
    ``df`` has stay; columns of these names are replaced. Windows are told apart by 64-bit
    hashes. A text whose windows all differ is done after one look at them; only for others the
    windows are sorted, so the work stays near-linear in the length of a text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = [unused(df, n) for n in ("_words", "_windows", "_pairs", "_places", "_lines")]
    w, h, p, at, each = map(F.col, names)
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - WINDOW + 1),
            lambda i: F.xxhash64(F.slice(w, i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(p, k - 1)["h"], F.get(p, k + 1)["h"]
        return before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"])

    places = F.sort_array(F.transform(F.filter(p, repeated), lambda x: x["i"]))
    covered = F.aggregate(
        F.transform(
            at,
            lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    # The second condition always holds. The optimizer does not move filters below a column like
    # this, where it would copy the nested expressions of the counts many times over.
    failed = (
        (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ) & (F.monotonically_increasing_id() >= 0)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        df.withColumn(names[0], words(F.col(text)))
        .withColumn(names[1], windows)
        .withColumn(names[2], pairs)
        .withColumn(names[3], places)
        .withColumn(names[4], lines)
        .withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": F.length(F.array_join(w, "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (
                    F.size(each) - F.size(F.array_distinct(each))
                ).cast("long"),
                "n_repeat_words": covered.cast("long"),
            }
        )
        .drop(*names)
        .withColumn("base_failed", failed)
    )


def measure(
    df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 256
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on the first ``sample_rows`` texts of the input.

    The sample only decides the order in which rules are tried. Every text passes through the
    same rules whatever the order, so no verdict depends on it.
    """
    rows = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).take(sample_rows)
    if not rows:
        return [(rule, 0.0, 0.0) for rule in rules]
    spark = df.sparkSession
    # The exchange keeps the optimizer from working the rules out while it plans.
    sample = spark.createDataFrame([(r["t"],) for r in rows], "t string").repartition(1)
    out = []
    for rule in rules:
        hit = sample.agg(F.avg(F.coalesce(rule.rejects(F.col("t")), F.lit(False)).cast("int")))
        share = hit.first()[0]  # compiles the code, too
        began = time.perf_counter()
        hit.first()
        out.append((rule, time.perf_counter() - began, float(share)))
    return out


def ordered(measured: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by share rejected per second, most first; ties by name."""
    return [
        rule
        for rule, _, _ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[0].name))
    ]


def cascade(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Add ``rejected_by``: the first rule, in the given order, that rejects the text, or null.

    CASE tries a rule only where those before it have passed. Null texts count as empty. A rule
    whose condition is null does not reject.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tried = reduce(
        lambda case, rule: case.when(rule.rejects(t), rule.name),
        rules[1:],
        F.when(rules[0].rejects(t), rules[0].name),
    ) if rules else F.lit(None).cast("string")
    return df.withColumn("rejected_by", tried)


def quality_rules(
    df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 256
) -> DataFrame:
    """Base counts, base verdict and ``kept``: neither the base test nor any rule rejects.

    The cascade starts with the base test, whose counts are asked for in any case, and goes on
    with the rules ordered by what a sample shows of their cost and selectivity. An empty table
    gives an empty result. Repeated rows are judged alike.
    """
    order = ordered(measure(df, rules, text, sample_rows))
    base = Rule("base", lambda t: F.col("base_failed"))
    judged = cascade(base_counts(df, text), [base, *order], text)
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("rejected_by")
