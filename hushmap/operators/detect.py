"""Find pattern hits in values and texts, and read column names."""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.rules import COLUMN_RULES, NAME_RULES, Rule, Ruleset
from hushmap.rules.values import JAVA_FLAGS
from hushmap.schemas import SPAN_FIELDS

MAX_UTF8_BYTES = 4
# Fixed value: form of a printed result.
RESULT_LINE = r"type: ([A-Z_]+), start: (\d+), end: (\d+), score: ([\d.]+)"


def rule_matches(value: Column, rule: Rule, flags: str = "") -> Column:
    """All texts a rule finds in the value; null when a cheap test already rules it out."""
    found = F.regexp_extract_all(value, F.lit(rule.spark_regex(flags)), F.lit(rule.group))
    if rule.literals and not flags:
        return F.when(contains_any(value, rule.literals), found)
    return found


def contains_any(value: Column, literals: Iterable[str]) -> Column:
    gate = F.lit(False)
    for literal in literals:
        gate = gate | value.contains(literal)
    return gate


def value_hits(value: Column, rules: Ruleset) -> Column:
    """array<struct<position, entity, score, texts>> of the rules that hit, in rule order.

    Most values hit nothing. One alternation over the whole-value rules, tried on short values
    only, and one over the rules with known first characters tell so; their rules run singly
    where it found something.
    """
    groups = [
        _hits(value, placed, rules) if trial is None else F.when(trial, _hits(value, placed, rules))
        for trial, placed in _trials(value, rules)
    ]
    if len(groups) == 1:
        return groups[0]
    return F.sort_array(F.flatten(F.array_compact(F.array(*groups))))


def _trials(value: Column, rules: Ruleset) -> list[tuple[Column | None, list[tuple[int, Rule]]]]:
    """Groups of rules (with their positions), each with a test that tells when none hits.

    Rules of users are in a group without test.
    """
    placed = list(enumerate(rules.rules))
    whole = [(p, r) for p, r in placed if r.whole_value]
    inside = [(p, r) for p, r in placed if r.lead]
    own = [(p, r) for p, r in placed if not r.hinted]
    groups: list[tuple[Column | None, list[tuple[int, Rule]]]] = []
    if whole:
        # One more character, since $ also matches before a final line feed.
        longest = 1 + max(rule.max_length for _, rule in whole)
        short = F.octet_length(value) <= MAX_UTF8_BYTES * longest
        trial = value.rlike(f"{JAVA_FLAGS}{rules.flags}^(?:{_alternation(whole)})")
        groups.append((short & trial, whole))
    if inside:
        # A look at one character passes over nearly all places of a text.
        lead = "".join(rule.lead for _, rule in inside)
        trial = f"{JAVA_FLAGS}{rules.flags}(?=[{lead}])(?:{_alternation(inside)})"
        groups.append((value.rlike(trial), inside))
    groups += [(value.rlike(r.spark_regex(rules.flags)), [(p, r)]) for p, r in placed if r.search]
    if own:
        groups.append((None, own))
    return groups


def _alternation(placed: list[tuple[int, Rule]]) -> str:
    return "|".join(f"(?:{rule.trial})" for _, rule in placed)


def _hits(value: Column, placed: list[tuple[int, Rule]], rules: Ruleset) -> Column:
    per_rule = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(rule.entity).alias("entity"),
            F.lit(rule.score).alias("score"),
            rule_matches(value, rule, rules.flags).alias("texts"),
        )
        for position, rule in placed
    ]
    return F.filter(F.array(*per_rule), lambda hit: F.size(hit["texts"]) > 0)


def scan_values(
    df: DataFrame,
    col: str = "value",
    rules: Ruleset = COLUMN_RULES,
    ids: Sequence[str] = ("row_id",),
) -> DataFrame:
    """One row per hit: ids, position of the rule, entity, score, nth match, text.

    All rules run in one projection over the value, which is not carried into the hits.
    """
    per_rule = df.select(*ids, F.inline(value_hits(F.col(col), rules)))
    return per_rule.select(
        *ids, "position", "entity", "score", F.posexplode("texts").alias("nth", "text")
    )


def scan_first(
    df: DataFrame,
    col: str = "value",
    rules: Ruleset = COLUMN_RULES,
    ids: Sequence[str] = ("row_id",),
) -> DataFrame:
    """One row per value that hits: ids, and position, entity and score of its first rule.

    For each group of rules a chain of tests that ends with the first rule found, for labels by
    first entity. Only values in which a group finds anything enter its chain.
    """
    value = F.col(col)
    places = []
    for trial, placed in _trials(value, rules):
        place = None
        for position, rule in placed:
            test = _applies(value, rule, rules.flags)
            place = F.when(test, position) if place is None else place.when(test, position)
        places.append(place if trial is None else F.when(trial, place))
    place = F.least(*places) if len(places) > 1 else places[0]
    entities = F.array(*[F.lit(rule.entity) for rule in rules.rules])
    scores = F.array(*[F.lit(rule.score) for rule in rules.rules])
    # Exploding the one place keeps the chains from being copied into a filter. Functions of arrays
    # would have them interpreted.
    first = df.select(*ids, F.explode_outer(F.array(place)).alias("position")).where("position IS NOT NULL")
    return first.select(
        *ids,
        "position",
        F.get(entities, F.col("position")).alias("entity"),
        F.get(scores, F.col("position")).alias("score"),
    )


def _applies(value: Column, rule: Rule, flags: str) -> Column:
    found = value.rlike(rule.spark_regex(flags))
    if rule.whole_value:
        # One more character, since $ also matches before a final line feed.
        return (F.octet_length(value) <= MAX_UTF8_BYTES * (rule.max_length + 1)) & found
    if rule.literals and not flags:
        return contains_any(value, rule.literals) & found
    return found


def scan_spans(
    df: DataFrame,
    col: str = "text",
    rules: Ruleset = COLUMN_RULES,
    ids: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Hits (ids, entity, start, end, score, text) with their character offsets.

    A text that hits is split at the matches of the rule; the offset of a match is what the pieces
    and matches before it are long together. This is done for rules that hit, texts without hits
    cost what ``scan_values`` does. Rules that may match nothing, which no text can be split at,
    go through Python one by one.
    """
    empty = [rule for rule in rules.rules if rule.may_be_empty]
    if empty:
        others = replace(rules, rules=tuple(r for r in rules.rules if not r.may_be_empty))
        spans = _python_spans(df, col, replace(rules, rules=tuple(empty)), ids)
        return scan_spans(df, col, others, ids).unionByName(spans) if others.rules else spans
    value = F.col(col)
    regexes = F.array(*[F.lit(rule.spark_regex(rules.flags)) for rule in rules.rules])
    groups = F.array(*[F.lit(rule.group) for rule in rules.rules])
    hit = (
        df.select(
            F.struct(*ids).alias("ids"), value.alias("value"), F.explode_outer(value_hits(value, rules)).alias("hit")
        )
        .where("hit IS NOT NULL")
        .withColumn("regex", F.get(regexes, F.col("hit.position")))
    )
    # What a match holds before its group is passed over; nothing stands after it.
    matches = F.when(
        F.get(groups, F.col("hit.position")) > 0, F.regexp_extract_all("value", F.col("regex"), F.lit(0))
    ).otherwise(F.col("hit.texts"))
    sizes = F.transform(F.arrays_zip(F.split("value", F.col("regex")).alias("p"), matches.alias("m")), lambda x: (
        F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    ))
    placed = with_prefix_sums(hit.select("ids", "hit", sizes.alias("sizes")), "sizes", "ends")
    return placed.select("ids", "hit", "ends", F.posexplode_outer("hit.texts").alias("nth", "text")).select(
        *[F.col("ids").getField(c).alias(c) for c in ids],
        F.col("hit.entity").alias("entity"),
        (F.get("ends", F.col("nth")) - F.length("text")).cast("int").alias("start"),
        F.get("ends", F.col("nth")).cast("int").alias("end"),
        F.col("hit.score").alias("score"),
        "text",
    )


def with_prefix_sums(df: DataFrame, numbers: str, out: str, block: int = 64) -> DataFrame:
    """Add, for an array column, the array of the sums of its elements up to each element.

    Blocks are summed first, so an element adds the blocks before its own, whose sums are known,
    and less than one block of elements. Each step is a column that the next one uses twice, which
    keeps it from being copied into the step's inner function.
    """

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(i: Column, length: Column) -> Column:
        return F.slice(numbers, i * block + 1, length)

    count = F.ceil(F.size(numbers) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: total(part(i, F.lit(block))))
    before = F.transform("_blocks", lambda _, i: total(F.slice("_blocks", F.lit(1), i)))
    sums = F.transform(
        "_before",
        lambda b, i: F.transform(part(i, F.lit(block)), lambda _, k: b + total(part(i, k + 1))),
    )
    return (
        df.withColumn("_blocks", blocks)
        .withColumn("_before", before)
        .withColumn(out, F.flatten(sums))
        .drop("_blocks", "_before")
    )


def _python_spans(
    df: DataFrame, col: str, rules: Ruleset, ids: Sequence[str]
) -> DataFrame:
    patterns = [
        (rule.entity, rule.score, python_regex(rule, rules.flags), rule.group)
        for rule in rules.rules
    ]

    def spans(text: str) -> Iterator[tuple]:
        for entity, score, pattern, group in patterns:
            for match in pattern.finditer(text):
                yield entity, match.start(group), match.end(group), score, match.group(group)

    return _map_texts(df, col, ids, lambda texts: [list(spans(text)) for text in texts])


def python_regex(rule: Rule, flags: str = "") -> re.Pattern:
    inline = "(?m)" if rule.search else ""
    return re.compile(flags + inline + (rule.search or rule.regex))


def scan_with_model(
    df: DataFrame,
    col: str,
    factory: Callable[[], Callable[[list[str]], list[list[tuple]]]],
    ids: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Hits of a user model.

    ``factory`` is called once per worker process, which serves many tasks, and returns a function
    from a batch of texts to one list of (entity, start, end, score) per text; the hit text is cut
    from the input.
    """
    name = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def detect_all() -> Callable[[list[str]], list[list[tuple]]]:
        # A module of the process, as what is sent with a task does not outlive it.
        held = sys.modules.setdefault("_hushmap_models", types.ModuleType("_hushmap_models"))
        if not hasattr(held, name):
            setattr(held, name, factory())
        model = getattr(held, name)

        def detect(texts: list[str]) -> list[list[tuple]]:
            return [
                [(e, int(s), int(t), float(p), text[int(s) : int(t)]) for e, s, t, p in hits]
                for text, hits in zip(texts, model(texts), strict=True)
            ]

        return detect

    return _map_texts(df, col, ids, None, detect_all)


def _map_texts(
    df: DataFrame,
    col: str,
    ids: Sequence[str],
    detect: Callable[[list[str]], list[list[tuple]]] | None,
    prepare: Callable[[], Callable] | None = None,
) -> DataFrame:
    """Run a text-batch detector over Arrow batches and flatten its hits."""
    fields = [name for name, _ in SPAN_FIELDS]
    source = df.select(*ids, F.col(col).alias("_text")).filter(F.col("_text").isNotNull())
    spans = [T.StructField(name, data_type) for name, data_type in SPAN_FIELDS]
    schema = T.StructType(source.select(*ids).schema.fields + spans)
    id_names = source.columns[:-1]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = detect or prepare()
        for frame in frames:
            hits = run(frame["_text"].tolist())
            counts = [len(found) for found in hits]
            keys = frame[id_names].loc[frame.index.repeat(counts)].reset_index(drop=True)
            rows = pd.DataFrame([hit for found in hits for hit in found], columns=fields)
            yield pd.concat([keys, rows], axis=1)

    return source.mapInPandas(batches, schema)


def parse_result_lines(
    df: DataFrame, col: str = "line", ids: Sequence[str] = ()
) -> DataFrame:
    """Rows (ids, nth, entity, start, end, score) from 'type: X, start: 1, ...' lines."""

    def group(n: int) -> Column:
        return F.regexp_extract_all(F.col(col), F.lit(RESULT_LINE), F.lit(n))

    zipped = F.arrays_zip(
        group(1).alias("entity"),
        group(2).alias("start"),
        group(3).alias("end"),
        group(4).alias("score"),
    )
    return df.select(*ids, F.posexplode(zipped).alias("nth", "hit")).select(
        *ids,
        "nth",
        F.col("hit.entity").alias("entity"),
        F.col("hit.start").cast("bigint").alias("start"),
        F.col("hit.end").cast("bigint").alias("end"),
        F.col("hit.score").try_cast("double").alias("score"),
    )


def name_rule(name: Column) -> Column:
    """Place in NAME_RULES of the first column-name rule that matches, else null."""
    choice = None
    for place, rule in enumerate(NAME_RULES):
        test = name.rlike(f"(?diu){rule.regex}")
        choice = F.when(test, place) if choice is None else choice.when(test, place)
    return choice


def scan_column_names(
    names: DataFrame, col: str = "column_name", ids: Sequence[str] = ()
) -> DataFrame:
    """Names tagged Sensitive or NonSensitive, with the rule that decided; others are left out."""
    place = name_rule(F.col(col))
    # Exploding the one place (or none) keeps the rule chain from being copied into a filter.
    found = F.array_compact(F.array(place))
    rules = F.array(*[F.lit(rule.rule) for rule in NAME_RULES])
    tags = F.array(*[F.lit(rule.tag) for rule in NAME_RULES])
    return names.select(
        *ids, F.col(col).alias("column_name"), F.explode(found).alias("_place")
    ).select(
        *ids,
        "column_name",
        F.get(rules, F.col("_place")).alias("rule"),
        F.get(tags, F.col("_place")).alias("tag"),
        F.lit(1.0).alias("confidence"),
    )
