"""Reduce hits to one label, confidence and entity map per column, file or text.

Hits carry ``entity``, ``score``, ``text`` and the order keys ``row_id``, ``position`` (of the
rule) and ``nth`` (match of that rule); equal counts go to the entity seen first in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.functions.scalar import confidence
from hushmap.operators.detect import value_hits
from hushmap.rules import Ruleset
from hushmap.rules.elements import NOT_FOUND, UNKNOWN

NO_ENTITIES_TEXT = "{ NA }"


def entity_counts(
    hits: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id", "position")
) -> DataFrame:
    """Appearances, best score and first place of each entity per key.

    ``order`` is the rule position and one more column. Hits are first counted per rule, where
    the first place is a plain minimum that a hash aggregation can keep.
    """
    (other,) = [c for c in order if c != "position"]
    per_rule = hits.groupBy(*keys, "entity", "position").agg(
        F.count(F.lit(1)).alias("appearances"),
        F.max("score").alias("score"),
        F.min(other).alias(other),
    )
    return per_rule.groupBy(*keys, "entity").agg(
        F.sum("appearances").alias("appearances"),
        F.max("score").alias("score"),
        F.min(F.struct(*order)).alias("first_seen"),
    )


def _in_order_of_sight(entry: Column) -> Column:
    return F.sort_array(F.collect_list(entry))


def _entity_map() -> Column:
    """map<entity, appearances> in order of first sight."""
    entries = _in_order_of_sight(F.struct("first_seen", "entity", "appearances"))
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["entity"], e["appearances"]))
    )


def _leader(by: Sequence[str]) -> Column:
    """Entity row with the largest values of ``by``; the first seen wins ties."""
    ranked = F.sort_array(
        F.collect_list(F.struct(*[(-F.col(c)).alias(c) for c in by], "first_seen", "entity"))
    )
    return ranked[0]


def summarize_hits(
    hits: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id", "position")
) -> DataFrame:
    """Label with most appearances, then highest score; its best score; appearances per entity."""
    return (
        entity_counts(hits, keys, order)
        .groupBy(*keys)
        .agg(
            _leader(["appearances", "score"]).alias("_top"),
            _entity_map().alias("detected_entities"),
        )
        .select(
            *keys,
            F.col("_top.entity").alias("highest_label"),
            (-F.col("_top.score")).alias("confidence_score"),
            "detected_entities",
        )
    )


def label_by_count(
    hits: DataFrame, keys: Sequence[str], order: Sequence[str] = ("row_id", "position")
) -> DataFrame:
    """Label with most appearances; its share of all hits; appearances per entity."""
    return (
        entity_counts(hits, keys, order)
        .groupBy(*keys)
        .agg(
            _leader(["appearances"]).alias("_top"),
            F.sum("appearances").alias("_total"),
            _entity_map().alias("detected_entities"),
        )
        .select(
            *keys,
            F.col("_top.entity").alias("highest_label"),
            confidence(-F.col("_top.appearances"), F.col("_total")).alias("confidence_score"),
            "detected_entities",
        )
    )


def first_hits(hits: DataFrame, value_keys: Sequence[str]) -> DataFrame:
    """Entity, score and rule position of each value's first hit."""
    return (
        hits.groupBy(*value_keys)
        .agg(F.min(F.struct("position", "nth", "entity", "score")).alias("_first"))
        .select(*value_keys, "_first.position", "_first.entity", "_first.score")
    )


def label_rows(
    df: DataFrame,
    col: str,
    rules: Ruleset,
    ids: Sequence[str],
    keep_empty: bool = False,
) -> DataFrame:
    """Label by count over all entities of each row's text: one row in, one row out.

    All hits of a text come from its row, so nothing is shuffled. ``keep_empty`` gives texts
    without hits the label NA.
    """
    repeated = len(rules.entities) < len(rules.rules)
    # The hits are bound to a name, as each use of their expression would scan the text again.
    one = F.transform(
        F.array(value_hits(F.col(col), rules)),
        lambda hits: F.coalesce(_per_entity(hits, repeated), F.array().cast(ENTITY_ROWS)),
    )
    if not keep_empty:
        one = F.filter(one, lambda entities: F.size(entities) > 0)
    # Exploding one array of hits (or none) keeps the scan from being copied into a filter.
    counted = df.select(*ids, F.explode(one).alias("_entities"))
    total = F.aggregate("_entities", F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e["n"])
    entries = F.transform("_entities", lambda e: F.struct(e["entity"], e["n"]))
    return counted.select(
        *ids,
        F.array_max("_entities").alias("_top"),
        total.alias("_total"),
        F.map_from_entries(entries).alias("detected_entities"),
    ).select(
        *ids,
        F.coalesce("_top.entity", F.lit(NOT_FOUND)).alias("highest_label"),
        F.when(F.col("_total") == 0, F.lit(0.0))
        .otherwise(confidence(F.col("_top.n"), F.col("_total")))
        .alias("confidence_score"),
        "detected_entities",
    )


ENTITY_ROWS = "array<struct<n: bigint, place: int, entity: string>>"


def _per_entity(hits: Column, repeated: bool) -> Column:
    """Hits of one text as (n, -first position, entity), the largest being the label."""

    def counted(hit: Column) -> Column:
        return F.size(hit["texts"]).cast("bigint")

    def entity_row(n: Column, position: Column, entity: Column) -> Column:
        return F.struct(n.alias("n"), (-position).alias("place"), entity.alias("entity"))

    if not repeated:
        return F.transform(hits, lambda h: entity_row(counted(h), h["position"], h["entity"]))

    def merged(entity: Column) -> Column:
        own = F.filter(hits, lambda h: h["entity"] == entity)
        n = F.aggregate(own, F.lit(0).cast("bigint"), lambda sum_, h: sum_ + counted(h))
        return entity_row(n, F.array_min(F.transform(own, lambda h: h["position"])), entity)

    return F.transform(F.array_distinct(F.transform(hits, lambda h: h["entity"])), merged)


def label_columns(
    hits: DataFrame,
    keys: Sequence[str] = ("column_name",),
    value_keys: Sequence[str] = ("column_name", "row_id"),
    columns: DataFrame | None = None,
) -> DataFrame:
    """Column label by count over the first entity of each value.

    ``columns`` lists the columns that must have a result; those without hits get NA.
    """
    labels = label_by_count(first_hits(hits, value_keys), keys)
    return labels if columns is None else with_missing(labels, columns, keys)


def label_documents(
    hits: DataFrame,
    keys: Sequence[str] = ("file_name",),
    order: Sequence[str] = ("position", "nth"),
    files: DataFrame | None = None,
) -> DataFrame:
    """File label by count over all entities found in the file."""
    labels = label_by_count(hits, keys, order)
    return labels if files is None else with_missing(labels, files, keys)


def with_missing(labels: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without hits get the label NA, confidence 0 and an empty map."""
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<bigint>")
    )
    return expected.join(labels, list(keys), "left").select(
        *expected.columns,
        F.coalesce("highest_label", F.lit(NOT_FOUND)).alias("highest_label"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("detected_entities", empty).alias("detected_entities"),
    )


def result_json() -> Column:
    """A result as stored: label, confidence and entity counts."""
    head = (F.col("highest_label"), F.col("confidence_score"))
    found = F.to_json(F.struct(*head, F.col("detected_entities")))
    nothing = F.to_json(F.struct(*head, F.lit(NO_ENTITIES_TEXT).alias("detected_entities")))
    return F.when(F.col("highest_label") == NOT_FOUND, nothing).otherwise(found)


def best_hits(
    hits: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("row_id", "position", "nth"),
) -> DataFrame:
    """Per entity: the first text of the highest score, and the hits at that score."""
    at_score = hits.groupBy(*keys, "entity", "score").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("text", F.struct(*order)).alias("text"),
    )
    best = F.max_by(F.struct("count", "text", "score"), F.col("score"))
    return (
        at_score.groupBy(*keys, "entity")
        .agg(best.alias("_best"))
        .select(*keys, "entity", "_best.count", "_best.text", "_best.score")
    )


def hits_by_text(hits: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Per text and entity: number of matches, their texts in order, and the texts joined."""
    texts = F.transform(
        _in_order_of_sight(F.struct("position", "nth", "text")), lambda hit: hit["text"]
    )
    return (
        hits.groupBy(*keys, "entity")
        .agg(F.count(F.lit(1)).alias("count"), texts.alias("texts"))
        .withColumn("joined", F.array_join("texts", ", "))
    )


def scan_by_text(
    df: DataFrame, col: str, rules: Ruleset, ids: Sequence[str] = ("row_id",)
) -> DataFrame:
    """What ``hits_by_text`` gives, straight from the texts and without a shuffle.

    Needs a rule list in which no entity has two rules.
    """
    if len(rules.entities) < len(rules.rules):
        raise ValueError("an entity has several rules, use hits_by_text")
    return df.select(*ids, F.inline(value_hits(F.col(col), rules))).select(
        *ids,
        "entity",
        F.size("texts").cast("bigint").alias("count"),
        "texts",
        F.array_join("texts", ", ").alias("joined"),
    )


def results_json(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key one JSON object of entity -> score and appearances.

    ``summary`` has one row per key and entity, as ``entity_counts`` returns it.
    """
    entries = _in_order_of_sight(
        F.struct("entity", F.struct("score", "appearances").alias("found"))
    )
    body = F.struct(
        F.map_from_entries(entries).alias("entities"),
        F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        ).alias("sensitivity"),
    )
    return summary.groupBy(*keys).agg(F.to_json(body).alias("result"))


def enrich(
    results: DataFrame, lookup: DataFrame, entity: str = "detected_entity"
) -> DataFrame:
    """Add category (UNKNOWN when absent) and sensitivity ('' when absent) of the entity."""
    known = lookup.groupBy(F.col("parameter_value").alias(entity)).agg(
        F.min_by("parameter_name", F.col("parameter_name") == UNKNOWN).alias("data_element"),
        F.min_by("parameter_sensitivity", F.col("parameter_name") == UNKNOWN).alias(
            "parameter_sensitivity"
        ),
    )
    return results.join(known, entity, "left").select(
        *results.columns,
        F.coalesce("data_element", F.lit(UNKNOWN)).alias("data_element"),
        F.coalesce("parameter_sensitivity", F.lit("")).alias("parameter_sensitivity"),
    )


def register_unknown(lookup: DataFrame, entities: DataFrame, entity: str = "entity") -> DataFrame:
    """Lookup with each unseen entity added once, under category UNKNOWN."""
    unseen = (
        entities.select(F.col(entity).alias("parameter_value"))
        .distinct()
        .join(lookup, "parameter_value", "left_anti")
        .select(
            F.lit(UNKNOWN).alias("parameter_name"),
            "parameter_value",
            F.lit(UNKNOWN).alias("parameter_sensitivity"),
        )
    )
    return lookup.unionByName(unseen)
