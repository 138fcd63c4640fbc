"""Whole scans: table columns, documents and customer uploads, from values to stored rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.functions.scalar import file_extension, human_size
from hushmap.operators.detect import scan_first, scan_values
from hushmap.operators.prepare import (
    file_cells,
    free_name,
    melt_columns,
    quoted,
    sample_values,
    strip_values,
)
from hushmap.operators.reduce import (
    NOT_FOUND,
    best_hits,
    enrich,
    label_by_count,
    label_rows,
    register_unknown,
    result_json,
    with_missing,
)
from hushmap.rules import COLUMN_RULES, TEXT_RULES, Ruleset
from hushmap.session import local_table, stored_once
from hushmap.sources.files import READ_AS
from hushmap.sources.results import classifier_run

# First-stage labels whose texts are scanned again by patterns.
RESCANNED_LABELS = (
    "AADHAAR NUMBER",
    "PHONE NUMBER",
    "BANK ACCOUNT NUMBER",
    "PAN NUMBER",
    "VOTER ID NUMBER",
)

FILE_COLUMNS = (
    "source_bucket",
    "file_name",
    "file_size",
    "file_type",
    "source",
    "sub_service",
    "region",
)


def scan_table(
    df: DataFrame,
    table_id: Column,
    lookup: DataFrame,
    key: str | None = None,
    columns: Sequence[str] | None = None,
    sample_size: int | float | None = None,
    rules: Ruleset = COLUMN_RULES,
    seed: int = 0,
) -> DataFrame:
    """Result rows (table_id, column_name, json, detected_entity, data_element) of a table.

    All columns are scanned in one job. ``key`` names a row key, which makes ties and samples
    repeatable; it is not scanned.
    """
    row, at = F.col(quoted(key)) if key else F.monotonically_increasing_id(), free_name(df, "_row")
    names = [c for c in (columns or df.columns) if c != key]
    values = strip_values(melt_columns(df.withColumn(at, row), names, ids=[at]))
    sampled = sample_values(values, sample_size, key=[at], seed=seed)
    hits = scan_first(sampled, rules=rules, ids=["column_name", at])
    expected = local_table(df.sparkSession, [(n,) for n in names], column_name=pa.string())
    labels = label_by_count(hits, ["column_name"], order=(at, "position"))
    labels = with_missing(labels, expected, ["column_name"])
    return _stored(labels, ["column_name"], lookup).select(
        table_id.alias("table_id"), "column_name", "json", "detected_entity", "data_element"
    )


def _stored(labels: DataFrame, keys: Sequence[str], lookup: DataFrame) -> DataFrame:
    rows = labels.select(
        *keys, result_json().alias("json"), F.col("highest_label").alias("detected_entity")
    )
    return enrich(rows, lookup)


def scan_documents(
    files: DataFrame,
    lookup: DataFrame,
    col: str = "text",
    keys: Sequence[str] = FILE_COLUMNS,
    rules: Ruleset = TEXT_RULES,
    keep_empty: bool = False,
) -> DataFrame:
    """Result rows of documents, one row of ``files`` each, with their file metadata.

    Files without hits store nothing unless ``keep_empty`` asks for NA rows.
    """
    keys = list(keys)
    labels = label_rows(files, col, rules, keys, keep_empty)
    return _stored(labels, keys, lookup).select(
        *keys, "json", "detected_entity", "data_element"
    )


def scan_files(
    files: DataFrame,
    lookup: DataFrame,
    col: str = "text",
    keys: Sequence[str] = FILE_COLUMNS,
    name: str = "file_name",
) -> tuple[DataFrame, DataFrame]:
    """(result rows, rejected files) of files of any format, each sent to the scan for its route.

    Texts go to the text scan. Tables are labelled by all entities over all their columns, cells
    beyond the header's width and the pieces of broken records included. Files of formats that
    no reader takes are returned with their keys and ``route`` 'rejected', broken records of tables
    with ``route`` 'broken' and their ``row_id``.
    """
    keys = list(keys)
    extension = file_extension(F.col(name))
    taken = F.coalesce(
        *[F.when(extension == kind, F.lit(route)) for kind, route in READ_AS.items()]
    )
    routed = files.withColumn("_route", F.when(F.col(name).contains("."), taken))
    texts = scan_documents(routed.filter("_route = 'text'"), lookup, col, keys)
    cells = file_cells(routed.filter("_route = 'table'"), keys, name, col)
    hits = scan_values(cells, "value", COLUMN_RULES, ids=[*keys, "column_name", "row_id"])
    labels = label_by_count(hits, keys, order=("row_id", "position"))
    tables = _stored(labels, keys, lookup).select(
        *keys, "json", "detected_entity", "data_element"
    )
    rejected = routed.filter("_route IS NULL").select(
        *keys, F.lit("rejected").alias("route"), F.lit(None).cast("long").alias("row_id")
    )
    broken = cells.where("broken").select(*keys, F.lit("broken").alias("route"), "row_id").distinct()
    return texts.unionByName(tables), rejected.unionByName(broken)


def register_seen(results: DataFrame, lookup: DataFrame) -> DataFrame:
    """Lookup with the entities of result rows that it did not have, under category UNKNOWN."""
    seen = results.filter(F.col("detected_entity") != NOT_FOUND)
    return register_unknown(lookup, seen, "detected_entity")


def file_reports(
    files: DataFrame,
    col: str = "text",
    keys: Sequence[str] = ("customer_id", "file_name", "file_size"),
    rules: Ruleset = TEXT_RULES,
) -> DataFrame:
    """Per file: name, extension, size as text, and label, confidence and entities."""
    keys = list(keys)
    labels = label_rows(files, col, rules, keys, keep_empty=True)
    others = [k for k in keys if k not in ("file_name", "file_size")]
    return labels.select(
        *others,
        "file_name",
        file_extension(F.col("file_name")).alias("file_extension"),
        human_size(F.col("file_size")).alias("file_size"),
        F.struct("highest_label", "confidence_score", "detected_entities").alias("results"),
    )


def classify_files(
    files: DataFrame,
    col: str = "text",
    customer: str = "customer_id",
    rules: Ruleset = TEXT_RULES,
) -> DataFrame:
    """Run rows of uploaded files: one per file, with its customer and its report."""
    reports = file_reports(files, col, [customer, "file_name", "file_size"], rules)
    return classifier_run(reports, customer)


def two_stage_scan(
    hits: DataFrame,
    keys: Sequence[str] = ("row_id",),
    labels: Sequence[str] = RESCANNED_LABELS,
    rules: Ruleset = TEXT_RULES,
    order: Sequence[str] = ("start", "end"),
) -> DataFrame:
    """First-stage hits, and the best pattern hits within the texts of chosen labels.

    Rows (keys, stage, entity, text, score, count); stage 1 repeats its input with count 1. The
    hits are stored first, since both stages read them and a second scan of the texts costs more.
    """
    keys = list(keys)
    hits = stored_once(hits.select(*dict.fromkeys([*keys, *order, "entity", "text", "score"])))
    first = hits.select(
        *keys,
        F.lit(1).alias("stage"),
        "entity",
        "text",
        "score",
        F.lit(1).cast("bigint").alias("count"),
    )
    chosen = hits.filter(F.col("entity").isin(list(labels))).select(*keys, *order, "text")
    again = scan_values(chosen, "text", rules, ids=[*keys, *order])
    second = best_hits(again, keys, order=[*order, "position", "nth"]).select(
        *keys, F.lit(2).alias("stage"), "entity", "text", "score", "count"
    )
    return first.unionByName(second)
