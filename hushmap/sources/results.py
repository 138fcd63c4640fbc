"""Lookup, result tables and report output."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.rules.elements import DATA_ELEMENTS
from hushmap.schemas import TABLES
from hushmap.session import local_table

CUSTOMER_BUCKETS = 256


def load_data_elements(spark: SparkSession) -> DataFrame:
    """Entity lookup (parameter_name, parameter_value, parameter_sensitivity)."""
    return local_table(
        spark,
        DATA_ELEMENTS,
        parameter_name=pa.string(),
        parameter_value=pa.string(),
        parameter_sensitivity=pa.string(),
    )


def stamped(df: DataFrame, table: str) -> DataFrame:
    """Columns of a stored table, with generated id and timestamps where they are missing."""
    defaults = {
        "id": F.uuid(),
        "created_at": F.current_timestamp(),
        "updated_at": F.current_timestamp(),
    }
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else defaults[f.name])
            .cast(f.dataType)
            .alias(f.name)
            for f in TABLES[table].fields
        ]
    )


def append_column_results(df: DataFrame, path: str) -> None:
    stamped(df, "column_ner_results").write.mode("append").parquet(path)


def append_file_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows partitioned by bucket; a shuffle first makes few files, and splits large buckets."""
    rows = stamped(df, "ner_unstructured_data").hint("rebalance", "source_bucket")
    rows.write.mode(mode).partitionBy("source_bucket").parquet(path)


def classifier_run(
    reports: DataFrame,
    customer: str = "customer_id",
    name: str = "file_name",
    report: Sequence[str] = ("file_name", "file_extension", "file_size", "results"),
) -> DataFrame:
    """Run rows (customer, list of one file, JSON list of its report), one per file.

    The form is the same at every size of a run. No customer is gathered; whoever wants one list per customer groups the rows they read.
    """
    body = F.concat(F.lit("["), F.to_json(F.struct(*report)), F.lit("]"))
    return reports.select(
        customer, F.array(name).alias("list_of_files"), body.alias("json_output")
    )


def append_classifier_runs(runs: DataFrame, path: str) -> None:
    """Rows partitioned by a bucket of the customer id; one folder each would be too many."""
    bucket = F.pmod(F.xxhash64("customer_id"), F.lit(CUSTOMER_BUCKETS))
    rows = stamped(runs, "instant_classifier").withColumn("customer_bucket", bucket)
    rows = rows.hint("rebalance", "customer_bucket")
    rows.write.mode("append").partitionBy("customer_bucket").parquet(path)


def write_reports_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
