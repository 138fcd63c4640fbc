"""A training corpus from raw documents: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.llm import length_buckets, mixing, ngram_jaccard, quality_crf, quality_rules
from hushmap.llm.shared import count_words, if_few, stored, unused


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, stored with a number of their own, and the name of that column."""
    row = unused(docs, "_row_id")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def carried(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and whole rows in one column, whatever their columns' names."""
    return docs.select("doc_id", "text", F.struct(*columns(docs)).alias("_doc"))


def columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good.

    Null and empty texts score as the share of good documents in training. Repeated rows are
    judged alike, rows with null ids like all others; an empty table stays empty. All columns of
    ``docs`` stay as they are, also those named like results of the classifier.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_crf.score_quality(carried(docs), labels)
    return judged.where("predicted = 1").select("_doc.*")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have under 20 words and go. Repeated rows are judged alike; an empty
    table stays empty. All columns of ``docs`` stay as they are, also those named like results.
    """
    return quality_rules.quality_rules(carried(docs)).where("kept").select("_doc.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least id, null last.

    Rows are judged one by one, so those with null or repeated ids are compared like all others;
    of rows with equal ids the one read first stays. Null and empty texts are like no other row
    and stay. An empty table stays empty. All columns of ``docs`` stay as they are.
    """
    rows, row = numbered(docs)
    groups = stored(
        ngram_jaccard.similar_documents(rows, key=row).select(F.col(row).alias("_row"), "component_id")
    )
    ids = rows.select(F.col(row).alias("_row2"), "doc_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"]
    kept = stored(
        groups.join(ids, F.col("_row") == F.col("_row2"))
        .groupBy(F.col("component_id").alias("_component"))
        .agg(least.alias("_kept"), F.count(F.lit(1)).alias("_members"))
        .where("_members > 1")
    )
    other = unused(rows, "_other")
    others = stored(
        groups.join(kept, F.col("component_id") == F.col("_component"))
        .where("_row <> _kept")
        .select(F.col("_row").alias(other))
    )
    return rows.join(if_few(others), F.col(row) == F.col(other), "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, also those with null or repeated ids.

    Null and empty texts have size 0; a null source is a source. An empty table stays empty.
    All columns of ``docs`` stay as they are.
    """
    rows, row = numbered(docs)
    return mixing.emit(rows, mixing.mix(rows, row=row), row).drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in batches of like length; null and empty texts have length 0."""
    return length_buckets.pack_by_length(docs, count_words(F.col("text")))


STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The trained classifier and the choice of bucket bounds have no SQL; tests compare the stages
#: with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
