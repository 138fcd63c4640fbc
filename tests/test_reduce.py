"""Labels, best hits and lookups."""

import json

import pytest
from pyspark.sql import functions as F

from hushmap.operators import detect, reduce
from hushmap.plans import jobs
from hushmap.rules import COLUMN_RULES, TEXT_RULES
from hushmap.sources.results import classifier_run, load_data_elements
from workload.fixtures import fixture

HIT = "row_id bigint, position int, nth int, entity string, score double, text string"


def test_summary_counts_add_up_to_the_hits(spark, sf):
    hits = detect.scan_values(fixture(spark, sf, "value_shapes"), ids=["kind", "row_id"]).cache()
    summary = reduce.summarize_hits(hits, ["kind"])
    total = sum(sum(r.detected_entities.values()) for r in summary.collect())
    assert total == hits.count() > 0


def test_ties_go_to_the_entity_seen_first(spark):
    hits = spark.createDataFrame(
        [(2, 0, 0, "A", 0.9, "a"), (1, 5, 0, "B", 0.9, "b"), (1, 7, 0, "C", 0.9, "c")], HIT
    ).withColumn("column_name", F.lit("x"))
    labels = reduce.label_by_count(hits, ["column_name"])
    row = labels.withColumn("order", F.map_keys("detected_entities")).first()
    assert (row.highest_label, row.confidence_score) == ("B", 0.33)
    assert row.order == ["B", "C", "A"]


def test_summary_prefers_score_among_equal_counts(spark):
    hits = spark.createDataFrame(
        [(1, 0, 0, "A", 0.8, "a"), (2, 5, 0, "B", 0.9, "b")], HIT
    ).withColumn("c", F.lit("x"))
    row = reduce.summarize_hits(hits, ["c"]).first()
    assert (row.highest_label, row.confidence_score) == ("B", 0.9)


def test_columns_without_hits_are_na(spark):
    hits = spark.createDataFrame([], HIT + ", column_name string")
    columns = spark.createDataFrame([("x",)], "column_name string")
    row = reduce.label_columns(hits, columns=columns).select("*", reduce.result_json().alias("j")).first()
    assert (row.highest_label, row.confidence_score, row.detected_entities) == ("NA", 0.0, {})
    assert json.loads(row.j) == {
        "highest_label": "NA", "confidence_score": 0.0, "detected_entities": "{ NA }",
    }


def test_row_labels_equal_labels_of_hits(spark, sf):
    texts = fixture(spark, sf, "values")
    ids = ["source", "row_id"]
    by_row = reduce.label_rows(texts, "value", COLUMN_RULES, ids)
    hits = detect.scan_values(texts, rules=COLUMN_RULES, ids=ids)
    by_hits = reduce.label_documents(hits, ids)

    def rows(labels):
        return sorted(
            (r.source, r.row_id, r.highest_label, r.confidence_score, r.json)
            for r in labels.withColumn("json", reduce.result_json()).collect()
        )

    assert rows(by_row) == rows(by_hits)


def test_best_hits(spark):
    hits = spark.createDataFrame(
        [(1, 0, 0, "A", 0.5, "low"), (2, 0, 0, "A", 0.9, "second"), (1, 3, 0, "A", 0.9, "first"),
         (1, 4, 0, "B", 0.4, "b")], HIT,
    )
    got = {(r.entity, r["count"], r.text, r.score) for r in reduce.best_hits(hits).collect()}
    assert got == {("A", 2, "first", 0.9), ("B", 1, "b", 0.4)}


def test_unknown_entities_are_registered_once(spark):
    lookup = load_data_elements(spark)
    found = spark.createDataFrame([("NEW",), ("NEW",), ("PAN",)], "entity string")
    registered = reduce.register_unknown(lookup, found)
    again = reduce.register_unknown(registered, found)
    assert registered.count() == again.count() == lookup.count() + 1
    rows = spark.createDataFrame([("NEW",), ("PAN",)], "detected_entity string")
    got = {tuple(r) for r in reduce.enrich(rows, registered).collect()}
    assert got == {("NEW", "UNKNOWN", "UNKNOWN"), ("PAN", "PERSONAL_IDENTIFICATION", "Medium")}


def test_scan_by_text_needs_one_rule_per_entity(spark):
    df = spark.createDataFrame([(1, "x")], "row_id int, value string")
    with pytest.raises(ValueError):
        reduce.scan_by_text(df, "value", TEXT_RULES.with_rules([("PAN", "x", 0.1)]))


def test_table_scan_samples_and_keeps_every_column(spark, sf):
    people = fixture(spark, sf, "people")
    lookup = load_data_elements(spark)
    full = jobs.scan_table(people, F.lit("t"), lookup, key="person_id").collect()
    part = jobs.scan_table(people, F.lit("t"), lookup, key="person_id", sample_size=5).collect()
    assert {r.column_name for r in full} == {r.column_name for r in part} == set(people.columns[1:])
    assert {r.column_name: r.detected_entity for r in full}["full_name"] == "PERSON"
    found = json.loads({r.column_name: r.json for r in part}["full_name"])
    assert found["detected_entities"] == {"PERSON": 5}


def test_documents_without_hits_store_nothing_unless_asked(spark):
    lookup = load_data_elements(spark)
    docs = spark.createDataFrame([("a", "nothing"), ("b", "call 555-123-4567")], "file_name string, text string")
    stored = jobs.scan_documents(docs, lookup, keys=["file_name"]).collect()
    kept = jobs.scan_documents(docs, lookup, keys=["file_name"], keep_empty=True).collect()
    assert [(r.file_name, r.detected_entity) for r in stored] == [("b", "PHONE_NUMBER")]
    assert {(r.file_name, r.detected_entity, r.data_element) for r in kept} == {
        ("a", "NA", "UNKNOWN"), ("b", "PHONE_NUMBER", "CONTACT_INFORMATION"),
    }


def test_runs_have_one_row_per_file_at_any_size(spark):
    reports = spark.range(12_000).select(
        F.lit(1).alias("customer_id"), F.format_string("f%05d.txt", "id").alias("file_name")
    )
    runs = classifier_run(reports, report=["file_name"])
    assert runs.count() == 12_000
    row = runs.orderBy("list_of_files").first()
    assert row.list_of_files == ["f00000.txt"]
    assert json.loads(row.json_output) == [{"file_name": "f00000.txt"}]


def test_two_stages(spark):
    hits = spark.createDataFrame(
        [(1, "PHONE NUMBER", "call 555-123-4567 or 555-123-4568", 0.7, 0, 10),
         (1, "COMPANY", "555-000-0000", 0.6, 20, 30)],
        "row_id int, entity string, text string, score double, start int, end int",
    )
    got = {tuple(r) for r in jobs.two_stage_scan(hits).collect()}
    assert got == {
        (1, 1, "PHONE NUMBER", "call 555-123-4567 or 555-123-4568", 0.7, 1),
        (1, 1, "COMPANY", "555-000-0000", 0.6, 1),
        (1, 2, "PHONE_NUMBER", "555-123-4567", 0.9, 2),
    }


def test_both_stages_come_from_one_scan(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "row_id int, entity string, text string, score double, start int, end int"
    rows = [(k, "PHONE NUMBER", f"call 555-123-{1000 + k}", 0.7, 0, 10) for k in range(20)]
    hits = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    assert jobs.two_stage_scan(hits).count() == 40
    assert read.value == 20


def test_labels_of_rows_scan_a_text_once_for_all_entities(spark):
    values = spark.createDataFrame([(1, "x")], "row_id int, value string")
    few = TEXT_RULES.only("GENDER", "TITLE", "ZIPCODE")
    rules = few.with_rules([("GENDER", "Mx", 0.5)])
    labels = reduce.label_rows(values, "value", rules, ["row_id"])
    hits = detect.scan_values(values, rules=rules)
    # Each pattern stands in both plans as often: where the text is tried, and where it is scanned.
    uses = [df._jdf.queryExecution().analyzed().toString().count("Mx") for df in (labels, hits)]
    assert uses[0] == uses[1] > 0
