"""Keyed replacement, derived tables, result tables and incremental passes."""

import pytest
from pyspark.sql import functions as F

from hushmap.plans import jobs
from hushmap.plans.views import VIEWS, register_views
from hushmap.schemas import TABLES
from hushmap.sources import catalog, results
from hushmap.streaming.incremental import (
    file_status,
    rejected_files,
    stream_scan,
    stream_scan_files,
    stream_upsert,
)
from workload.fixtures import fixture
from workload.scans import _docs

ROW = "id string, v int"


def rows(df):
    return ordered(map(tuple, df.collect()))


def ordered(found):
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


def test_upsert_replaces_keys_and_keeps_duplicates(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], ROW)
    batch = spark.createDataFrame([("b", 9), ("b", 9), ("c", 5)], ROW)
    once = catalog.upsert_by_key(target, batch, "id")
    assert rows(once) == [("a", 1), ("b", 9), ("b", 9), ("c", 5)]
    assert rows(catalog.upsert_by_key(once, batch, "id")) == rows(once)


def uploaded(spark, *drops):
    """Rows (upload, written, id, n)."""
    return spark.createDataFrame(list(drops), "_upload string, _written double, id string, n long")


def test_merged_uploads_replace_by_arrival(spark, tmp_path):
    table = catalog.UploadedRows(spark, str(tmp_path / "t"), "id", buckets=3)
    table.create(spark.createDataFrame([("a", 0), ("z", 0), (None, 0)], "id string, n long"))
    table.merge(uploaded(spark, ("u9", 1.0, "a", 1), ("u9", 1.0, "b", 1), ("u9", 1.0, "b", 2)), "s/0")
    table.merge(uploaded(spark, ("u10", 2.0, "a", 3), ("u8", 3.0, "c", 4), ("u10", 2.0, "c", 5)), "s/1")
    want = [("a", 3), ("b", 1), ("b", 2), ("c", 4), ("z", 0), (None, 0)]
    assert rows(table.read()) == ordered(want)
    # A merge that is run again replaces its own rows, a late part of an upload does not win.
    again = catalog.UploadedRows(spark, str(tmp_path / "t"), "id", buckets=99)
    again.merge(uploaded(spark, ("u10", 2.0, "a", 3), ("u8", 3.0, "c", 4), ("u10", 2.0, "c", 5)), "s/1")
    again.merge(uploaded(spark, ("u9", 9.0, "a", 7), ("u9", 9.0, "b", 8), ("u9", 9.0, None, 9)), "s/2")
    want += [("b", 8), (None, 9)]
    assert rows(again.read()) == ordered(want)
    again.merge(uploaded(spark), "s/3")
    assert rows(again.read()) == ordered(want)


def test_merges_rewrite_only_the_partitions_of_their_keys(spark, tmp_path):
    table = catalog.UploadedRows(spark, str(tmp_path / "t"), "id", buckets=16)
    table.create(spark.range(500).select(F.col("id").cast("string"), F.lit(0).alias("n")))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("t/_bucket=*/*.parquet")}
    table.merge(uploaded(spark, ("u", 1.0, "7", 1)), "s/0")
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("t/_bucket=*/*.parquet")}
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert len(changed) == 1 and table.read().count() == 500


def test_batches_are_checked_and_filled(spark):
    batch = spark.createDataFrame([(1, None, None), (None, "x", 2)], "id int, name string, n int")
    assert rows(catalog.clean_batch(batch, "table_entity")) == [("1", "NA", 0)]
    with pytest.raises(ValueError):
        catalog.clean_batch(batch, "other_entity")
    with pytest.raises(ValueError):
        catalog.clean_batch(batch, "profiler_data_time_series")
    with pytest.raises(ValueError):
        catalog.clean_batch(batch.limit(0), "table_entity")


def test_broken_json_is_rejected_not_lost(spark, sf):
    batch = fixture(spark, sf, "profiler_data_time_series")
    derived = catalog.derive_meta_info(batch, "profiler_data_time_series")
    rejected = catalog.rejected_rows(batch)
    assert derived.count() + rejected.count() == batch.count()
    assert rejected.count() > 0


def test_profile_without_or_with_bad_creation_time(spark):
    batch = spark.createDataFrame(
        [("a", "tableProfile", "{'rowCount': 3}"), ("b", "tableProfile", "{'createDateTime': 'x'}"),
         ("c", "other", "{}")],
        "entityFQNHash string, jsonSchema string, json string",
    )
    got = catalog.derive_profiler_metadata(batch).select("entityFQNHash", "rowCount", "createDateTime")
    assert rows(got) == [("a", 3.0, None)]


def test_stored_tables_have_the_declared_columns(spark, sf, tmp_path):
    column_rows = fixture(spark, sf, "column_ner_results").drop("id")
    results.append_column_results(column_rows, str(tmp_path / "columns"))
    results.append_column_results(column_rows, str(tmp_path / "columns"))
    stored = spark.read.parquet(str(tmp_path / "columns"))
    assert stored.schema.names == TABLES["column_ner_results"].names
    assert stored.count() == 2 * column_rows.count()
    assert stored.select("id").distinct().count() == stored.count()
    file_rows = fixture(spark, sf, "ner_unstructured_data").drop("id")
    results.append_file_results(file_rows, str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    assert set(files.columns) == set(TABLES["ner_unstructured_data"].names)
    pruned = files.filter(F.col("source_bucket") == "bucket-en")
    assert "PartitionFilters: [isnotnull(source_bucket" in pruned._jdf.queryExecution().toString()
    runs = results.classifier_run(
        file_rows.withColumn("customer_id", F.lit(3)), report=["file_name", "file_size"]
    )
    results.append_classifier_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).select("customer_id").distinct().count() == 1


def test_views_are_queryable_by_name(spark, sf):
    needed = {t for _, tables in VIEWS.values() for t in tables}
    names = register_views(spark, {t: fixture(spark, sf, t) for t in needed})
    assert sorted(names) == sorted(VIEWS) and len(names) == 19
    assert spark.sql("SELECT sum(sensitivity_count) AS n FROM structured_sensitivity").first().n > 0


def test_stream_scan_takes_each_file_once(spark, sf, tmp_path):
    docs = _docs(spark, sf)
    lookup = results.load_data_elements(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        stream_scan(spark, source, docs.schema, out, checkpoint, lookup).awaitTermination()

    docs.filter("file_size % 2 = 0").write.mode("append").parquet(source)
    run()
    docs.filter("file_size % 2 = 1").write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(out).drop("stream", "batch")
    assert rows(got) == rows(jobs.scan_documents(docs, lookup))


def test_stream_of_text_files(spark, tmp_path):
    lookup = results.load_data_elements(spark)
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for name, text in (("a.txt", "call 555-123-4567\nor 555-123-4568"), ("b.txt", "nothing"), ("c.exe", "555-123-4567")):
        (source / name).write_text(text)
        stream_scan_files(
            spark, str(source), out, checkpoint, lookup, "s3, lake", "bucket", "eu"
        ).awaitTermination()
    (row,) = spark.read.parquet(out).collect()
    assert (row.file_name, row.file_size, row.file_type, row.source, row.sub_service) == (
        "a.txt", 33, "TXT", "s3", "lake",
    )
    assert (row.detected_entity, row.data_element) == ("PHONE_NUMBER", "CONTACT_INFORMATION")


def test_stream_upsert_equals_batch_upsert(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], ROW)
    second = spark.createDataFrame([("b", 3), ("b", 4), ("c", 4)], ROW)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "t", "checkpoint"))
    table = catalog.UploadedRows(spark, target, "id")
    table.create(spark.createDataFrame([("a", 0), ("z", 0)], ROW))
    for n, batch in enumerate((first, second)):
        batch.repartition(2).write.parquet(f"{source}/{n}")
        for _ in range(2):
            stream_upsert(
                spark, source, first.schema, target, "id", checkpoint, max_files=1
            ).awaitTermination()
    assert rows(table.read()) == [("a", 1), ("b", 3), ("b", 4), ("c", 4), ("z", 0)]


def test_each_pass_over_a_flat_folder_is_an_upload(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in a", "t", "checkpoint"))
    for n in range(2):
        spark.createDataFrame([("a", n), ("b" if n else "c", n)], ROW).write.mode("append").parquet(source)
        stream_upsert(
            spark, source, spark.createDataFrame([], ROW).schema, target, "id", checkpoint
        ).awaitTermination()
    assert rows(catalog.UploadedRows(spark, target, "id").read()) == [("a", 1), ("b", 1), ("c", 0)]


def test_files_that_fail_are_listed_retried_and_left(spark, tmp_path):
    lookup = results.load_data_elements(spark)
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (source / "a [1].txt").write_text("call 555-123-4567")
    (source / "sub" / "a [1].txt").write_text("call 555-123-4568\ncall 555-123-4569")
    (source / "b.csv").write_bytes(b"x,y\n\xff,555-123-4567\n")
    (source / "c.json").write_bytes(b'{"x": "\xff"}')
    (source / "d.exe").write_bytes(b"\xff")
    (source / "e.json").write_text('{"x": "ABCPK1234Z"}\n{"x": ')

    def scanned():
        stream_scan_files(
            spark, str(source), out, checkpoint, lookup, "s3", "bucket", "eu", max_attempts=2
        ).awaitTermination()
        status = {
            r.path.rsplit("/in/")[-1]: (r.status, r.attempt) for r in file_status(spark, out).collect()
        }
        found = spark.read.parquet(out).select("file_name", "detected_entity", "file_size")
        return status, rows(found)

    status, found = scanned()
    good = [("a [1].txt", "PHONE_NUMBER", 17), ("a [1].txt", "PHONE_NUMBER", 35), ("e.json", "PAN", 26)]
    assert found == good
    assert status["b.csv"] == status["c.json"] == ("failed", 1)
    assert status["sub/a [1].txt"] == status["d.exe"] == ("done", 1)
    (error,) = file_status(spark, out).where("path LIKE '%b.csv'").select("error").collect()
    assert "no UTF-8 text" in error.error
    (source / "b.csv").write_text("x,y\nz,ABCPK1234Z\n")
    status, found = scanned()
    assert found == ordered([*good, ("b.csv", "PAN", 17)])
    assert status["b.csv"] == ("done", 2) and status["c.json"] == ("quarantined", 2)
    (source / "c.json").write_text('{"x": "ABCPK1234Z"}')
    assert scanned() == (status, found)
    rejected = {(r.file_name, r.route, r.row_id) for r in rejected_files(spark, out).collect()}
    assert rejected == {("d.exe", "rejected", None), ("e.json", "broken", 1)}


def test_repaired_file_does_not_pass_through_the_driver(spark, sf, monkeypatch):
    from workload import scans
    from workload.registry import QUERIES

    sent = []
    write = scans._written
    monkeypatch.setattr(scans, "_written", lambda s, path, body: (sent.append(len(body)), write(s, path, body)))
    rows = QUERIES["t01_failed_file"](spark, sf).collect()
    assert sorted(r.found for r in rows if r.file_name == "bad.parquet") == ["done", "failed"]
    assert sent == [len(b"no parquet at all")]
