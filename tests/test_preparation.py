"""Table and text preparation."""

import bz2
import gzip
import json
import zlib

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from hushmap.operators import prepare
from hushmap.sources import files, readers
from workload.fixtures import read


def test_chunks_rejoin_to_the_text(spark, sf):
    texts = read(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "é\n" * 1500), (-2, "")], "doc_id bigint, text string")
    texts = texts.unionByName(extra)
    chunks = prepare.chunk_text(texts).collect()
    joined = {}
    for row in sorted(chunks, key=lambda r: r.chunk):
        assert 0 < len(row.text) <= 1000
        joined[row.doc_id] = joined.get(row.doc_id, "") + row.text
    assert joined == {r.doc_id: r.text for r in texts.collect() if r.text}


def test_text_cap_is_exact(spark):
    df = spark.createDataFrame([("é" * 1_232_501,)], "text string")
    assert prepare.truncate_text(df).select(F.length("text")).first()[0] == 1_232_500


def test_count_sample_is_exact_and_repeatable(spark):
    values = spark.range(20_000).select(
        F.when(F.col("id") < 3, "small").when(F.col("id") < 10_000, "hot").otherwise("other")
        .alias("column_name"),
        F.col("id").alias("row_id"),
        F.col("id").cast("string").alias("value"),
    )
    first = prepare.sample_values(values, 250, seed=1).collect()
    again = prepare.sample_values(values.repartition(7), 250, seed=1).collect()
    other = prepare.sample_values(values, 250, seed=2).collect()
    assert sorted(first) == sorted(again) and sorted(first) != sorted(other)
    counts = {}
    for row in first:
        counts[row.column_name] = counts.get(row.column_name, 0) + 1
    assert counts == {"small": 3, "hot": 250, "other": 250}
    assert len(set(first)) == len(first)


def test_share_sample_is_near_its_share(spark):
    values = spark.range(20_000).select(
        F.lit("c").alias("column_name"), F.col("id").alias("row_id"), F.lit("v").alias("value")
    )
    assert abs(prepare.sample_values(values, 0.2).count() / 20_000 - 0.2) < 0.02
    assert prepare.sample_values(values, None).count() == 20_000


def plain_extract(record, key):
    found = []
    for name, value in record.items():
        if name == key:
            if isinstance(value, (str, int, float)):
                found.append(str(value))
        elif isinstance(value, dict):
            found += plain_extract(value, key)
        elif isinstance(value, list):
            for item in value:
                if isinstance(item, dict):
                    found += plain_extract(item, key)
    return found


RECORDS = [
    {"name": "a", "x": {"name": 1, "y": [{"name": "b", "z": [{"name": True}]}, {"name": None}]}},
    {"name": {"name": "hidden"}, "x": None, "w": [1, 2]},
    {"x": {"name": 2, "y": []}, "w": []},
]


@pytest.mark.parametrize("lines", [True, False])
def test_key_extraction_matches_a_recursive_walk(spark, tmp_path, lines):
    records = [r for r in RECORDS if not isinstance(r.get("name"), dict)]
    text = "\n".join(map(json.dumps, records)) if lines else json.dumps(records, indent=1)
    (tmp_path / "records.json").write_text(text)
    df = readers.read_json_records(spark, str(tmp_path))
    got = sorted(r.value for r in prepare.extract_key(df, "name").collect())
    assert got == sorted(v for r in records for v in plain_extract(r, "name"))


def test_matched_key_is_not_searched(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RECORDS[1]))
    df = readers.read_json_records(spark, str(tmp_path))
    assert prepare.extract_key(df, "name").count() == 0
    assert prepare.extract_key(df, "missing").count() == 0


def test_delimiter_detection(spark, tmp_path):
    for i, sep in enumerate([",", ";", "\t", "|"]):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"a{sep}b{sep}c\n1{sep}x,y{sep}3\n2{sep}z;z,z{sep}4\n" if sep != "," else
                        "a,b,c\n1,x;y,3\n2,z,4\n")
        assert readers.detect_delimiter(spark, str(path)) == sep
        assert readers.read_csv_auto(spark, str(path)).columns == ["a", "b", "c"]


def test_files_of_a_folder_are_read_each_by_its_own_form(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text("id,name\n1,x;y\n")
    (tmp_path / "b.csv").write_text('\ufeffname;id\r\n"p;q";2\r\n')
    (tmp_path / "c.csv").write_text("id|note|a.b\n3|z|w\n" + "4|long|" + "v" * 100_000 + "\n")
    (tmp_path / "d.csv").write_text("id\tname\nx5\tq\n")
    (tmp_path / "e.csv").write_text("")
    back = readers.read_csv_auto(spark, str(tmp_path))
    assert sorted(back.columns) == ["a.b", "id", "name", "note"]
    got = {r["id"]: (r["name"], r["note"], r["a.b"]) for r in back.collect()}
    assert got.pop("4") == (None, "long", "v" * 100_000)
    assert got == {
        "1": ("x;y", None, None), "2": ("p;q", None, None), "3": (None, "z", "w"), "x5": ("q", None, None),
    }
    heads = {r.path.rsplit("/", 1)[1]: r for r in readers.file_heads(spark, str(tmp_path)).collect()}
    assert len(heads) == 4 and len(heads["c.csv"].head) == readers.HEAD_BYTES
    assert readers._head("nostore://x/y", 10) is None


def test_json_forms_are_told_from_heads(spark, tmp_path):
    long = "v" * 70_000
    (tmp_path / "a.json").write_text(f'{{"x": "{long}"}}\n{{"x": "b"}}')
    (tmp_path / "b.json").write_text('\n\n{\n "x": "c"\n}')
    (tmp_path / "c.json").write_text('[{"x": "d"},\n{"x": "e"}]')
    (tmp_path / "d.json").write_text(" \n")
    got = sorted(r.x for r in readers.read_json_records(spark, str(tmp_path)).collect())
    assert got == ["b", "c", "d", "e", long]


def test_text_files_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_text("first\nsecond")
    (tmp_path / "sub" / "two.TXT").write_text("third")
    (tmp_path / "sub" / "image.bmp").write_text("x")
    docs = readers.read_text_documents(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.text, r.file_size) for r in docs if r.file_name != "image.bmp"} == {
        ("one.txt", "first\nsecond", 12), ("two.TXT", "third", 5),
    }
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.extension, r.accepted) for r in listed} == {
        ("one.txt", "txt", True), ("two.TXT", "txt", True), ("image.bmp", "bmp", False),
    }


def test_texts_of_a_mounted_folder_are_found_by_tasks(spark, tmp_path):
    for i in range(3_000):
        folder = tmp_path / f"sub {i % 7}" / "deep" if i % 2 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").write_text(f"text {i}\n")
    docs = readers.read_text_documents(spark, str(tmp_path))
    assert docs.inputFiles() == []  # else the driver holds them
    rows = docs.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.text for r in rows) == sorted(f"text {i}\n" for i in range(3_000))
    tasks = [r.task for r in rows]
    assert max(tasks) < 8 and max(tasks.count(t) for t in range(8)) < 500


def test_texts_of_a_mounted_folder_are_those_of_sparks_reader(spark, tmp_path):
    top = tmp_path / "top dir%20é"
    plain = [
        "a.txt", "no end", "per%cent.txt", "h#?[x]{y}.txt", "st*ar!~'()$.txt", 'q"<>^`|\\.txt', "é€😀\u00a0\u2028\x7f\n.txt",
        "_hidden.txt", ".hidden.txt", "x._COPYING_", "_metadata", "_k=v.txt", "_k=v/a.txt", "k=v/a.txt", "_sub/a.txt",
        ".sub/a.txt", "_metadata_sub/a.txt", "sub._COPYING_/a.txt", "dir.gz/a.txt", "s/u/b/a.txt",
    ]
    contents = {name: f"{name}\r\n".encode() for name in plain} | {
        "empty.txt": b"", "bad.txt": b"\xff\xfea\xc3", "bom.txt": b"\xef\xbb\xbfa\x00", "b.gz": gzip.compress(b"a") + gzip.compress(b"b"),
        "s/B.GZ": gzip.compress(b""), "c.gzip": gzip.compress(b"c"), "d.bz2": bz2.compress(b"d") + bz2.compress(b"e"),
        "f.deflate": zlib.compress(b"f"), "s/g h%.DEFLATE": zlib.compress(b"g"),
    }
    for name, content in contents.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "link.txt").symlink_to(top / "a.txt")
    (top / "broken.txt").symlink_to(tmp_path / "nowhere")
    (top / "linked").symlink_to(top / "s")

    def rows(docs):
        kept = docs.select("path", "file_name", "file_size", F.col("text").cast("binary"))
        return sorted((r[0], r[1], r[2], bytes(r[3])) for r in kept.collect())

    listed = rows(readers._listed_texts(spark, str(top), True))
    assert len(listed) == 25
    assert rows(readers.read_text_documents(spark, str(top))) == listed
    assert rows(readers.read_text_documents(spark, f"file:{top}/")) == listed
    assert readers.read_text_documents(spark, str(top / "s" / "*.GZ")).count() == 1
    assert readers.read_text_documents(spark, str(top / "a.txt")).count() == 1
    (tmp_path / "none").mkdir()
    assert readers.read_text_documents(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_text_documents(spark, str(tmp_path / "nowhere"))


def test_texts_that_cannot_be_read_fail_unless_spark_is_told_to_skip_them(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"b" * 1_000)[:20])
    with pytest.raises(PythonException, match="EOFError"):
        readers.read_text_documents(spark, str(tmp_path)).collect()
    try:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", True)
        docs = readers.read_text_documents(spark, str(tmp_path))
        assert [r.text for r in docs.collect()] == ["a"]
        gone = spark.createDataFrame([(bytes(tmp_path / name),) for name in ("a.txt", "gone.txt")], "path binary")
        with pytest.raises(PythonException, match="FileNotFoundError"):
            readers._mounted_texts(gone).collect()
        spark.conf.set("spark.sql.files.ignoreMissingFiles", True)
        assert [r.text for r in readers._mounted_texts(gone).collect()] == ["a"]
    finally:
        for kind in ("Corrupt", "Missing"):
            spark.conf.unset(f"spark.sql.files.ignore{kind}Files")


def test_routes(spark):
    names = ["a.csv", "b.XLSX", "c.json", "d.txt", "e.v1.pdf", "f.JPG", "g.exe", "csv"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r.file_name: r.route for r in files.route_files(df).collect()}
    assert [got[n] for n in names] == [
        "table", "table", "table", "text", "text", "image", "rejected", "rejected",
    ]


def test_cleaning_modes(spark):
    df = spark.createDataFrame(
        [(1, " a ", 5, True), (2, "\t", None, False)], "id int, s string, n int, b boolean"
    )
    def rows(mode):
        return {(r.id, r.column_name, r.value) for r in prepare.clean_values(df, mode, ["id"]).collect()}
    strings = {(1, "s", "a")}
    others = {(1, "n", "5"), (1, "b", "True"), (2, "b", "False")}
    assert rows("xlsx") == strings
    assert rows("json") == rows("csv") == strings | others


def test_long_documents_stay_one_row(spark):
    parts = spark.createDataFrame([("d", 70_000, "b"), ("d", 0, "a")], "doc string, id int, t string")
    assert [tuple(r) for r in prepare.combine_text(parts, "doc", "id", "t").collect()] == [("d", "a b")]


def test_small_shares_draw_rows(spark):
    values = spark.range(3_000_000).select(F.lit("c").alias("column_name"), F.col("id").alias("row_id"))
    assert 0 < prepare.sample_values(values, 5e-6).count() < 60
    assert prepare.sample_values(values, 1.0).count() == 3_000_000
    assert prepare.sample_values(values, 0.0).count() == 0


def test_stopwords_and_tokens(spark):
    df = spark.createDataFrame([("The bank, and its\nVoter-ID a b!",)], "text string")
    assert prepare.remove_stopwords(df).first().text == "bank , Voter - ID b !"
    assert [r.token for r in prepare.tokenize(df).collect()] == ["The", "bank,", "and", "its", "Voter-ID", "b!"]
    token = df.select(prepare.normalize_token(F.lit("D'As.-su_r,AncE"))).first()[0]
    assert token == "dassurance"


def test_csv_files_that_one_task_reads_are_bounded(spark, sf, tmp_path, monkeypatch):
    from workload import preparation
    from workload.registry import QUERIES

    def largest(path):
        return max(p.stat().st_size for p in path.glob("part-*"))

    monkeypatch.setattr(preparation, "scratch_path", lambda s, name: str(tmp_path / name))
    for name, rows in (("once", 150_000), ("more", 450_000)):
        back = spark.read.option("header", True).csv(
            preparation._csv_path(spark, spark.range(100_000, 100_000 + rows).coalesce(1), name, ";")
        )
        assert back.count() == rows
    assert largest(tmp_path / "more") < 2 * largest(tmp_path / "once")
    monkeypatch.setattr(preparation, "TEXTS_PER_FILE", 20)
    for name, path in (("s01_quoted_lines", "quoted"), ("s02_quoted_separator", "auto-quoted")):
        assert QUERIES[name](spark, sf).count() == 200
        assert len(list((tmp_path / path).glob("part-*"))) >= 10


def test_each_text_has_a_file_of_its_own(spark, tmp_path):
    from workload.preparation import TEXT_END, _write_each

    texts = ["one", "", None, "two\r\nlines\n", "﻿éñ " * 9, "one", TEXT_END]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    _write_each(rows, f"file:{tmp_path}/a folder")
    files = list((tmp_path / "a folder").iterdir())
    assert sorted(f.read_bytes().decode() for f in files) == sorted((t or "") + TEXT_END for t in texts)
    assert not [f for f in files if f.name.startswith((".", "_"))]


def test_records_of_one_file_are_dealt_out_to_many_tasks(spark):
    values = [f"v{i}" for i in range(4_000)]
    csv = "a,b\n" + "".join(f"{v},x\n" for v in values)
    lines = "\n".join(f'{{"a": {{"c": "{v}"}}, "b": ["x"]}}' for v in values)
    files = spark.createDataFrame([("t.csv", csv), ("t.json", lines)], "file_name string, text string")
    for name, column in (("t.csv", "a"), ("t.json", "a.c")):
        cells = prepare.file_cells(files.where(F.col("file_name") == name), ["file_name"])
        found = cells.where(F.col("column_name") == column).select("row_id", "value", F.spark_partition_id().alias("task"))
        rows = sorted(tuple(r) for r in found.collect())
        assert [r[:2] for r in rows] == list(enumerate(values))
        assert len({r[2] for r in rows}) > 2
        assert cells.count() == 2 * len(values)


def test_depth_of_brackets_is_kept_when_equal_neighbours_are_joined(spark):
    texts = {
        "": 0, "{}{}[]": 1, '{"a": {}, "b": [{}, {}]}': 3, "[[[[]]], {}]": 4, "}}{{": 2, "{{{": 3,
        '{"a": "[[[["}\n{"b": {"c": {"d": [1]}}}\n{': 4, "]{}]{}[": 1, "{}" * 9 + "{{" * 2: 4,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.depth for r in df.withColumn("depth", prepare._json_depth(F.col("text"))).collect()}
    assert got == texts
