"""Document classes against plain loops with the standard library."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from hushmap.operators import detect, documents, prepare
from hushmap.rules import DOCUMENT_CLASSES
from hushmap.rules.documents import EMAIL_PATTERN, PHONE_PATTERN
from workload.scans import _papers

TEXTS = [
    (1, "Passport India <<<< Passports Indya passprt PASSPORT UNITED kingdom states"),
    (2, "Government of India Aadhaar UIDAI unique identification authority 2345 6789 0123"),
    (3, "bank. b-a-n-k banks bnak account statement credit credits debit ifsc"),
    (4, ""),
    (5, "nothing to see here a@b.co +91 98765 43210 0123456789 a@b.co x.y+z@q-r.org"),
    (7, "1 2 3 4 5 "),
    (8, "\u0661\u0662\u0663-\u0661\u0662\u0663-\u0661\u0662\u0663\u0664 call"),
    (6, "P<GBRDOE<<JANE<<<<\n身份证 tel tels visa viza cvv cvw 4a) 9. <<"),
]


def plain_scores(text):
    words = [w for w in text.replace(" ", "\n").split("\n") if len(w) >= 2]
    normal = [re.sub(r"[.'\-_,]", "", w.lower()) for w in words]
    scores = {}
    for place, rule in enumerate(DOCUMENT_CLASSES):
        for keyword in rule.keywords:
            for word in normal:
                if SequenceMatcher(None, word, keyword.lower()).ratio() * 100 > 80:
                    scores[place] = scores.get(place, 0) + 1
    return scores


def test_keyword_scores_equal_all_pairs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id int, text string")
    got = {(r.doc_id, r.class_position): r.score for r in documents.keyword_scores(df).collect()}
    want = {(i, place): n for i, text in TEXTS for place, n in plain_scores(text).items()}
    assert got == want and len(want) > 30


def test_keyword_scores_equal_all_pairs_on_documents(spark, sf):
    papers = _papers(spark, sf).limit(10).cache()
    got = {(r.doc_id, r.class_position): r.score for r in documents.keyword_scores(papers).collect()}
    want = {
        (r.doc_id, place): n for r in papers.collect() for place, n in plain_scores(r.text).items()
    }
    assert got == want


def test_pair_tables_are_joined_alike_without_broadcast(spark):
    df = spark.createDataFrame(TEXTS, "doc_id int, text string")
    small = sorted(documents.keyword_scores(df).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(documents.keyword_scores(df).collect()) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_report(text):
    scores = plain_scores(text)
    best = max(range(len(DOCUMENT_CLASSES)), key=lambda place: scores.get(place, 0))
    score = scores.get(best, 0)
    found = [
        dict.fromkeys(m.group() for m in re.finditer(rule.regex, text))
        for rule in DOCUMENT_CLASSES
        if rule.has_identifier
    ]
    return (
        DOCUMENT_CLASSES[best].name if score >= 5 else None,
        score,
        DOCUMENT_CLASSES[best].region,
        list(next((f for f in found if f), [])),
        set(re.findall(EMAIL_PATTERN, text)),
        {p for groups in re.findall(PHONE_PATTERN, text) for p in groups if p},
    )


def test_reports_equal_a_plain_loop(spark, sf):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    df = df.unionByName(_papers(spark, sf).limit(8)).cache()
    got = {r.file_path: r for r in documents.document_report(df).collect()}
    for row in df.collect():
        report = got[row.doc_id]
        assert (
            report.pii_class,
            report.score,
            report.country_of_origin,
            report.identifiers,
            set(report.emails),
            set(report.phone_numbers),
        ) == plain_report(row.text)
        assert (report.faces, report.addresses) == (0, [])


def test_models_load_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[("X", 0, 1, 0.5)] for _ in texts]

    df = spark.range(400).select(F.col("id").alias("row_id"), F.lit("abc").alias("text")).repartition(40)
    for _ in range(2):
        assert detect.scan_with_model(df, "text", factory).count() == 400
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) <= 16


def test_cells_of_table_files(spark):
    files = spark.createDataFrame(
        [
            ("a.csv", 'x;y\n1;"two; with\nbreak"\n3;'),
            ("b.json", '[{"x": {"y": [1, null, "z"]}}, {"w": true}]'),
            ("c.JSON", '{"x": 1}\n\n{"x": 2}'),
            ("d.json", "{broken"),
            ("e.csv", ""),
            ("f.csv", None),
            ("g.exe", "x,y\n1,2"),
        ],
        "file_name string, text string",
    )
    got = prepare.table_cells(files, ["file_name"]).collect()
    assert sorted(map(tuple, got)) == sorted(
        [
            ("a.csv", "x", 0, "1"), ("a.csv", "y", 0, "two; with\nbreak"),
            ("a.csv", "x", 1, "3"), ("a.csv", "y", 1, ""),
            ("b.json", "x.y", 0, "1"), ("b.json", "x.y", 0, "z"), ("b.json", "w", 1, "True"),
            ("c.JSON", "x", 0, "1"), ("c.JSON", "x", 1, "2"),
        ]
    )


def test_broken_records_and_surplus_cells_are_kept(spark):
    long = "y" * 140_000
    files = spark.createDataFrame(
        [
            ("h.csv", 'a,b\n1,"q ""in"" q",surplus,"s, 2"\n5" disk,x" y\n"",z\n'),
            ("i.csv", 'a,b\n1,"open\n2,"fine, yes"\n3,x'),
            ("j.json", '{"a": "p\\"q\\\\", "e": {}, "t": [[{"k": "v"}]]}\n{"a": oops}\n{"a": 2} x\n{"a": 3}}'),
            ("k.json", '{\n "a": {"b": 1.5},\n "c": "x"\n}'),
            ("l.csv", "\ufeffname\r\nJohn\r\n"),
            ("m.csv", f'a,b\n"{long}",{long}\n'),
            ("n.json", '[1, "two", [3]]'),
        ],
        "`file.name` string, text string",
    )
    got = prepare.file_cells(files, ["file.name"], name="`file.name`").collect()
    good = sorted((f, "?" if c is None else c, r, v) for f, c, r, v, broken in got if not broken)
    assert good == [
        ("h.csv", "?", 0, "s, 2"), ("h.csv", "?", 0, "surplus"),
        ("h.csv", "a", 0, "1"), ("h.csv", "a", 1, '5" disk'), ("h.csv", "a", 2, ""),
        ("h.csv", "b", 0, 'q "in" q'), ("h.csv", "b", 1, 'x" y'), ("h.csv", "b", 2, "z"),
        ("i.csv", "a", 1, "2"), ("i.csv", "a", 2, "3"), ("i.csv", "b", 1, "fine, yes"),
        ("i.csv", "b", 2, "x"),
        ("j.json", "a", 0, 'p"q\\'), ("j.json", "t.k", 0, "v"),
        ("k.json", "a.b", 0, "1.5"), ("k.json", "c", 0, "x"),
        ("l.csv", "name", 0, "John"),
        ("m.csv", "a", 0, long), ("m.csv", "b", 0, long),
        ("n.json", "", 0, "1"), ("n.json", "", 1, "two"), ("n.json", "", 2, "3"),
    ]
    assert {(r[0], r.row_id, r.value) for r in got if r.broken} == {
        ("i.csv", 0, "1"), ("i.csv", 0, "open"),
        ("j.json", 1, "a"), ("j.json", 1, "oops"),
        ("j.json", 2, "a"), ("j.json", 2, "2} x"),
        ("j.json", 3, "a"), ("j.json", 3, "3"),
    }


def test_deep_json_is_kept(spark):
    deep = "[" * 80 + '"ABCPK1234Z"' + "]" * 80
    files = spark.createDataFrame([("a.json", f'{{"x": {deep}, "y": 1}}')], "file_name string, text string")
    got = {r.column_name: r.value for r in prepare.table_cells(files, ["file_name"]).collect()}
    assert got["y"] == "1" and "ABCPK1234Z" in got["x"]


def test_table_columns_of_any_name(spark):
    from hushmap.plans import jobs
    from hushmap.sources.results import load_data_elements

    df = spark.createDataFrame(
        [(1, "ABCPK1234Z", "ABCPK1234Z", "x"), (2, "ABCPK1234Z", "ABCPK1234Z", "x")],
        "`k.id` int, _row string, `a``b` string, `c.d` string",
    )
    found = jobs.scan_table(df, F.lit("t"), load_data_elements(spark), key="k.id", sample_size=2)
    assert {r.column_name: r.detected_entity for r in found.collect()} == {
        "_row": "PAN", "a`b": "PAN", "c.d": "NA",
    }


def test_scores_are_the_same_however_matched_tokens_are_joined(spark):
    texts = ["passport Passport PASSPORT. x", "pasport income tax tax", "", None, "- --", "india " * 50]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id int, text string")
    scores = [
        sorted(map(tuple, documents.keyword_scores(df, most_broadcast=most).collect())) for most in (0, 1000)
    ]
    assert scores[0] == scores[1] != []
    counts = documents.token_histogram(df).groupBy("token").agg(F.sum("n").alias("n")).collect()
    assert {r.token: r.n for r in counts} == {
        "passport": 3, "pasport": 1, "income": 1, "tax": 2, "india": 50, "": 1,
    }
