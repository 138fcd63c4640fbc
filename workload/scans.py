"""Detection, reduction and jobs D, user rules and models U, incremental passes T."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushmap.operators import detect, documents, reduce
from hushmap.plans import jobs
from hushmap.rules import COLUMN_RULES, DOCUMENT_CLASSES, TEXT_RULES, Ruleset
from hushmap.rules.documents import EMAIL_PATTERN, NRIC, PHONE_PATTERN
from hushmap.session import scratch_path
from hushmap.sources.catalog import UploadedRows
from hushmap.sources.files import route_files
from hushmap.sources.results import load_data_elements
from hushmap.streaming.incremental import (
    file_status,
    rejected_files,
    stream_scan,
    stream_scan_files,
    stream_upsert,
)
from workload import oracle
from workload.fixtures import ctes, fixture, read, read_texts, sql_over, text
from workload.registry import query

_IDS = ["source", "row_id"]
_TABLE_KEY = ["kind", "row_id"]


def entity_list(entities: Column) -> Column:
    pairs = F.transform(
        F.map_entries(entities), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    )
    return F.array_join(pairs, "|")


def listed(labels):
    return labels.withColumn("entities", entity_list(F.col("detected_entities"))).drop(
        "detected_entities"
    )


def _shape_hits(spark, sf, rules: Ruleset = COLUMN_RULES):
    return detect.scan_values(fixture(spark, sf, "value_shapes"), rules=rules, ids=_TABLE_KEY)


def _corpus_hits(spark, sf, rules: Ruleset = TEXT_RULES):
    return detect.scan_values(fixture(spark, sf, "corpus"), rules=rules, ids=_IDS)


_SHAPES = ctes("value_shapes")
_CORPUS = ctes("corpus")
_SHAPE_HITS = f"hits AS ({oracle.column_hits('value_shapes', _TABLE_KEY)})"
_CORPUS_HITS = f"hits AS ({oracle.text_hits('corpus', _IDS)})"


@query("d01_scan_values_column", f"WITH {_SHAPES} {oracle.column_hits('value_shapes', _TABLE_KEY)}")
def _d01(spark, sf):
    return _shape_hits(spark, sf)


@query("d01_scan_values_text", f"WITH {_CORPUS} {oracle.text_hits('corpus', _IDS)}")
def _d01_text(spark, sf):
    return _corpus_hits(spark, sf)


@query("d02_scan_spans", f"WITH {_CORPUS} {oracle.spans(TEXT_RULES, 'corpus', _IDS)}")
def _d02(spark, sf):
    return detect.scan_spans(fixture(spark, sf, "corpus"), "value", TEXT_RULES, _IDS)


_OFFSET_RULES = COLUMN_RULES.only(
    "PERSON", "GENDER", "NATIONALITY", "POBOX", "PHONE_NUMBER", "TITLE", "DATE_TIME"
)


def _offset_sql() -> str:
    parts = []
    for rule in _OFFSET_RULES.rules:
        # Text before match i: the pieces up to it and the matches before it.
        parts.append(
            f"SELECT source, row_id, {text(rule.entity)} AS entity, unnest(list_transform("
            "range(len(m)), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i + 1], lambda s: "
            "length(s))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0) "
            "AS INT))) AS start, unnest(m) AS text FROM (SELECT source, row_id, "
            f"{oracle.matches(rule, 'column')} AS m, "
            f"regexp_split_to_array({oracle.MASK}, {text(_grouped_once(rule.regex))}) AS p "
            "FROM corpus) AS c"
        )
    return " UNION ALL ".join(parts)


def _grouped_once(regex: str) -> str:
    return re.sub(r"\((?!\?)", "(?:", regex)


@query("d02_span_offsets", f"WITH {_CORPUS} {_offset_sql()}")
def _d02_offsets(spark, sf):
    spans = detect.scan_spans(fixture(spark, sf, "corpus"), "value", _OFFSET_RULES, _IDS)
    return spans.select(*_IDS, "entity", "start", "text")


@query(
    "d03_summarize_hits",
    f"WITH {_SHAPES}, {_SHAPE_HITS}, counts AS (SELECT kind, entity, count(*) AS n, "
    "max(score) AS score, min(row(row_id, position)) AS seen FROM hits GROUP BY kind, entity), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, score DESC, seen) "
    "AS rn FROM counts), lists AS (SELECT kind, string_agg(entity || ':' || n, '|' ORDER BY seen) "
    "AS entities FROM counts GROUP BY kind) SELECT kind, entity AS highest_label, "
    "score AS confidence_score, entities FROM ranked JOIN lists USING (kind) WHERE rn = 1",
)
def _d03(spark, sf):
    return listed(reduce.summarize_hits(_shape_hits(spark, sf), ["kind"]))


_FIRST = (
    "firsts AS (SELECT kind, row_id, position, entity, score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY kind, row_id ORDER BY position, nth) AS r FROM hits) AS h WHERE r = 1)"
)


@query(
    "d04_label_columns",
    f"WITH {_SHAPES}, {_SHAPE_HITS}, {_FIRST}, {oracle.label_sql('firsts', ['kind'])}, "
    "kinds AS (SELECT DISTINCT kind FROM value_shapes) "
    "SELECT kind, coalesce(highest_label, 'NA') AS highest_label, "
    "coalesce(confidence_score, 0.0) AS confidence_score, coalesce(entities, '') AS entities "
    "FROM kinds LEFT JOIN labels USING (kind)",
)
def _d04(spark, sf):
    kinds = fixture(spark, sf, "value_shapes").select("kind").distinct()
    return listed(
        reduce.label_columns(_shape_hits(spark, sf), ["kind"], _TABLE_KEY, columns=kinds)
    )


@query(
    "d05_label_documents",
    f"WITH {_CORPUS}, {_CORPUS_HITS}, {oracle.label_sql('hits', _IDS, 'position, nth')} "
    "SELECT source, row_id, highest_label, confidence_score, entities FROM labels",
)
def _d05(spark, sf):
    return listed(reduce.label_documents(_corpus_hits(spark, sf), _IDS))


def _best_sql(source: str, keys: str, order: str) -> str:
    return (
        f"best AS (SELECT *, max(score) OVER (PARTITION BY {keys}, entity) AS top FROM {source}) "
        f"SELECT {keys}, entity, count(*) AS count, arg_min(text, row({order})) AS text, "
        f"max(score) AS score FROM best WHERE score = top GROUP BY {keys}, entity"
    )


_SCORED_RULES = COLUMN_RULES.with_rules(
    [("PHONE_NUMBER", PHONE_PATTERN, 0.5), ("PERSON", "John", 0.95)]
)


_DOUBLE_RULES = TEXT_RULES.with_rules([("PHONE_NUMBER", PHONE_PATTERN, 0.5)])


@query(
    "d05_label_rows",
    f"WITH {_CORPUS}, hits AS ({oracle.hits(_DOUBLE_RULES, 'corpus', _IDS)}), "
    f"{oracle.label_sql('hits', _IDS, 'position, nth')} "
    "SELECT source, row_id, coalesce(highest_label, 'NA') AS highest_label, "
    "coalesce(confidence_score, 0.0) AS confidence_score, coalesce(entities, '') AS entities "
    "FROM corpus LEFT JOIN labels USING (source, row_id)",
)
def _d05_rows(spark, sf):
    """Two rules for one entity, and texts without hits."""
    texts = fixture(spark, sf, "corpus")
    return listed(reduce.label_rows(texts, "value", _DOUBLE_RULES, _IDS, keep_empty=True))


@query(
    "d06_best_hits",
    f"WITH {_SHAPES}, hits AS ({oracle.hits(_SCORED_RULES, 'value_shapes', _TABLE_KEY)}), "
    + _best_sql("hits", "kind", "row_id, position, nth"),
)
def _d06(spark, sf):
    return reduce.best_hits(_shape_hits(spark, sf, _SCORED_RULES), ["kind"])


@query(
    "d07_extract_emails",
    f"WITH {_CORPUS} SELECT source, row_id, unnest(list_distinct(regexp_extract_all(value, "
    f"{text(EMAIL_PATTERN)}))) AS email FROM corpus",
)
def _d07(spark, sf):
    return documents.extract_emails(fixture(spark, sf, "corpus"), "value", _IDS)


@query(
    "d08_extract_phones",
    f"WITH {_CORPUS} SELECT source, row_id, unnest(list_distinct(list_filter(list_concat("
    f"regexp_extract_all(value, {text(PHONE_PATTERN)}, 1), "
    f"regexp_extract_all(value, {text(PHONE_PATTERN)}, 2)), lambda p: p <> ''))) AS phone "
    "FROM corpus",
)
def _d08(spark, sf):
    return documents.extract_phones(fixture(spark, sf, "corpus"), "value", _IDS)


def _identifier_sql(exclude: tuple[str, ...] = ()) -> str:
    return " UNION ALL ".join(
        f"SELECT source, row_id, {place} AS class_position, {text(c.name)} AS class, "
        f"unnest(list_distinct(regexp_extract_all(value, {text(c.regex)}))) AS identifier "
        "FROM corpus"
        for place, c in enumerate(DOCUMENT_CLASSES)
        if c.has_identifier and c.name not in exclude
    )


@query("d09_extract_identifiers", f"WITH {_CORPUS} {_identifier_sql()}")
def _d09(spark, sf):
    return documents.extract_identifiers(fixture(spark, sf, "corpus"), "value", _IDS)


@query("d09_extract_identifiers_strict", f"WITH {_CORPUS} {_identifier_sql((NRIC,))}")
def _d09_strict(spark, sf):
    return documents.extract_identifiers(fixture(spark, sf, "corpus"), "value", _IDS, [NRIC])


# Texts that speak of papers: each document gets some words of the class list appended.
_KEYWORDS = [
    (place, rule.name, keyword.lower())
    for place, rule in enumerate(DOCUMENT_CLASSES)
    for keyword in rule.keywords
]
_WORDS = sorted({w for _, _, k in _KEYWORDS for w in k.split(" ") if w.isascii()})
_WORD_LIST = ", ".join(text(w) for w in _WORDS)


def _pick(step: int) -> str:
    return (
        f"element_at(array({_WORD_LIST}), CAST((doc_id * {step}) % {len(_WORDS)} AS INT) + 1)"
    )


def _pick_duck(step: int) -> str:
    return f"[{_WORD_LIST}][(doc_id * {step}) % {len(_WORDS)} + 1]"


_STEPS = (1, 3, 7, 11, 13, 17, 19, 23)


def _papers(spark, sf):
    picks = " || ' ' || ".join(_pick(step) for step in _STEPS)
    extra = f"CASE doc_id % 3 WHEN 0 THEN ' ' || {picks} WHEN 1 THEN ' Passport India <<<< " \
        "Passports of Indya: PAN, tax income permanent' ELSE '' END"
    return read_texts(spark, sf).selectExpr("doc_id", f"text || {extra} AS text")


_PAPERS_SQL = (
    "papers AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' ' || "
    + " || ' ' || ".join(_pick_duck(step) for step in _STEPS)
    + " WHEN 1 THEN ' Passport India <<<< Passports of Indya: PAN, tax income permanent' "
    "ELSE '' END AS text FROM documents)"
)
_KEYWORD_ROWS = ", ".join(f"({p}, {text(c)}, {text(k)})" for p, c, k in _KEYWORDS)
_SCORES_SQL = (
    f"WITH {_PAPERS_SQL}, tokens AS (SELECT doc_id, translate(lower(t), '.''-_,', '') AS token "
    "FROM (SELECT doc_id, unnest(list_filter(string_split(replace(text, ' ', chr(10)), chr(10)), "
    "lambda x: length(x) >= 2)) AS t FROM papers) AS u), "
    f"keywords AS (SELECT * FROM (VALUES {_KEYWORD_ROWS}) AS k(class_position, class, keyword)), "
    "scores AS (SELECT doc_id, class_position, class, count(*) AS score FROM tokens "
    "JOIN keywords ON token = keyword GROUP BY doc_id, class_position, class)"
)


def _longest_block(a: str, b: str) -> str:
    """The longest text in both, first in ``a``, as {k: length, i: place in a}."""
    return (
        f"list_filter(flatten(list_transform(range(least(length({a}), length({b})), 0, -1), lambda k: "
        f"list_transform(range(1, length({a}) - k + 2), lambda i: {{'k': k, 'i': i}}))), "
        f"lambda m: strpos({b}, substr({a}, m.i, m.k)) > 0)[1]"
    )


# Matching blocks of a token and a keyword, as the ratio of their similarity counts them: the
# longest one, and in turn those to its left and to its right. Few pairs have an edit distance
# that allows for the ratio; distances may count bytes, of which a character has up to four.
_BLOCKS = f"""
candidates AS (
  SELECT token, keyword FROM (SELECT DISTINCT token FROM tokens) t
  JOIN (SELECT DISTINCT keyword FROM keywords) k ON levenshtein(token, keyword) <=
    (length(token) + length(keyword) - 1) // 5 *
    CASE WHEN strlen(token) = length(token) AND strlen(keyword) = length(keyword) THEN 1 ELSE 4 END),
blocks AS (
  SELECT token, keyword, token AS a, keyword AS b, {_longest_block("token", "keyword")} AS m FROM candidates
  UNION ALL
  SELECT token, keyword, x.a, x.b, {_longest_block("x.a", "x.b")} FROM (
    SELECT token, keyword, unnest([
      {{'a': left(a, m.i - 1), 'b': left(b, strpos(b, substr(a, m.i, m.k)) - 1)}},
      {{'a': substr(a, m.i + m.k), 'b': substr(b, strpos(b, substr(a, m.i, m.k)) + m.k)}}]) AS x
    FROM blocks WHERE m IS NOT NULL) WHERE x.a <> '' AND x.b <> ''),
near AS (
  SELECT token, keyword FROM blocks GROUP BY token, keyword
  HAVING 2.0::DOUBLE * sum(m.k) / (length(token) + length(keyword)) * 100 > 80)"""
_FUZZY_SQL = (
    _SCORES_SQL.split("scores AS (")[0].replace("WITH ", "WITH RECURSIVE ", 1)
    + f"{_BLOCKS}, scores AS (SELECT doc_id, class_position, class, count(*) AS score FROM tokens "
    "JOIN near USING (token) JOIN keywords USING (keyword) GROUP BY doc_id, class_position, class)"
)


@query("d10_keyword_scores", f"{_FUZZY_SQL} SELECT * FROM scores")
def _d10(spark, sf):
    return documents.keyword_scores(_papers(spark, sf))


@query("d10_keyword_scores_exact", f"{_SCORES_SQL} SELECT * FROM scores")
def _d10_exact(spark, sf):
    return documents.keyword_scores(_papers(spark, sf), exact=True)


_REGION_ROWS = ", ".join(
    f"({p}, {text(c.region) if c.region else 'NULL'})" for p, c in enumerate(DOCUMENT_CLASSES)
)


@query(
    "d11_classify_documents",
    f"{_SCORES_SQL}, regions AS (SELECT * FROM (VALUES {_REGION_ROWS}) AS r(class_position, "
    "country_of_origin)), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "
    "score DESC, class_position) AS rn FROM scores) SELECT doc_id, CASE WHEN score >= 5 THEN "
    "class END AS pii_class, score, country_of_origin FROM best JOIN regions USING "
    "(class_position) WHERE rn = 1",
)
def _d11(spark, sf):
    return documents.classify_documents(documents.keyword_scores(_papers(spark, sf), exact=True))


def _in_order(values: str) -> str:
    """Distinct elements of a list, in order, as one text."""
    return (
        f"array_to_string(list_filter({values}, lambda x, i: list_position({values}, x) = i), '|')"
    )


_FOUND_SQL = ", ".join(
    f"nullif(regexp_extract_all(text, {text(c.regex)}), [])" for c in DOCUMENT_CLASSES if c.has_identifier
)
_PHONES_SQL = (
    f"list_filter(list_concat(regexp_extract_all(text, {text(PHONE_PATTERN)}, 1), "
    f"regexp_extract_all(text, {text(PHONE_PATTERN)}, 2)), lambda p: p <> '')"
)


@query(
    "d12_document_report",
    f"{_FUZZY_SQL}, regions AS (SELECT * FROM (VALUES {_REGION_ROWS}) AS r(class_position, "
    "country_of_origin)), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score "
    "DESC, class_position) AS rn FROM scores), found AS (SELECT doc_id, text, "
    f"coalesce({_FOUND_SQL}, []) AS ids, regexp_extract_all(text, {text(EMAIL_PATTERN)}) AS mails, "
    f"{_PHONES_SQL} AS phones FROM papers) "
    "SELECT f.doc_id AS file_path, CASE WHEN score >= 5 THEN class END AS pii_class, "
    "coalesce(score, 0) AS score, country_of_origin, 0 AS faces, "
    f"{_in_order('ids')} AS identifiers, {_in_order('mails')} AS emails, "
    f"{_in_order('phones')} AS phone_numbers, '' AS addresses FROM found f "
    "LEFT JOIN best b ON b.doc_id = f.doc_id AND rn = 1 LEFT JOIN regions USING (class_position)",
)
def _d12(spark, sf):
    report = documents.document_report(_papers(spark, sf))
    lists = ("identifiers", "emails", "phone_numbers", "addresses")
    return report.withColumns({c: F.array_join(c, "|") for c in lists})


@query(
    "d13_enrich",
    f"WITH {_CORPUS}, {ctes('data_element')}, {_CORPUS_HITS}, "
    f"{oracle.label_sql('hits', _IDS, 'position, nth')} "
    "SELECT source, row_id, highest_label, coalesce(parameter_name, 'UNKNOWN') AS data_element, "
    "coalesce(parameter_sensitivity, '') AS parameter_sensitivity FROM labels LEFT JOIN "
    "data_element ON parameter_value = highest_label",
)
def _d13(spark, sf):
    labels = reduce.label_documents(_corpus_hits(spark, sf), _IDS)
    rows = labels.select(*_IDS, "highest_label")
    return reduce.enrich(rows, load_data_elements(spark), "highest_label")


@query(
    "d13_register",
    f"WITH {_SHAPES}, {ctes('data_element')}, {_SHAPE_HITS}, "
    f"{oracle.label_sql('hits', ['kind'], 'row_id, position, nth')} "
    "SELECT parameter_name, parameter_value, parameter_sensitivity FROM data_element UNION ALL "
    "SELECT DISTINCT 'UNKNOWN', highest_label, 'UNKNOWN' FROM labels WHERE highest_label <> 'NA' "
    "AND highest_label NOT IN (SELECT parameter_value FROM data_element)",
)
def _d13_register(spark, sf):
    """Entities of a scan's results that the lookup did not have are added to it."""
    labels = reduce.label_by_count(_shape_hits(spark, sf), ["kind"])
    found = labels.select(F.col("highest_label").alias("detected_entity"))
    return jobs.register_seen(found, load_data_elements(spark))


def _mixed_files(spark, sf):
    """Tables as CSV and JSON texts, plain texts, and files that no reader takes."""
    rows = fixture(spark, sf, "value_shapes")
    quoted = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))
    listed = F.sort_array(F.collect_list(F.struct("row_id", "line")))
    as_csv = F.concat(F.lit("note,value\n,"), F.array_join(F.transform("l", lambda x: x["line"]), "\n,"))
    as_json = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    tables = [
        rows.withColumn("line", line).groupBy("kind").agg(listed.alias("l")).select(
            F.concat("kind", F.lit(ending)).alias("file_name"), body.alias("text")
        )
        for line, ending, body in (
            (quoted, ".csv", as_csv),
            (F.to_json(F.struct(F.struct("value").alias("inner"))), ".json", as_json),
        )
    ]
    texts = fixture(spark, sf, "corpus").where("source = 'documents'").select(
        F.concat(F.lit("d"), "row_id", F.lit(".txt")).alias("file_name"), F.col("value").alias("text")
    )
    others = texts.select(F.replace("file_name", F.lit(".txt"), F.lit(".exe")).alias("file_name"), "text")
    return reduce_union([*tables, texts, others])


def reduce_union(frames):
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


@query(
    "d15_table_files",
    f"WITH {_SHAPES}, {_SHAPE_HITS}, "
    f"{oracle.label_sql('hits', ['kind'], 'row_id, position, nth')} "
    "SELECT kind || ending AS file_name, highest_label AS detected_entity, "
    "CAST(confidence_score AS DOUBLE) AS confidence FROM labels, (VALUES ('.csv'), ('.json')) e(ending)",
)
def _d15_tables(spark, sf):
    found, _ = jobs.scan_files(_mixed_files(spark, sf), load_data_elements(spark), keys=["file_name"])
    confidence = F.get_json_object("json", "$.confidence_score").cast("double")
    return found.where("NOT file_name LIKE '%.txt'").select(
        "file_name", "detected_entity", confidence.alias("confidence")
    )


@query(
    "d19_dispatch",
    f"WITH {_CORPUS}, docs AS (SELECT 'd' || row_id || '.txt' AS file_name, value FROM corpus "
    "WHERE source = 'documents'), "
    f"hits AS ({oracle.text_hits('docs', ['file_name'])}), "
    f"{oracle.label_sql('hits', ['file_name'], 'position, nth')} "
    "SELECT file_name, highest_label AS outcome FROM labels UNION ALL "
    "SELECT replace(file_name, '.txt', '.exe'), 'rejected' FROM docs",
)
def _d19_dispatch(spark, sf):
    """Texts are scanned as texts; what no reader takes is returned as rejected."""
    found, rejected = jobs.scan_files(
        _mixed_files(spark, sf), load_data_elements(spark), keys=["file_name"]
    )
    return found.where("file_name LIKE '%.txt'").select(
        "file_name", F.col("detected_entity").alias("outcome")
    ).unionByName(rejected.select("file_name", F.col("route").alias("outcome")))


_SURPLUS, _LONG = "ABCPK1234Z", "y" * 140_000
_BROKEN_FILES_SQL = (
    f"WITH {_SHAPES}, one AS (SELECT kind || '.csv' AS file_name, row_id, "
    "replace(value, chr(10), ' ') AS value FROM value_shapes UNION ALL "
    "SELECT kind || '.json', row_id, value FROM value_shapes UNION ALL "
    f"SELECT DISTINCT kind || '.csv', 1000000000000001, '{_SURPLUS}' FROM value_shapes UNION ALL "
    "SELECT DISTINCT kind || '.csv', 1000000000000002, repeat('y', 140000) FROM value_shapes), "
    f"hits AS ({oracle.column_hits('one', ['file_name', 'row_id'])}), "
    f"{oracle.label_sql('hits', ['file_name'], 'row_id, position, nth')} "
    "SELECT file_name, highest_label AS outcome, CAST(confidence_score AS DOUBLE) AS confidence, "
    "NULL::BIGINT AS row_id FROM labels UNION ALL "
    "SELECT DISTINCT kind || ending, 'broken', NULL::DOUBLE, 0 FROM value_shapes, "
    "(VALUES ('.csv'), ('.json')) e(ending)"
)


def broken_files(spark, sf):
    """Tables as CSV and JSON texts whose first record is broken; the CSV texts also have a hit
    beyond the header's width and a very long cell."""
    rows = fixture(spark, sf, "value_shapes")
    flat = F.replace("value", F.lit("\n"), F.lit(" "))
    cell = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    out = []
    for ending, line, start, join, end in (
        (".csv", cell, 'note,value\nx,"open\n,', "\n,", f"\nx,y,{_SURPLUS}\n,{_LONG}\n"),
        (".json", F.to_json(F.struct(F.struct("value").alias("inner"))), '{"inner": {"value": x\n', "\n", ""),
    ):
        listed_rows = F.sort_array(F.collect_list(F.struct("row_id", line.alias("line"))))
        body = F.array_join(F.transform(listed_rows, lambda x: x["line"]), join)
        out.append(
            rows.groupBy("kind").agg(F.concat(F.lit(start), body, F.lit(end)).alias("text")).select(
                F.concat("kind", F.lit(ending)).alias("file_name"), "text"
            )
        )
    return reduce_union(out)


@query("d19_broken_files", _BROKEN_FILES_SQL)
def _d19_broken(spark, sf):
    """Broken records are listed, all others labelled, and nothing of a file is left unread."""
    found, rejected = jobs.scan_files(
        broken_files(spark, sf), load_data_elements(spark), keys=["file_name"]
    )
    confidence = F.get_json_object("json", "$.confidence_score").cast("double")
    return found.select(
        "file_name",
        F.col("detected_entity").alias("outcome"),
        confidence.alias("confidence"),
        F.lit(None).cast("long").alias("row_id"),
    ).unionByName(
        rejected.select(
            "file_name", F.col("route").alias("outcome"), F.lit(None).cast("double").alias("confidence"), "row_id"
        )
    )


def _json_sql(entities: str) -> str:
    """Stored JSON of a label, from CTE columns."""
    return (
        "'{\"highest_label\":\"' || highest_label || '\",\"confidence_score\":' || "
        f"CAST(confidence_score AS VARCHAR) || ',\"detected_entities\":' || {entities} || '}}'"
    )


_ENTITY_OBJECT = (
    "'{' || array_to_string(list_transform(string_split(entities, '|'), lambda e: '\"' || "
    "split_part(e, ':', 1) || '\":' || split_part(e, ':', 2)), ',') || '}'"
)
_PEOPLE_COLUMNS = ["full_name", "code", "ip", "card", "phone", "note", "customer_no"]
_PEOPLE_VALUES = " UNION ALL ".join(
    f"SELECT person_id AS row_id, '{c}' AS column_name, trim(CAST({c} AS VARCHAR)) AS value "
    f"FROM people WHERE trim(CAST({c} AS VARCHAR)) <> ''"
    for c in _PEOPLE_COLUMNS
)
_COLUMN_NAMES = ", ".join(f"('{c}')" for c in _PEOPLE_COLUMNS)


@query(
    "d14_scan_table",
    f"WITH {ctes('people', 'data_element')}, vals AS ({_PEOPLE_VALUES}), "
    f"hits AS ({oracle.column_hits('vals', ['column_name', 'row_id'])}), "
    f"{_FIRST.replace('kind', 'column_name')}, {oracle.label_sql('firsts', ['column_name'])}, "
    f"names AS (SELECT * FROM (VALUES {_COLUMN_NAMES}) AS n(column_name)), "
    "filled AS (SELECT column_name, coalesce(highest_label, 'NA') AS highest_label, "
    "coalesce(confidence_score, 0.0) AS confidence_score, entities FROM names LEFT JOIN labels "
    "USING (column_name)) SELECT 'people' AS table_id, column_name, CASE WHEN entities IS NULL "
    f"THEN {_json_sql(chr(39) + '\"{ NA }\"' + chr(39))} ELSE {_json_sql(_ENTITY_OBJECT)} END "
    "AS json, highest_label AS detected_entity, coalesce(parameter_name, 'UNKNOWN') AS "
    "data_element FROM filled LEFT JOIN data_element ON parameter_value = highest_label",
)
def _d14(spark, sf):
    people = fixture(spark, sf, "people")
    return jobs.scan_table(people, F.lit("people"), load_data_elements(spark), key="person_id")


_DOC_KEYS = list(jobs.FILE_COLUMNS)
_DOCS_SQL = (
    "docs AS (SELECT 'bucket-' || lang AS source_bucket, 'doc' || CAST(doc_id AS VARCHAR) || "
    "'.txt' AS file_name, n_chars AS file_size, 'TXT' AS file_type, source, lang AS sub_service, "
    "'eu' AS region, text AS value FROM documents)"
)


def _docs(spark, sf):
    return read_texts(spark, sf).select(
        F.concat(F.lit("bucket-"), "lang").alias("source_bucket"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("n_chars").alias("file_size"),
        F.lit("TXT").alias("file_type"),
        "source",
        F.col("lang").alias("sub_service"),
        F.lit("eu").alias("region"),
        "text",
    )


_SCANNED_DOCS = (
    f"WITH {ctes('data_element')}, {_DOCS_SQL}, hits AS ({oracle.text_hits('docs', _DOC_KEYS)}), "
    f"{oracle.label_sql('hits', _DOC_KEYS, 'position, nth')} "
    f"SELECT {', '.join(_DOC_KEYS)}, {_json_sql(_ENTITY_OBJECT)} AS json, "
    "highest_label AS detected_entity, coalesce(parameter_name, 'UNKNOWN') AS data_element "
    "FROM labels LEFT JOIN data_element ON parameter_value = highest_label"
)


@query("d15_scan_documents", _SCANNED_DOCS)
def _d15(spark, sf):
    return jobs.scan_documents(_docs(spark, sf), load_data_elements(spark))


@query(
    "d16_classify_files",
    f"WITH {ctes('files')}, docs AS (SELECT customer_id, file_name, file_size, text AS value FROM "
    f"files), hits AS ({oracle.text_hits('docs', ['customer_id', 'file_name', 'file_size'])}), "
    f"{oracle.label_sql('hits', ['customer_id', 'file_name', 'file_size'], 'position, nth')}, "
    "filled AS (SELECT d.customer_id, d.file_name, d.file_size, coalesce(highest_label, 'NA') AS "
    "highest_label, coalesce(confidence_score, 0.0) AS confidence_score, entities FROM docs d "
    "LEFT JOIN labels l ON l.customer_id = d.customer_id AND l.file_name = d.file_name AND "
    "l.file_size = d.file_size), reports AS (SELECT customer_id, file_name, "
    "'{\"file_name\":\"' || file_name || '\",\"file_extension\":\"' || "
    "lower(list_last(string_split(file_name, '.'))) || '\",\"file_size\":\"' || "
    "CASE WHEN file_size < 1024 THEN file_size || ' B' "
    "ELSE CAST(round_even(file_size / 1024.0::DOUBLE, 0) AS BIGINT) || ' KB' END || "
    f"'\",\"results\":' || {_json_sql(f'coalesce({_ENTITY_OBJECT}, {text('{}')})')} || '}}' "
    "AS report FROM filled) SELECT customer_id, file_name AS list_of_files, "
    "'[' || report || ']' AS json_output FROM reports",
)
def _d16(spark, sf):
    runs = jobs.classify_files(fixture(spark, sf, "files"))
    return runs.select(
        "customer_id", F.array_join("list_of_files", ",").alias("list_of_files"), "json_output"
    )


_STAGE_ONE = Ruleset("first", ()).with_rules(
    [
        ("EMAIL", EMAIL_PATTERN, 0.7),
        ("PHONE NUMBER", PHONE_PATTERN, 0.8),
        ("AADHAAR NUMBER", r"[0-9]{4} [0-9]{4} [0-9]{4}", 0.6),
    ]
)


@query(
    "d17_two_stage_scan",
    f"WITH {_CORPUS}, one AS ({oracle.hits(_STAGE_ONE, 'corpus', _IDS)}), "
    "chosen AS (SELECT source, row_id, position AS p1, nth AS n1, text AS value FROM one WHERE "
    "entity IN ('PHONE NUMBER', 'AADHAAR NUMBER')), "
    f"two AS ({oracle.text_hits('chosen', ['source', 'row_id', 'p1', 'n1'])}), "
    "result AS (SELECT 1) SELECT source, row_id, 1 AS stage, entity, text, score, "
    "CAST(1 AS BIGINT) AS count FROM one UNION ALL SELECT source, row_id, 2 AS stage, entity, "
    "text, score, count FROM (WITH "
    + _best_sql("two", "source, row_id", "p1, n1, position, nth")
    + ") AS b",
)
def _d17(spark, sf):
    first = detect.scan_values(fixture(spark, sf, "corpus"), rules=_STAGE_ONE, ids=_IDS)
    first = first.withColumnsRenamed({"position": "first_position", "nth": "first_nth"})
    return jobs.two_stage_scan(first, _IDS, order=["first_position", "first_nth"])


_LINES = (
    "SELECT row_id, 'type: PERSON, start: ' || CAST(row_id AS STRING) || ', end: ' || "
    "CAST(row_id + kind AS STRING) || ', score: 0.85' || CASE WHEN kind % 2 = 0 THEN chr(10) || "
    "'type: IP_ADDRESS, start: 3, end: 15, score: 0.95 type: bad, start: x' ELSE ' none' END "
    "AS line FROM {value_shapes}"
)


@query(
    "d18_parse_result_lines",
    f"WITH {_SHAPES}, lines AS ({_LINES.format(value_shapes='value_shapes')}) SELECT row_id, unnest(range(len(e))) AS nth, "
    "unnest(e) AS entity, CAST(unnest(s) AS BIGINT) AS start, CAST(unnest(t) AS BIGINT) AS \"end\", "
    "CAST(unnest(c) AS DOUBLE) AS score FROM (SELECT row_id, "
    + ", ".join(
        f"regexp_extract_all(line, {text(detect.RESULT_LINE)}, {n}) AS {alias}"
        for n, alias in enumerate("estc", start=1)
    )
    + " FROM lines) AS l",
)
def _d18(spark, sf):
    lines = spark.sql(_LINES, value_shapes=fixture(spark, sf, "value_shapes"))
    return detect.parse_result_lines(lines, ids=["row_id"])


@query(
    "d19_route_files",
    f"WITH {ctes('files')} SELECT doc_id, file_name, CASE lower(list_last(string_split(file_name, "
    "'.'))) WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'text' WHEN 'docx' THEN 'text' WHEN 'csv' THEN "
    "'table' WHEN 'jpeg' THEN 'image' ELSE 'rejected' END AS route FROM files",
)
def _d19(spark, sf):
    files = fixture(spark, sf, "files").select("doc_id", "file_name")
    return route_files(files)


@query(
    "d20_results_json",
    f"WITH {_SHAPES}, {_SHAPE_HITS}, counts AS (SELECT kind, entity, count(*) AS n, max(score) AS "
    "score FROM hits GROUP BY kind, entity) SELECT kind, '{\"entities\":{' || string_agg('\"' || "
    "entity || '\":{\"score\":' || score || ',\"appearances\":' || n || '}', ',' ORDER BY entity) "
    "|| '},\"sensitivity\":{}}' AS result FROM counts GROUP BY kind",
)
def _d20(spark, sf):
    return reduce.results_json(reduce.entity_counts(_shape_hits(spark, sf), ["kind"]), ["kind"])


@query(
    "d21_hits_by_text",
    f"WITH {_CORPUS}, {_CORPUS_HITS} SELECT source, row_id, entity, count(*) AS count, "
    "string_agg(text, '|' ORDER BY position, nth) AS texts, "
    "string_agg(text, ', ' ORDER BY position, nth) AS joined FROM hits "
    "GROUP BY source, row_id, entity",
)
def _d21(spark, sf):
    by_text = reduce.scan_by_text(fixture(spark, sf, "corpus"), "value", TEXT_RULES, _IDS)
    return by_text.withColumn("texts", F.array_join("texts", "|"))


@query(
    "d21_hits_by_text_and_column",
    f"WITH {_SHAPES}, {_SHAPE_HITS} SELECT kind, row_id, entity, count(*) AS count, "
    "string_agg(text, '|' ORDER BY position, nth) AS texts, "
    "string_agg(text, ', ' ORDER BY position, nth) AS joined FROM hits "
    "GROUP BY kind, row_id, entity",
)
def _d21_hits(spark, sf):
    by_text = reduce.hits_by_text(_shape_hits(spark, sf), _TABLE_KEY)
    return by_text.withColumn("texts", F.array_join("texts", "|"))


# --- user models and rules


def capitals_model():
    """A stand-in for a user model: years, with a confidence."""
    pattern = re.compile(r"[0-9]{4}")

    def predict(texts: list[str]) -> list[list[tuple]]:
        return [[("YEAR", m.start(), m.end(), 0.75) for m in pattern.finditer(t)] for t in texts]

    return predict


@query(
    "u01_scan_with_model",
    f"WITH {_CORPUS} SELECT source, row_id, 'YEAR' AS entity, 0.75::DOUBLE AS score, "
    "unnest(regexp_extract_all(value, '[0-9]{4}')) AS text FROM corpus",
)
def _u01(spark, sf):
    found = detect.scan_with_model(fixture(spark, sf, "corpus"), "value", capitals_model, _IDS)
    return found.select(*_IDS, "entity", "score", "text")


_USER_RULES = [("EMAIL_ADDRESS", EMAIL_PATTERN, 0.95), ("TICKET", "[A-Z]{2}-[0-9]+", 0.4)]


@query(
    "u02_user_rules",
    f"WITH {_SHAPES} {oracle.hits(COLUMN_RULES.with_rules(_USER_RULES), 'value_shapes', _TABLE_KEY)}",
)
def _u02(spark, sf):
    rules = spark.createDataFrame(_USER_RULES, "entity string, regex string, score double")
    return _shape_hits(spark, sf, COLUMN_RULES.with_rules(rules))


# --- incremental passes


@query("t01_stream_scan", _SCANNED_DOCS)
def _t01(spark, sf):
    """Documents arrive in two drops; each pass takes only the new files."""
    base = scratch_path(spark, "stream-scan")
    docs = _docs(spark, sf)
    drops = [docs.filter("sub_service < 'es'"), docs.filter("sub_service >= 'es'")]
    for drop in drops:
        drop.write.mode("append").parquet(f"{base}/in")
        stream_scan(
            spark,
            f"{base}/in",
            docs.schema,
            f"{base}/out",
            f"{base}/checkpoint",
            load_data_elements(spark),
        ).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("stream", "batch")


@query("t01_new_checkpoint", _SCANNED_DOCS)
def _t01_new(spark, sf):
    """A second stream with a checkpoint of its own adds to the stored results."""
    base = scratch_path(spark, "stream-scan")
    docs = _docs(spark, sf)
    for n, drop in enumerate((docs.filter("sub_service < 'es'"), docs.filter("sub_service >= 'es'"))):
        drop.write.parquet(f"{base}/in{n}")
        stream_scan(
            spark, f"{base}/in{n}", docs.schema, f"{base}/out", f"{base}/checkpoint{n}",
            load_data_elements(spark),
        ).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("stream", "batch")


def _written(spark, path: str, body: bytes) -> None:
    """A file below the shared folder, with exactly these bytes."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, True)
    stream.write(bytearray(body))
    stream.close()


def _move_parts(spark, source: str, target: str, largest: str) -> None:
    """Move part files between folders of one store; the largest replaces the file ``largest``.

    Files are renamed, so that their contents pass through no process.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(fs.globStatus(hadoop_path(f"{source}/part-*")), key=lambda part: -part.getLen())
    fs.delete(hadoop_path(f"{target}/{largest}"), False)
    for place, part in enumerate(parts):
        name = part.getPath().getName() if place else largest
        if not fs.rename(part.getPath(), hadoop_path(f"{target}/{name}")):
            raise OSError(f"cannot move {part.getPath()} to {target}/{name}")


def _write_files(files, by_name: str, path: str) -> None:
    """Write each text of ``files`` to the file it names, below ``path``; texts stay on executors."""
    files.write.partitionBy("file_name").text(by_name)
    spark = files.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path(path))
    for part in fs.globStatus(hadoop_path(f"{by_name}/file_name=*/part-*")):
        name = part.getPath().getParent().getName().removeprefix("file_name=")
        fs.rename(part.getPath(), hadoop_path(f"{path}/{name}"))


@query(
    "t01_failed_file",
    f"WITH scanned AS ({_SCANNED_DOCS}) SELECT file_name, detected_entity, 'results' AS found "
    "FROM scanned UNION ALL VALUES ('bad.parquet', NULL, 'failed'), ('bad.parquet', NULL, 'done')",
)
def _t01_failed(spark, sf):
    """One file cannot be read: the others are scanned at once, it is listed, and it is scanned
    by the first pass after its repair."""
    base = scratch_path(spark, "stream-failed")
    docs = _docs(spark, sf)
    good, late = docs.filter("sub_service < 'es'"), docs.filter("sub_service >= 'es'")
    good.write.parquet(f"{base}/in")
    _written(spark, f"{base}/in/bad.parquet", b"no parquet at all")
    lookup = load_data_elements(spark)

    def scanned():
        stream_scan(
            spark, f"{base}/in", docs.schema, f"{base}/out", f"{base}/checkpoint", lookup
        ).awaitTermination()
        status = file_status(spark, f"{base}/out").where("path LIKE '%/bad.parquet'")
        return spark.read.parquet(f"{base}/out").drop("stream", "batch"), status.collect()

    first, listed = scanned()
    first.write.parquet(f"{base}/first")
    # One file of the late rows takes the place of the bad one, the others arrive beside it.
    late.write.parquet(f"{base}/repaired")
    _move_parts(spark, f"{base}/repaired", f"{base}/in", "bad.parquet")
    second, again = scanned()
    both = spark.read.parquet(f"{base}/first").exceptAll(second)
    bad = [("bad.parquet", r.status) for r in listed + again]
    shown = spark.createDataFrame(bad, "file_name string, found string")
    # Rows of the first pass that the second lost, of which there are none, would show as such.
    rows = second.withColumn("found", F.lit("results")).unionByName(both.withColumn("found", F.lit("lost")))
    return rows.select("file_name", "detected_entity", "found").unionByName(shown, allowMissingColumns=True)


@query(
    "t01_mixed_files",
    f"{_BROKEN_FILES_SQL} UNION ALL SELECT 'n' || n_nationkey || '.exe', 'rejected', NULL, NULL "
    "FROM nation UNION ALL SELECT 'bad.csv', 'failed', NULL, NULL",
)
def _t01_mixed(spark, sf):
    """Tables, files of no known format and one that is no text, all in one folder."""
    base = scratch_path(spark, "stream-mixed")
    others = read(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey", F.lit(".exe")).alias("file_name"), F.col("n_name").alias("text")
    )
    _write_files(broken_files(spark, sf).unionByName(others), f"{base}/by-name", f"{base}/in")
    _written(spark, f"{base}/in/bad.csv", b"a,b\n\xff\xfe,ABCPK1234Z\n")
    for _ in range(2):
        stream_scan_files(
            spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", load_data_elements(spark),
            "s3,lake", "bucket", "eu", max_files=40,
        ).awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    rejected = rejected_files(spark, f"{base}/out")
    confidence = F.get_json_object("json", "$.confidence_score").cast("double")
    failed = file_status(spark, f"{base}/out").where("status <> 'done'")
    return (
        found.select("file_name", F.col("detected_entity").alias("outcome"), confidence.alias("confidence"))
        .unionByName(
            rejected.select("file_name", F.col("route").alias("outcome"), "row_id"), allowMissingColumns=True
        )
        .unionByName(
            failed.select(
                F.substring_index("path", "/", -1).alias("file_name"), F.col("status").alias("outcome")
            ),
            allowMissingColumns=True,
        )
    )


_SECOND = """
SELECT 't' || CAST(s_suppkey * 2 AS STRING) AS id, 'second' AS updatedBy, s_name AS name
FROM $supplier$"""
_UPSERTED_STREAM = (
    f"WITH {ctes('table_entity')}, second AS ({_SECOND.replace('$supplier$', 'supplier')}) "
    "SELECT id, updatedBy, name FROM table_entity WHERE id NOT IN (SELECT id FROM second) "
    "UNION ALL SELECT * FROM second"
)


def _stream_uploads(spark, base, drops, max_files=1_000):
    for n, drop in enumerate(drops):
        drop.write.parquet(f"{base}/in/upload-{n}")
        stream_upsert(
            spark, f"{base}/in", drop.schema, f"{base}/table", "id", f"{base}/checkpoint", max_files
        ).awaitTermination()


@query("t02_stream_upsert", _UPSERTED_STREAM)
def _t02(spark, sf):
    """Two catalog uploads; the second replaces some rows of the first and adds others."""
    base = scratch_path(spark, "stream-upsert")
    first = fixture(spark, sf, "table_entity").select("id", "updatedBy", "name")
    _stream_uploads(spark, base, (first, sql_over(spark, sf, _SECOND)))
    return UploadedRows(spark, f"{base}/table", "id").read()


@query("t02_existing_table", _UPSERTED_STREAM)
def _t02_existing(spark, sf):
    """The first upload of a stream changes a table that was there before."""
    base = scratch_path(spark, "stream-existing")
    first = fixture(spark, sf, "table_entity").select("id", "updatedBy", "name")
    table = UploadedRows(spark, f"{base}/table", "id")
    table.create(first)
    _stream_uploads(spark, base, (sql_over(spark, sf, _SECOND),))
    return table.read()


@query("t02_flat_folder", _UPSERTED_STREAM)
def _t02_flat(spark, sf):
    """Files of two passes over one folder without subfolders: each pass is an upload."""
    base = scratch_path(spark, "stream-flat")
    first = fixture(spark, sf, "table_entity").select("id", "updatedBy", "name")
    for drop in (first, sql_over(spark, sf, _SECOND)):
        drop.write.mode("append").parquet(f"{base}/in")
        stream_upsert(
            spark, f"{base}/in", drop.schema, f"{base}/table", "id", f"{base}/checkpoint"
        ).awaitTermination()
    return UploadedRows(spark, f"{base}/table", "id").read()


_PART = (
    "SELECT 's' || CAST(s_suppkey % (3 * (11 - {n})) AS STRING) AS id, 'drop{n}' AS updatedBy, "
    "s_name AS name FROM $supplier$"
)
_TEN_SQL = " UNION ALL ".join(
    f"SELECT *, {n} AS n FROM ({_PART.format(n=n).replace('$supplier$', 'supplier')})" for n in range(1, 11)
)


@query(
    "t02_ten_uploads",
    f"WITH d AS ({_TEN_SQL}), l AS (SELECT id, max(n) AS n FROM d GROUP BY id) "
    "SELECT id, updatedBy, name FROM d JOIN l USING (id, n)",
)
def _t02_ten(spark, sf):
    """upload-10 comes after upload-9 though its name sorts before it; all wait for one pass."""
    base = scratch_path(spark, "stream-ten")
    for n in range(1, 11):
        drop = sql_over(spark, sf, _PART.format(n=n))
        drop.write.parquet(f"{base}/in/upload-{n}")
    stream_upsert(
        spark, f"{base}/in", drop.schema, f"{base}/table", "id", f"{base}/checkpoint", max_files=3
    ).awaitTermination()
    return UploadedRows(spark, f"{base}/table", "id").read()


_DOUBLED = "SELECT 't' || CAST(s_suppkey % 40 AS STRING) AS id, s_name AS name FROM $supplier$"


@query(
    "t02_many_files",
    f"WITH d AS ({_DOUBLED.replace('$supplier$', 'supplier')}) SELECT id, name, "
    "max_files FROM d, (VALUES (1), (1000)) f(max_files)",
)
def _t02_many(spark, sf):
    """Rows of one upload that share a key stay, whether files come one by one or at once."""
    rows = sql_over(spark, sf, _DOUBLED).repartition(4)
    out = []
    for max_files in (1, 1_000):
        base = scratch_path(spark, "stream-files")
        old = rows.withColumn("name", F.lit("old"))
        _stream_uploads(spark, base, (old, rows), max_files)
        read_back = UploadedRows(spark, f"{base}/table", "id").read()
        out.append(read_back.withColumn("max_files", F.lit(max_files)))
    return out[0].unionByName(out[1])
