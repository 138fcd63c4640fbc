"""Scalar functions F, rules R, N and K, and check digits C."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmap.functions import checksums, scalar
from hushmap.operators.detect import rule_matches, scan_column_names, scan_values
from hushmap.operators.documents import extract_identifiers
from hushmap.operators.reduce import enrich
from hushmap.operators.verify import verify_hits
from hushmap.rules import COLUMN_RULES, DOCUMENT_CLASSES, NAME_RULES, TEXT_RULES
from hushmap.rules.values import JAVA_FLAGS
from hushmap.session import spread
from hushmap.sources.results import load_data_elements
from workload import oracle
from workload.fixtures import ctes, fixture, read, sql_over, text
from workload.registry import query

# --- scalar functions


@query(
    "f01_dot_part",
    f"WITH {ctes('profiler_data_time_series')} SELECT entityFQNHash, "
    "split_part(entityFQNHash, '.', 1) AS p1, split_part(entityFQNHash, '.', 4) AS p4 "
    "FROM profiler_data_time_series",
)
def _f01(spark, sf):
    df = fixture(spark, sf, "profiler_data_time_series")
    name = F.col("entityFQNHash")
    return df.select(name, scalar.dot_part(name, 1).alias("p1"), scalar.dot_part(name, 4).alias("p4"))


@query(
    "f02_before_dot",
    f"WITH {ctes('dbservice_entity_meta_info')} SELECT dbservice_entity_id, "
    "CASE WHEN strpos(dbservice_entity_id, '.') > 0 THEN substr(dbservice_entity_id, 1, "
    "strpos(dbservice_entity_id, '.') - 1) ELSE dbservice_entity_id END AS head "
    "FROM dbservice_entity_meta_info",
)
def _f02(spark, sf):
    df = fixture(spark, sf, "dbservice_entity_meta_info")
    name = F.col("dbservice_entity_id")
    return df.select(name, scalar.before_dot(name).alias("head"))


@query(
    "f03_json_member",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def _f03(spark, sf):
    df = read(spark, sf, "events")
    return df.select("event_id", scalar.json_member(F.col("props"), "k").alias("k"))


_REPAIRED = (
    "rtrim(replace(replace(replace(json, chr(39), '\"'), 'False', 'false'), 'True', 'true'), ',')"
)


@query(
    "f04_repair_json",
    f"WITH {ctes('profiler_data_time_series')} SELECT timestamp, "
    f"CASE WHEN json_valid({_REPAIRED}) THEN {_REPAIRED} END AS repaired "
    "FROM profiler_data_time_series",
)
def _f04(spark, sf):
    df = fixture(spark, sf, "profiler_data_time_series")
    return df.select("timestamp", scalar.repair_json(F.col("json")).alias("repaired"))


_HOSTS = (
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'db' || CAST(o_orderkey AS STRING) "
    "|| '.c1.eu-west-1.rds.amazonaws.com:5432' WHEN 1 THEN 'a.b.r' ELSE 'localhost' END AS host"
)


@query(
    "f05_host_parts",
    f"WITH h AS ({_HOSTS} FROM orders) SELECT o_orderkey, "
    "coalesce(string_split(host, '.')[3], 'N/A') AS region, "
    "coalesce(string_split(host, '.')[5], 'N/A') AS source FROM h",
)
def _f05(spark, sf):
    df = sql_over(spark, sf, f"{_HOSTS} FROM $orders$")
    host = F.col("host")
    return df.select(
        "o_orderkey",
        scalar.host_region(host).alias("region"),
        scalar.host_source(host).alias("source"),
    )


_TIMES = (
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-02-29T23:59:' || "
    "CAST(10 + event_id % 50 AS STRING) || '.5Z' WHEN 1 THEN '2024-01-02T03:04:05.123456Z' "
    "WHEN 2 THEN 'yesterday' END AS iso"
)


@query(
    "f06_iso_epoch",
    f"WITH t AS ({_TIMES} FROM events) SELECT event_id, coalesce(CAST(floor(epoch("
    "try_strptime(iso, '%Y-%m-%dT%H:%M:%S.%fZ'))) AS BIGINT), -1) AS seconds FROM t",
)
def _f06(spark, sf):
    df = sql_over(spark, sf, f"{_TIMES} FROM $events$")
    return df.select("event_id", F.coalesce(scalar.iso_epoch_seconds(F.col("iso")), F.lit(-1)).alias("seconds"))


_SIZES = (
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1024 "
    "WHEN 1 THEN o_orderkey * 512 WHEN 2 THEN o_orderkey * 524288 + 2097152 "
    "ELSE o_orderkey * 536870912 END AS size"
)


@query(
    "f07_human_size",
    f"WITH s AS ({_SIZES} FROM orders) SELECT o_orderkey, CASE "
    "WHEN size < 1024 THEN size || ' B' "
    "WHEN size < 1048576 THEN CAST(round_even(size / 1024.0::DOUBLE, 0) AS BIGINT) || ' KB' "
    "WHEN size < 1073741824 THEN CAST(round_even(size / 1048576.0::DOUBLE, 0) AS BIGINT) || ' MB' "
    "ELSE CAST(round_even(size / 1073741824.0::DOUBLE, 0) AS BIGINT) || ' GB' END AS size_text "
    "FROM s",
)
def _f07(spark, sf):
    df = sql_over(spark, sf, f"{_SIZES} FROM $orders$")
    return df.select("o_orderkey", scalar.human_size(F.col("size")).alias("size_text"))


@query("f08_kilobytes", "SELECT doc_id, CAST(n_chars AS DOUBLE) / 1024 AS kb FROM documents")
def _f08(spark, sf):
    df = read(spark, sf, "documents")
    return df.select("doc_id", scalar.kilobytes(F.col("n_chars")).alias("kb"))


_SOURCE_TYPES = (
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE ' ' || source || ' , ' || lang "
    "|| ' ' END AS source_type"
)


@query(
    "f09_source_parts",
    f"WITH s AS ({_SOURCE_TYPES} FROM documents) SELECT doc_id, "
    "trim(string_split(source_type, ',')[1]) AS source, "
    "coalesce(trim(string_split(source_type, ',')[2]), 'N/A') AS sub_service FROM s",
)
def _f09(spark, sf):
    df = sql_over(spark, sf, f"{_SOURCE_TYPES} FROM $documents$")
    kind = F.col("source_type")
    return df.select(
        "doc_id",
        scalar.source_name(kind).alias("source"),
        scalar.sub_service_name(kind).alias("sub_service"),
    )


@query(
    "f10_confidence",
    "WITH r AS (SELECT o_orderkey, o_custkey % 400 + 1 AS total, "
    "o_orderkey % (o_custkey % 400 + 1) + 1 AS top FROM orders) "
    f"SELECT o_orderkey, {oracle.confidence('top', 'total')} AS confidence FROM r",
)
def _f10(spark, sf):
    total = F.col("o_custkey") % 400 + 1
    top = F.col("o_orderkey") % total + 1
    return read(spark, sf, "orders").select(
        "o_orderkey", scalar.confidence(top, total).alias("confidence")
    )


@query(
    "f11_lookup",
    f"WITH {ctes('column_ner_results', 'data_element')} SELECT c.id, c.detected_entity, "
    "coalesce(d.parameter_name, 'UNKNOWN') AS data_element, "
    "coalesce(d.parameter_sensitivity, '') AS parameter_sensitivity "
    "FROM column_ner_results c LEFT JOIN data_element d ON c.detected_entity = d.parameter_value",
)
def _f11(spark, sf):
    rows = fixture(spark, sf, "column_ner_results").select("id", "detected_entity")
    return enrich(rows, load_data_elements(spark))


@query(
    "f12_string_cast",
    "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, "
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderstatus AS s FROM orders",
)
def _f12(spark, sf):
    return read(spark, sf, "orders").select(
        scalar.as_string(F.col("o_orderkey")).alias("k"),
        scalar.as_string(F.col("o_custkey")).alias("c"),
        scalar.as_string(F.col("o_orderdate").cast("date")).alias("d"),
        scalar.as_string(F.col("o_orderstatus")).alias("s"),
    )


# --- value patterns, one query per rule over shaped values and all texts

_IDS = ["source", "row_id"]


def _register_rule(key: str, rules) -> None:
    sql = f"WITH {ctes('values')} " + oracle.hits(rules, "values", _IDS).replace(
        "FROM values", 'FROM "values"'
    )

    def run(spark, sf):
        return scan_values(fixture(spark, sf, "values"), "value", rules, _IDS)

    query(key, sql.replace("WITH values", 'WITH "values"'))(run)


for _n, _rule in enumerate(COLUMN_RULES.rules, start=1):
    _register_rule(f"r{_n:02d}_{_rule.entity.lower()}", COLUMN_RULES.only(_rule.entity))
_register_rule("r23_zipcode_text", TEXT_RULES.only("ZIPCODE"))
_register_rule("r28_cvv_text", TEXT_RULES.only("CVV"))

# --- column names

_NAME_STEMS = [rule.rule.lower() for rule in NAME_RULES] + [
    "l_shipdate", "amount", "e-mail", "FirstName", "client name", "credit x card", "qty", "dob",
    "PinCode", "veh_id", "maid", "colour",
]
_NAME_CASES = " ".join(f"WHEN {i} THEN {text(stem)}" for i, stem in enumerate(_NAME_STEMS))
_NAMES = (
    f"SELECT c_custkey, CASE c_custkey % {len(_NAME_STEMS)} {_NAME_CASES} END || '_' || "
    "CAST(c_custkey AS STRING) AS column_name"
)
_NAME_RULE_CASES = " ".join(
    f"WHEN regexp_matches(column_name, {text('(?i)' + r.regex)}) THEN {i}"
    for i, r in enumerate(NAME_RULES)
)
_NAME_ROWS = ", ".join(f"({i}, {text(r.rule)}, {text(r.tag)})" for i, r in enumerate(NAME_RULES))


@query(
    "n01_column_names",
    f"WITH names AS ({_NAMES} FROM customer), tagged AS (SELECT *, CASE {_NAME_RULE_CASES} END "
    f"AS i FROM names), rules AS (SELECT * FROM (VALUES {_NAME_ROWS}) AS r(i, rule, tag)) "
    "SELECT c_custkey, column_name, rule, tag, 1.0::DOUBLE AS confidence "
    "FROM tagged JOIN rules USING (i)",
)
def _n01(spark, sf):
    names = sql_over(spark, sf, f"{_NAMES} FROM $customer$")
    return scan_column_names(names, ids=["c_custkey"])


# --- check digits

_VERHOEFF = (
    "list_reduce(list_prepend(0, list_transform(list_reverse(string_split(n, '')), "
    "lambda c: CAST(c AS INT))), lambda acc, x, i: "
    f"{checksums.VERHOEFF_PRODUCT}[acc + 1]"
    f"[{checksums.VERHOEFF_PERMUTATION}[(i - SHIFT) % 8 + 1][x + 1] + 1]) = 0"
)


def _luhn(number: str, base: int = 10) -> str:
    """SQL test of the Luhn sum; characters are read through the base-36 alphabet."""
    code = f"(strpos('{checksums.BASE36}', substr({number}, length({number}) - i, 1)) - 1)"
    doubled = f"(({code} * 2) // {base} + ({code} * 2) % {base})"
    return (
        f"list_sum(list_transform(range(length({number})), lambda i: "
        f"CASE WHEN i % 2 = 0 THEN {code} ELSE {doubled} END)) % {base} = 0"
    )


# Digit strings of the right shape, so that check digits hold for a share of them.
_NUMBERS = (
    "SELECT o_orderkey AS row_id, CASE o_orderkey % 3 WHEN 0 THEN "
    "CAST(2 + o_orderkey % 8 AS STRING) || lpad(CAST((o_orderkey * 7919) % 100000 AS STRING), 5, '0')"
    " || lpad(CAST((o_custkey * 104729) % 1000000 AS STRING), 6, '0') "
    "WHEN 1 THEN CAST(2 + o_orderkey % 8 AS STRING) || "
    "lpad(CAST((o_orderkey * 7919) % 1000 AS STRING), 3, '0') || ' ' || "
    "lpad(CAST((o_orderkey * 31) % 10000 AS STRING), 4, '0') || ' ' || "
    "lpad(CAST((o_custkey * 104729) % 10000 AS STRING), 4, '0') || ' ' || "
    "lpad(CAST((o_custkey * 7) % 10000 AS STRING), 4, '0') "
    "ELSE '234567' || '765432' END AS value"
)


def _numbers(spark, sf):
    return spread(sql_over(spark, sf, f"{_NUMBERS} FROM $orders$"), f"{sf}/orders.parquet")


def _digits_check(name: str, form: str) -> str:
    return (
        f"regexp_matches(n, '{form}') AND n <> reverse(n) AND CASE WHEN "
        f"regexp_matches(n, '{form}') THEN {name} ELSE FALSE END"
    )


# The accumulator walks the list from its second element, whose index the engine counts.
_VERHOEFF_SQL = _VERHOEFF.replace("SHIFT", "2")


def _check_sql(test: str, compact: str = "translate(value, ' -', '')") -> str:
    return (
        f"WITH v AS ({_NUMBERS} FROM orders), {ctes('value_shapes')}, s AS ("
        "SELECT 'numbers' AS source, row_id, value FROM v UNION ALL "
        "SELECT 'shapes' AS source, row_id, value FROM value_shapes), "
        f"c AS (SELECT *, {compact} AS n FROM s) "
        f"SELECT source, row_id, coalesce({test}, FALSE) AS ok FROM c"
    )


def _checked(spark, sf):
    numbers = _numbers(spark, sf).select(F.lit("numbers").alias("source"), "row_id", "value")
    shapes = fixture(spark, sf, "value_shapes")
    return numbers.unionByName(shapes.select(F.lit("shapes").alias("source"), "row_id", "value"))


AADHAAR_SQL = _digits_check(_VERHOEFF_SQL, checksums.AADHAAR_FORMAT)
VID_SQL = _digits_check(_VERHOEFF_SQL, checksums.VID_FORMAT)
VOTER_SQL = (
    f"CASE WHEN regexp_matches(n, '{checksums.VOTER_ID_FORMAT}') "
    f"THEN {_luhn('substr(n, 4, 7)')} ELSE FALSE END"
)
PAN_SQL = "regexp_matches({n}, '^[A-Z]{{3}}[ABCFGHJKLPT][A-Z][0-9]{{4}}[A-Z]$') AND substr({n}, 6, 4) <> '0000'"
GST_SQL = (
    f"CASE WHEN regexp_matches(n, '{checksums.GST_FORMAT}') AND "
    f"{PAN_SQL.format(n='substr(n, 3, 10)')} THEN {_luhn('n', 36)} ELSE FALSE END"
)
CARD_SQL = (
    "CASE WHEN regexp_matches(n, '^[0-9]+$') AND regexp_matches(n, '[1-9]') "
    f"THEN {_luhn('n')} ELSE FALSE END"
)
ACCOUNT_SQL = r"regexp_matches(value, '^\d{9,18}$')"
PHONE_SQL = rf"regexp_matches(value, '{checksums.PHONE_FORMAT}')"

UPPER = "upper(translate(value, ' -', ''))"
NO_BLANKS = r"regexp_replace(value, '[\s-]', '', 'g')"

_CHECKS = [
    ("c01_aadhaar", checksums.is_aadhaar, AADHAAR_SQL, "translate(value, ' -', '')"),
    ("c02_voter_id", checksums.is_voter_id, VOTER_SQL, "upper(replace(value, ' ', ''))"),
    ("c03_gst", checksums.is_gst, GST_SQL, UPPER),
    ("c04_pan", checksums.is_pan, PAN_SQL.format(n="n"), UPPER),
    ("c05_vid", checksums.is_vid, VID_SQL, "translate(value, ' -', '')"),
    ("c06_bank_card", checksums.is_bank_card, CARD_SQL, NO_BLANKS),
    ("c07_bank_account", checksums.is_bank_account, ACCOUNT_SQL, "value"),
    ("c08_phone", checksums.is_phone, PHONE_SQL, "value"),
]


def _register_check(key, validator, test, compact) -> None:
    def run(spark, sf):
        return _checked(spark, sf).select(
            "source", "row_id", validator(F.col("value")).alias("ok")
        )

    query(key, _check_sql(test, compact))(run)


for _check in _CHECKS:
    _register_check(*_check)


def _with_n(test: str, compact: str) -> str:
    return f"(SELECT {test} FROM (SELECT {compact} AS n) AS q)"


def _identify_sql(source: str, keys: str) -> str:
    """First accepted entity per value, with one column per compacted form."""
    forms = {"c01_aadhaar": "n1", "c02_voter_id": "n2", "c03_gst": "n3", "c06_bank_card": "n6"}
    tests = {
        "AADHAAR": ("n1", AADHAAR_SQL),
        "VOTERID": ("n2", VOTER_SQL),
        "GST_NUMBER": ("n3", GST_SQL),
        "PAN": ("n3", PAN_SQL.format(n="n")),
        "VID": ("n1", VID_SQL),
        "PHONE_NUMBER": ("n6", PHONE_SQL),
        "BANK_CARD": ("n6", CARD_SQL),
        "BANK_ACCOUNT_NUMBER": ("n6", ACCOUNT_SQL),
    }
    compacts = {key: compact for key, _, _, compact in _CHECKS}
    columns = ", ".join(f"{compacts[key]} AS {alias}" for key, alias in forms.items())
    steps, current = [f"f AS (SELECT {keys}, value, {columns} FROM {source})"], "f"
    for step, (entity, (alias, test)) in enumerate(tests.items()):
        kept = f"{keys}, value, n1, n2, n3, n6" + "".join(f", t{i}" for i in range(step))
        steps.append(
            f"g{step} AS (SELECT {kept}, coalesce({test}, FALSE) AS t{step} "
            f"FROM (SELECT *, {alias} AS n FROM {current}) AS q)"
        )
        current = f"g{step}"
    scores = dict(checksums.ENTITY_SCORES)
    entity_case = " ".join(f"WHEN t{i} THEN {text(e)}" for i, e in enumerate(tests))
    score_case = " ".join(f"WHEN t{i} THEN {scores[e]}::DOUBLE" for i, e in enumerate(tests))
    steps.append(
        f"identified AS (SELECT {keys}, value, CASE {entity_case} END AS entity, "
        f"CASE {score_case} ELSE 0.0::DOUBLE END AS score FROM {current})"
    )
    return ",\n".join(steps)


@query(
    "c09_identify_entity",
    f"WITH v AS ({_NUMBERS} FROM orders), {ctes('value_shapes')}, s AS ("
    "SELECT 'numbers' AS source, row_id, value FROM v UNION ALL "
    "SELECT 'shapes' AS source, row_id, value FROM value_shapes), "
    f"{_identify_sql('s', 'source, row_id')} SELECT source, row_id, entity, score FROM identified",
)
def _c09(spark, sf):
    return checksums.identify_entity(_checked(spark, sf), "value", ["source", "row_id"])


_VERIFIED = ", ".join(text(e) for e in checksums.VERIFIED_ENTITIES)


@query(
    "c10_verify_hits",
    f"WITH {ctes('value_shapes')}, hits AS ({oracle.column_hits('value_shapes', ['kind'])}), "
    f"s AS (SELECT kind, text AS value FROM hits WHERE entity IN ({_VERIFIED})), "
    f"{_identify_sql('s', 'kind')} SELECT DISTINCT kind, entity, score FROM identified",
)
def _c10(spark, sf):
    shapes = fixture(spark, sf, "value_shapes")
    return verify_hits(scan_values(shapes, ids=["kind"]), ["kind"])


# --- document class patterns, by group

_GROUPS = {
    "k01_no_region": [c for c in DOCUMENT_CLASSES if c.regex and c.region is None],
    "k02_india": [c for c in DOCUMENT_CLASSES if c.region == "India"],
    "k03_north_america": [c for c in DOCUMENT_CLASSES if c.region in ("United States", "Canada")],
    "k04_middle_east": [
        c for c in DOCUMENT_CLASSES if c.region in ("Saudi Arabia", "Israel", "Palestine")
    ],
    "k05_europe": [
        c
        for c in DOCUMENT_CLASSES
        if c.region in ("United Kingdom", "Ukraine", "Russia", "Ireland")
    ],
}
_grouped = {c.name for group in _GROUPS.values() for c in group}
_GROUPS["k06_asia_pacific_africa"] = [
    c for c in DOCUMENT_CLASSES if c.has_identifier and c.name not in _grouped
]

# Passport lines for every class that reads them, made from the order table.
_ZONES = (
    "SELECT 'zones' AS source, o_orderkey AS row_id, CASE o_orderkey % 17 "
    + " ".join(
        f"WHEN {i} THEN 'ref {head}' || CAST(o_orderkey AS STRING) || '<<DOE<<JANE' || chr(10) "
        "|| 'next'"
        for i, head in enumerate(
            ["P<GBR", "P<IND", "P<USA", "P<SAU", "V<SAU", "IDUKR", "P<UKR", "P<RUS", "PASGP<<",
             "PMZAF<<", "PPKOR", "PPPRK", "PMISR", "PDPSE", "P<CAN", "GA07 1234"]
        )
    )
    + " ELSE CAST(o_custkey % 10000 + 1000 AS STRING) || '-' "
    "|| CAST(o_orderkey % 9000 + 1000 AS STRING) END AS value"
)


def _register_class(key: str, classes: list) -> None:
    parts = [
        f"SELECT source, row_id, {text(c.name)} AS class, unnest(list_distinct("
        f"regexp_extract_all(value, {text(c.regex)}))) AS identifier FROM s"
        for c in classes
        if c.regex
    ]
    sql = (
        f"WITH {ctes('corpus', 'value_shapes')}, s AS (SELECT * FROM corpus UNION ALL "
        "SELECT 'shapes' AS source, row_id, value FROM value_shapes UNION ALL "
        f"({_ZONES} FROM orders)) " + " UNION ALL ".join(parts)
    )

    def run(spark, sf):
        shapes = fixture(spark, sf, "value_shapes").select(
            F.lit("shapes").alias("source"), "row_id", "value"
        )
        zones = sql_over(spark, sf, f"{_ZONES} FROM $orders$")
        values = fixture(spark, sf, "corpus").unionByName(shapes).unionByName(zones)
        names = {c.name for c in classes}
        others = [c.name for c in DOCUMENT_CLASSES if c.name not in names]
        everywhere = all(c.region is None for c in classes)
        ids = ["source", "row_id"]
        return extract_identifiers(values, "value", ids, others, everywhere).drop("class_position")

    query(key, sql)(run)


for _key, _classes in _GROUPS.items():
    _register_class(_key, _classes)
