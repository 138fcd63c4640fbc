"""Rules: literal cases, and agreement with a plain loop over the same patterns."""

import re

import pytest
from pyspark.sql import functions as F

from hushmap.operators.detect import scan_column_names, scan_first, scan_spans, scan_values
from hushmap.operators.documents import class_identifiers
from hushmap.rules import COLUMN_RULES, DOCUMENT_CLASSES, TEXT_RULES
from hushmap.rules.documents import EMAIL_PATTERN
from workload.fixtures import fixture

# entity, a value that hits, a near miss
CASES = [
    ("AADHAAR", "2345 6789 0123", "1345 6789 0123"),
    ("PAN", "ABCPK1234Z", "ABCPK1234z"),
    ("VISA_CARD", "4111-1111-1111-1111", "5111-1111-1111-1111 1"),
    ("MASTER_CARD", "5212345678901234", "5012345678901234"),
    ("AMEX_CARD", "3412-345678-12345", "3412-345678 12345"),
    ("RUPAY_CARD", "6012 3456 7890 1234", "6112 3456 7890 1234"),
    ("MAESTRO_CARD", "5018 1234 1234 1234 12", "5018 1234-1234 1234 12"),
    ("IP_ADDRESS", "10.0.0.255", "10.0.0.256"),
    ("IP_ADDRESS", "fe80::1:2", "fe80:::1"),
    ("IP_ADDRESS", "1:2:3", "1:2"),
    ("IP_ADDRESS", "::ffff:10.0.0.1", "::ffff:10.0.0"),
    ("MAC_ADDRESS", "0a:1b:2c:3d:4e:5f", "0a:1b:2c:3d:4e-5f"),
    ("MAC_ADDRESS", "0a1b.2c3d.4e5f", "0a1b.2c3d.4e5"),
    ("VOTERID", "ABC1234567", "AB01234567"),
    ("PASSPORT", "M1234567", "Q1234567"),
    ("DRIVERLICENSE", "MH12 20110012345", "MH12/20110012345"),
    ("BANK_ACCOUNT_NUMBER", "123456789", "12345678"),
    ("IFSC", "SBIN0A12345", "SBIN1A12345"),
    ("RATION_CARD_NUMBER", "KA1234567890", "XX1234567890"),
    ("VEHICLE_IDENTIFICATION_NUMBER", "KA 05 AB 1234", "XA 05 AB 1234"),
    ("UPI_ID", "some.one@okbank", "some.one@ok.bank"),
    ("GST_NUMBER", "29ABCPK1234Z1Z5", "29ABCPK1234Z1Y5"),
    ("PERSON", "met John Smith", "met John smith"),
    ("GENDER", "is Female", "is Females"),
    ("NATIONALITY", "an Indian", "an Indiana"),
    ("ADDRESS", "12 Elm Street", "12 Elm Streets"),
    ("ZIPCODE", "560001", "560001.25"),
    ("PASSWORD", "Secret1@x", "Secret12x"),
    ("POBOX", "PO Box 12345", "PO Box 123456"),
    ("PHONE_NUMBER", "555-123.4567", "555-123-456"),
    ("TITLE", "Mrs Hill", "Mrsx Hill"),
    ("CVV", "123", "999"),
    ("IMEI", "35-20-99-00-176148-1", "35-20-99-00-176148-12"),
    ("IMSI", "404401234567890", "406401234567890"),
    ("UID", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-42661417400g"),
    ("DATE_TIME", "on 2024-01-02 03:04", "on 2024-1-2"),
]


def test_each_rule_hits_and_misses(spark):
    rows = [(i, entity, hit, True) for i, (entity, hit, _) in enumerate(CASES)]
    rows += [(i, entity, miss, False) for i, (entity, _, miss) in enumerate(CASES)]
    values = spark.createDataFrame(rows, "case int, wanted string, value string, hit boolean")
    hits = scan_values(values, ids=["case", "wanted", "hit"])
    found = {
        (row.case, row.hit) for row in hits.filter(F.col("entity") == F.col("wanted")).collect()
    }
    assert found == {(i, True) for i in range(len(CASES))}
    assert {entity for entity, _, _ in CASES} == set(COLUMN_RULES.entities)


def test_text_list_differs(spark):
    values = spark.createDataFrame([(1, "12345-6789"), (2, "560001"), (3, "John Smith")],
                                   "row_id int, value string")
    found = {(r.row_id, r.entity) for r in scan_values(values, rules=TEXT_RULES).collect()}
    assert found == {(1, "ZIPCODE")}


def plain_hits(text, rules):
    for position, rule in enumerate(rules.rules):
        for nth, match in enumerate(re.finditer(rule.regex, text)):
            yield position, nth, match.start(), match.group()


TRICKY = [
    "John Smith\n", "M\r\nF", "x M", "é12 Elm Sté", "a1 2 St", "١٢٣-123-4567",
    "", "\n", "@Abcdefg1", "--Abc1@\n-Abcdefg1@--\nAbcdefg1", "A1a@ A1a@ A1a@", "b@éAa1bcdefg#é",
    "4111 1111 1111 1111\n", "4111 1111 1111 1111", "123456.1 123456. 654321.x", "PO Box 1\nPO Box 2",
]


@pytest.mark.parametrize("rules", [COLUMN_RULES, TEXT_RULES], ids=lambda r: r.name)
def test_scans_agree_with_a_plain_loop(spark, sf, rules):
    values = fixture(spark, sf, "values")
    tricky = spark.createDataFrame(
        [("tricky", i, text) for i, text in enumerate(TRICKY)],
        "source string, row_id bigint, value string",
    )
    values = values.unionByName(tricky)
    texts = {(r.source, r.row_id): r.value for r in values.collect()}
    want = {
        (*key, *hit) for key, text in texts.items() for hit in plain_hits(text, rules)
    }
    ids = ["source", "row_id"]
    got = scan_values(values, rules=rules, ids=ids).collect()
    assert {(r.source, r.row_id, r.position, r.nth, r.text) for r in got} == {
        (s, k, p, n, t) for s, k, p, n, _, t in want
    }
    entities = [rule.entity for rule in rules.rules]
    spans = scan_spans(values, "value", rules, ids).collect()
    assert {(r.source, r.row_id, r.entity, r.start, r.text) for r in spans} == {
        (s, k, entities[p], b, t) for s, k, p, _, b, t in want
    }
    first = {(r.source, r.row_id): r.position for r in scan_first(values, rules=rules, ids=ids).collect()}
    firsts = {}
    for s, k, p, *_ in want:
        firsts[s, k] = min(p, firsts.get((s, k), p))
    assert first == firsts


def test_offsets_of_many_matches_and_of_empty_ones(spark):
    text = "é😀 " + "Mr x " * 1000
    values = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "row_id int, value string")
    found = scan_spans(values, "value", COLUMN_RULES.only("TITLE")).collect()
    assert sorted((r.start, r.end, r.text) for r in found) == [
        (3 + 5 * k, 5 + 5 * k, "Mr") for k in range(1000)
    ]
    rules = COLUMN_RULES.only("TITLE").with_rules([("GAP", "(?=x)|z*", 0.5)])
    some = spark.createDataFrame([(1, "Mr xzz")], "row_id int, value string")
    spans = {(r.entity, r.start, r.end) for r in scan_spans(some, "value", rules).collect()}
    want = {("GAP", m.start(), m.end()) for m in re.finditer("(?=x)|z*", "Mr xzz")}
    assert spans == want | {("TITLE", 0, 2)}


def test_long_line_is_scanned_in_linear_time(spark):
    line = "word " * 200_000
    values = spark.createDataFrame([(1, line + "1@"), (2, line + "A1@x")], "row_id int, value string")
    found = scan_values(values, rules=COLUMN_RULES.only("PASSWORD")).select("row_id").collect()
    assert [row.row_id for row in found] == [2]


GOLDEN = [
    ("Sample text with PII like SSN 123-45-6789", []),
    ("Another text with a name John Doe", ["PERSON"]),
    ("Email address: john.doe@example.com", []),
    ("Credit card number: 4111 1111 1111 1111", []),
    ("Phone number: +1-800-555-1234", ["PASSWORD", "PHONE_NUMBER"]),
    ("Address: 1234 Elm Street, Springfield, IL 62704", ["ADDRESS", "PERSON"]),
    ("Date of birth: 01/01/1970", ["DATE_TIME"]),
    ("Passport number: X1234567", []),
    ("Bank account number: 9876543210", ["PHONE_NUMBER"]),
    ("Driver's license: D1234567", []),
    ("Social Security Number: 987-65-4321", ["PERSON"]),
    ("Medical record number: MR123456", []),
    ("Vehicle license plate: ABC1234", []),
    ("Health insurance number: HI123456", []),
    ("Employee ID: E123456", []),
    ("Tax ID number: T123456789", []),
    ("Student ID: S123456789", []),
    ("Login credentials: user1234, passw0rd", []),
    ("API key: 1234567890abcdef", []),
    ("WiFi password: p@ssw0rd123", ["PASSWORD"]),
    ("Credit card CVV: 123", []),
]


def test_sample_sentences(spark):
    values = spark.createDataFrame(
        [(i, text) for i, (text, _) in enumerate(GOLDEN)], "row_id int, value string"
    )
    found = {}
    for row in scan_values(values).collect():
        found.setdefault(row.row_id, set()).add(row.entity)
    assert [sorted(found.get(i, ())) for i in range(len(GOLDEN))] == [e for _, e in GOLDEN]


def test_column_names(spark):
    names = spark.createDataFrame(
        [("User_Name",), ("l_shipdate",), ("DOB",), ("city",), ("qty",), ("e-mail",)],
        "column_name string",
    )
    got = {r.column_name: (r.rule, r.tag, r.confidence) for r in scan_column_names(names).collect()}
    assert got == {
        "User_Name": ("USER_NAME", "Sensitive", 1.0),
        "l_shipdate": ("IP_ADDRESS", "Sensitive", 1.0),
        "DOB": ("BIRTH_DATE", "NonSensitive", 1.0),
        "city": ("ADDRESS", "NonSensitive", 1.0),
        "e-mail": ("EMAIL_ADDRESS", "Sensitive", 1.0),
    }


CLASS_CASES = [
    ("Aadhaar Card", "no 2345-6789-0123 x", "no 2345-6789-012 x"),
    ("Permanent Account Number", "ABCDE1234F", "ABCD1234F"),
    ("Election Photo ID Card", "abc1234567", "ab1234567"),
    ("Social Security Number", "123-45-6789", "123-456-78"),
    ("Social Insurance Number", "123 456 789", "123 456-789"),
    ("Permanent Resident Card", "1234-5678", "x 1234-5678"),
    ("Permanent Identity Card", "1234-5678", "1234 5678"),
    ("Resident ID Card", "110101200001011234", "110101190001011234"),
    ("British Passport", "P<GBRDOE<<JANE", "P<GBN DOE"),
    ("Indian Passport", "P<INDDOE<<JANE", "P<IN DOE"),
    ("United States Passport", "P<USADOE<<JANE", "P<US DOE"),
    ("Saudi Arabian Passport", "P<SAUDOE<<JANE", "P<SA DOE"),
    ("Saudi Driver's License", "\b1234567890\b", "1234567890"),
    ("Saudi Arabian Visa", "V<SAUDOE<<JANE", "V<SA DOE"),
    ("Tawuniya Health Insurance", "\b12345\b", "12345"),
    ("Nebraska Driver's License", "A123456789", "A12345678"),
    ("California Driver's License", "A12345678901", "a12345678901"),
    ("Maharashtra Driver's License", "MH12 123456789012", "MH12 12345678901"),
    ("Goa Driver's License", "GA07 12345678901", "GB07 12345678901"),
    ("Karnataka Driver's License", "GA07 12345678901", "KA07 12345678901"),
    ("Ukraine ID Card", "IDUKRDOE<<", "IDUK DOE"),
    ("Ukrainian Passport", "P<UKRDOE<<", "P<UK DOE"),
    ("Russian Passport", "P<RUSDOE<<", "P<RU DOE"),
    ("Russia Driver's License", "12 34 56789", "12 34 56789x"),
    ("Singaporean National Registration Identity Card", "s1234567d", "s123456d"),
    ("Singaporean Passport", "PASGP<<DOE<", "PASGP<DOE<"),
    ("South African Identity Card", "12345", "1234"),
    ("South African Passport", "PMZAF<<DOE<", "PMZAF DOE"),
    ("South Korean Passport", "PPKORDOE<", "PPKO DOE"),
    ("North Korean Passport", "PPPRKDOE<", "PPPR DOE"),
    ("Israeli Passport", "PMISRDOE<", "PMIS DOE"),
    ("Palestinian Passport", "PDPSEDOE<", "PDPS DOE"),
    ("Australian Passport", "PDPSEDOE<", "PDAU DOE"),
    ("Canadian Passport", "P<CANDOE<", "P<CA DOE"),
    ("Irish Public Services Card", "A1234567", "a1234567"),
]


def test_document_classes(spark):
    rows = [(i, hit, True) for i, (_, hit, _) in enumerate(CLASS_CASES)]
    rows += [(i, miss, False) for i, (_, _, miss) in enumerate(CLASS_CASES)]
    values = spark.createDataFrame(rows, "case int, value string, hit boolean")
    found = values.select("case", "hit", F.inline(class_identifiers(F.col("value")))).collect()
    names = [name for name, _, _ in CLASS_CASES]
    own = {(r.case, r.hit) for r in found if r["class"] == names[r.case]}
    assert own == {(i, True) for i in range(len(names))}
    assert set(names) == {c.name for c in DOCUMENT_CLASSES if c.has_identifier}


def test_user_rules_come_last(spark):
    added = spark.createDataFrame([("TICKET", "[A-Z]{2}-[0-9]+", 0.4)],
                                  "entity string, regex string, score double")
    values = spark.createDataFrame([(1, "see AB-12 and AB-3 by John Smith")], "row_id int, value string")
    got = scan_values(values, rules=COLUMN_RULES.with_rules(added)).collect()
    assert [(r.entity, r.nth, r.text) for r in got] == [
        ("PERSON", 0, "John Smith"), ("TICKET", 0, "AB-12"), ("TICKET", 1, "AB-3"),
    ]


HINTED = [
    (EMAIL_PATTERN, {"literals": ("@",)}),
    ("[0-9]{4} [0-9]{4}|-(x|y)", {"lead": "0-9\\-"}),
    (r"\b(?:\+\d{1,2}\s)?\(?\d{3}", {"lead": r"\+\(\d"}),
    ("(?:-a|b)?c-d", {"literals": ("c-d",)}),
    (r"(ab){0}c*d", {}),
    (r"(.)\1", {}),
    ("(?i)q-", {}),
    ("x*", {}),
    ("a|b@", {}),
    (r"\p{Lu}@", {}),
    ("[a&&b]@", {}),
]


def test_hints_of_user_rules_change_no_hit(spark):
    from hushmap.rules.values import Rule, Ruleset, own_hints

    for regex, hints in HINTED[:4] + HINTED[5:]:
        assert own_hints(regex) == hints, regex
    # Java's own forms stand aside, Python reads them otherwise or not at all.
    rules = [(f"R{n}", regex, 0.5) for n, (regex, _) in enumerate(HINTED)]
    texts = [
        "a.b'c@d.org @x.yz, me@here", "1234 5678 -x (555 +91 555", "-ac-d bc-d c-d abd dd", "aa Q-q- x@",
        "٣٣٣ ٤", "", None, "A@ É@ b@", "xx\nyy -y\n1234 5678",
    ]
    values = spark.createDataFrame(list(enumerate(texts)), "row_id int, value string")
    plain = Ruleset("plain", tuple(Rule(*rule) for rule in rules))
    hinted = Ruleset("hinted", ()).with_rules(rules)
    assert any(r.lead for r in hinted.rules) and any(r.literals for r in hinted.rules)
    got, want = (sorted(map(tuple, scan_values(values, rules=r).collect())) for r in (hinted, plain))
    assert got == want and {r[2] for r in got} >= {f"R{n}" for n in range(10)}


def test_first_rules_come_from_compiled_chains(spark, sf):
    rules = COLUMN_RULES.with_rules([("ANY", r"(.)\1", 0.1), ("MAIL", EMAIL_PATTERN, 0.2)])
    values = fixture(spark, sf, "value_shapes").select("row_id", "value").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "aa"), (-4, "1234\n")], "row_id long, value string")
    )
    found = scan_first(values, rules=rules)
    want = {}
    for r in scan_values(values, rules=rules).collect():
        want[r.row_id] = min(want.get(r.row_id, (99,)), (r.position, r.entity, r.score))
    assert {r.row_id: (r.position, r.entity, r.score) for r in found.collect()} == want
    # Functions of arrays are interpreted, row by row.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
