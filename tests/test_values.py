"""Check digits against plain loops, and scalar functions at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from hushmap.functions import checksums, scalar
from hushmap.operators.verify import verify_hits


def luhn(text, alphabet="0123456789"):
    total = 0
    for i, c in enumerate(reversed(text)):
        code = alphabet.index(c) * (1 + i % 2)
        total += sum(divmod(code, len(alphabet)))
    return total % len(alphabet) == 0


def verhoeff(digits):
    """The check by the group it stands for: the symmetries of a pentagon."""

    def multiply(a, b):
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    start = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    state = 0
    for i, c in enumerate(reversed(digits)):
        code = int(c)
        for _ in range(i % 8):
            code = start[code]
        state = multiply(state, code)
    return state == 0


def evaluate(spark, validator, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r.value: r.ok for r in df.select("value", validator(F.col("value")).alias("ok")).collect()}


@pytest.mark.parametrize(
    ("validator", "good", "bad"),
    [
        (checksums.is_aadhaar, ["2341 2341 2346", "2341-2341-2346"], ["234123412347", "2341", ""]),
        (checksums.is_voter_id, ["ABC1234566"], ["ABC1234567", "AB1234566"]),
        (checksums.is_gst, ["27AAPFU0939F1ZV", "27aapfu0939f1zv"], ["27AAPFU0939F1ZW", "27AAPFU0939F1YV"]),
        (checksums.is_pan, ["ACUPA7085R", "acupa 7085-r"], ["ACUPA7085RR", "ACUDA7085R", "ACUPA0000R"]),
        (checksums.is_bank_card, ["4111 1111 1111 1111", "0018", "79927398713"],
         ["4111 1111 1111 1112", "0000", "", "x18", "-"]),
        (checksums.is_bank_account, ["123456789"], ["12345678", "1234567890123456789"]),
        (checksums.is_phone, ["+919876543210", "0091-9876543210", "91 1 2 3 4 5 6 7 8 9 0 1"],
         ["9876543210", "+92 9876543210"]),
    ],
)
def test_validators(spark, validator, good, bad):
    got = evaluate(spark, validator, good + bad)
    assert got == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_check_digits_agree_with_plain_loops(spark):
    rng = random.Random(7)
    twelve = [str(rng.randint(2, 9)) + f"{rng.randrange(10**11):011d}" for _ in range(2000)]
    got = evaluate(spark, checksums.is_aadhaar, twelve)
    assert got == {v: verhoeff(v) and v != v[::-1] for v in twelve}
    sixteen = [str(rng.randint(2, 9)) + f"{rng.randrange(10**15):015d}" for _ in range(2000)]
    assert evaluate(spark, checksums.is_vid, sixteen) == {v: verhoeff(v) for v in sixteen}
    cards = [str(rng.randrange(1, 10 ** rng.randint(1, 25))) for _ in range(2000)]
    assert evaluate(spark, checksums.is_bank_card, cards) == {v: luhn(v) for v in cards}
    gst = [f"29ABCPK{rng.randrange(1, 10000):04d}Z1Z{c}" for c in checksums.BASE36 for _ in range(40)]
    assert evaluate(spark, checksums.is_gst, gst) == {v: luhn(v, checksums.BASE36) for v in gst}
    for values in (got, evaluate(spark, checksums.is_gst, gst)):
        assert any(values.values()) and not all(values.values())


def test_entity_order_and_scores(spark):
    values = [
        ("234123412346", "AADHAAR", 0.9),
        ("ABC1234566", "VOTERID", 0.9),
        ("27AAPFU0939F1ZV", "GST_NUMBER", 0.9),
        ("ACUPA7085R", "PAN", 0.9),
        ("+919876543210", "PHONE_NUMBER", 0.85),
        ("4111111111111111", "BANK_CARD", 0.9),
        ("123456789", "BANK_ACCOUNT_NUMBER", 0.8),
        ("hello", None, 0.0),
        ("hello 12", None, 0.0),
    ]
    df = spark.createDataFrame([(v,) for v, _, _ in values], "value string")
    got = checksums.identify_entity(df, "value", ["value"]).collect()
    assert {(r.value, r.entity, r.score) for r in got} == set(values)


def test_verify_keeps_listed_entities(spark):
    hits = spark.createDataFrame(
        [(1, "PAN", "ACUPA7085R"), (1, "VISA_CARD", "4111111111111112"), (1, "PERSON", "John Smith"),
         (2, "AADHAAR", "234123412346")],
        "row_id int, entity string, text string",
    )
    got = {(r.row_id, r.entity, r.score) for r in verify_hits(hits).collect()}
    assert got == {(1, "PAN", 0.9), (1, "BANK_ACCOUNT_NUMBER", 0.8), (2, "AADHAAR", 0.9)}


def test_confidence_rounds_as_python_does(spark):
    pairs = [(a, b) for b in range(1, 401) for a in range(1, b + 1)]
    df = spark.createDataFrame(pairs, "top bigint, total bigint")
    got = df.select("top", "total", scalar.confidence(F.col("top"), F.col("total")).alias("c"))
    assert all(r.c == round(r.top / r.total, 2) for r in got.collect())


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1536, 2560, 3584, 1048575, 1048576, 1073741824, 3 * 2**29]
    want = ["0 B", "1023 B", "1 KB", "2 KB", "2 KB", "4 KB", "1024 KB", "1 MB", "1 GB", "2 GB"]
    df = spark.createDataFrame([(s,) for s in sizes], "size bigint")
    got = {r.size: r.t for r in df.select("size", scalar.human_size(F.col("size")).alias("t")).collect()}
    assert [got[s] for s in sizes] == want


def test_dotted_names_hosts_and_sources(spark):
    df = spark.createDataFrame(
        [("a.b.c", "db.c1.eu.rds.aws.com", " s3 , lake "), ("", "", "s3"), (".x", None, ",")],
        "name string, host string, kind string",
    )
    got = df.select(
        scalar.dot_part(F.col("name"), 4),
        scalar.before_dot(F.col("name")),
        scalar.host_region(F.col("host")),
        scalar.host_source(F.col("host")),
        scalar.source_name(F.col("kind")),
        scalar.sub_service_name(F.col("kind")),
    ).collect()
    assert [tuple(row) for row in got] == [
        ("", "a", "eu", "aws", "s3", "lake"),
        ("", "", "N/A", "N/A", "s3", "N/A"),
        ("", "", "N/A", "N/A", "", ""),
    ]


def test_json_repair_and_times(spark):
    df = spark.createDataFrame(
        [("{'a': True, 'b': 'x'},,", "2024-01-02T03:04:05.5Z"), ("{'a': 'it's'}", "2024-01-02"), (None, None)],
        "json string, time string",
    )
    got = df.select(scalar.repair_json(F.col("json")), scalar.iso_epoch_seconds(F.col("time"))).collect()
    assert [tuple(row) for row in got] == [
        ('{"a": true, "b": "x"}', 1704164645), (None, None), (None, None),
    ]
