"""Check-digit and format validators for whole columns, as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmap.rules.values import JAVA_FLAGS

# The multiplication and permutation tables of the Verhoeff check digit.
VERHOEFF_PRODUCT = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_PERMUTATION = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

AADHAAR_FORMAT = "^[2-9][0-9]{11}$"
VID_FORMAT = "^[2-9][0-9]{15}$"
VOTER_ID_FORMAT = "^[A-Z]{3}[0-9]{7}$"
GST_FORMAT = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
# The fourth letter names the kind of holder; serial number 0000 is not issued.
PAN_FORMAT = "^[A-Z]{3}[ABCFGHJKLPT][A-Z](?!0000)[0-9]{4}[A-Z]$"
# Forms of account and phone numbers.
BANK_ACCOUNT_FORMAT = r"^\d{9,18}$"
PHONE_FORMAT = r"^(?:\+|0{0,2})91[\s-]?([789]\d{9}|(\d[ -]?){10}\d)$"

# The order in which entities are tried, with the score of each.
ENTITY_SCORES = [
    ("AADHAAR", 0.9),
    ("VOTERID", 0.9),
    ("GST_NUMBER", 0.9),
    ("PAN", 0.9),
    ("VID", 0.9),
    ("PHONE_NUMBER", 0.85),
    ("BANK_CARD", 0.9),
    ("BANK_ACCOUNT_NUMBER", 0.8),
]

# Detected entities whose texts are worth verifying.
VERIFIED_ENTITIES = [
    "AADHAAR",
    "PAN",
    "CREDIT_CARD",
    "VISA_CARD",
    "MASTER_CARD",
    "AMEX_CARD",
    "RUPAY_CARD",
    "MAESTRO_CARD",
    "VOTERID",
    "BANK_ACCOUNT_NUMBER",
    "PHONE_NUMBER",
    "GST_NUMBER",
    "MAC_ADDRESS",
]


def _matches(value: Column, regex: str) -> Column:
    return value.rlike(JAVA_FLAGS + regex)


def _compact(value: Column, separators: str) -> Column:
    for separator in separators:
        value = F.replace(value, F.lit(separator), F.lit(""))
    return value


def _flat(table: list[list[int]]) -> Column:
    return F.array(*[F.lit(cell) for row in table for cell in row])


def _reversed_codes(text: Column, alphabet: str) -> Column:
    """Alphabet positions of the characters, last character first."""
    return F.transform(
        F.split(F.reverse(text), ""), lambda c: F.instr(F.lit(alphabet), c).cast("int") - 1
    )


def verhoeff_ok(digits: Column) -> Column:
    """Whether a digit string ends in its Verhoeff check digit."""
    product, permutation = _flat(VERHOEFF_PRODUCT), _flat(VERHOEFF_PERMUTATION)
    codes = _reversed_codes(digits, "0123456789")

    def step(state: Column, code: Column) -> Column:
        at = (state["i"] % 8) * 10 + code
        permuted = F.element_at(permutation, at + 1)
        carried = F.element_at(product, state["c"] * 10 + permuted + 1)
        return F.struct((state["i"] + 1).alias("i"), carried.alias("c"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("c"))
    return F.aggregate(codes, start, step, lambda state: state["c"] == 0)


def luhn_ok(text: Column, alphabet: str = "0123456789") -> Column:
    """Whether a text over the alphabet ends in its Luhn (mod n) check character."""
    base = len(alphabet)
    codes = _reversed_codes(text, alphabet)

    def step(state: Column, code: Column) -> Column:
        doubled = code * 2
        folded = F.floor(doubled / base).cast("int") + doubled % base
        added = F.when(state["odd"], code).otherwise(folded)
        return F.struct((~state["odd"]).alias("odd"), (state["sum"] + added).alias("sum"))

    start = F.struct(F.lit(True).alias("odd"), F.lit(0).alias("sum"))
    return F.aggregate(codes, start, step, lambda state: state["sum"] % base == 0)


def _guarded(format_ok: Column, check: Column) -> Column:
    """The check digit is computed only for values of the right format."""
    return F.coalesce(F.when(format_ok, check), F.lit(False))


def is_aadhaar(value: Column) -> Column:
    number = _compact(value, " -")
    shape = _matches(number, AADHAAR_FORMAT) & (number != F.reverse(number))
    return _guarded(shape, verhoeff_ok(number))


def is_vid(value: Column) -> Column:
    number = _compact(value, " -")
    shape = _matches(number, VID_FORMAT) & (number != F.reverse(number))
    return _guarded(shape, verhoeff_ok(number))


def is_voter_id(value: Column) -> Column:
    number = F.upper(_compact(value, " "))
    return _guarded(_matches(number, VOTER_ID_FORMAT), luhn_ok(F.substring(number, 4, 7)))


def is_pan(value: Column) -> Column:
    return F.coalesce(_matches(F.upper(_compact(value, " -")), PAN_FORMAT), F.lit(False))


def is_gst(value: Column) -> Column:
    number = F.upper(_compact(value, " -"))
    shape = _matches(number, GST_FORMAT) & is_pan(F.substring(number, 3, 10))
    return _guarded(shape, luhn_ok(number, BASE36))


def is_bank_card(value: Column) -> Column:
    """Luhn over the digits once blanks and dashes are gone; any length, not all zeros."""
    number = F.regexp_replace(value, JAVA_FLAGS + r"[\s-]", "")
    shape = _matches(number, "^[0-9]+$") & number.rlike("[1-9]")
    return _guarded(shape, luhn_ok(number))


def is_bank_account(value: Column) -> Column:
    return F.coalesce(_matches(value, BANK_ACCOUNT_FORMAT), F.lit(False))


def is_phone(value: Column) -> Column:
    return F.coalesce(_matches(value, PHONE_FORMAT), F.lit(False))


VALIDATORS = {
    "AADHAAR": is_aadhaar,
    "VOTERID": is_voter_id,
    "GST_NUMBER": is_gst,
    "PAN": is_pan,
    "VID": is_vid,
    "PHONE_NUMBER": is_phone,
    "BANK_CARD": is_bank_card,
    "BANK_ACCOUNT_NUMBER": is_bank_account,
}


def entity_of(value: Column) -> Column:
    """First entity whose validator accepts the value, else null. All of them want digits."""
    choice = F.when(~_matches(value, r"\d"), F.lit(None).cast("string"))
    for entity, _ in ENTITY_SCORES:
        choice = choice.when(VALIDATORS[entity](value), entity)
    return choice


def entity_score(entity: Column) -> Column:
    """Score that goes with an accepted entity; 0 without one."""
    choice = F.when(entity.isNull(), 0.0)
    for name, score in ENTITY_SCORES:
        choice = choice.when(entity == name, score)
    return choice


def identify_entity(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep, entity, score) of the first validator that accepts each value, else (null, 0)."""
    identified = df.select(*keep, entity_of(F.col(col)).alias("entity"))
    return identified.withColumn("score", entity_score(F.col("entity")))
