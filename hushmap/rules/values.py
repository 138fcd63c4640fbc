"""Value patterns: which texts count as which entity, with what score.

Two rule lists exist. ``column`` serves table columns, ``text`` serves documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from re import _parser

from pyspark.sql import DataFrame

# Patterns follow Python's reading of a regex: word characters, digits and blanks are
# Unicode classes, and only a line feed ends a line.
JAVA_FLAGS = "(?dU)"

MAX_USER_RULES = 10_000

# Fixed value: state codes at the head of ration cards and vehicle numbers.
STATE_CODES = (
    "AN|AP|AR|AS|BR|CH|CT|DN|DD|DL|GA|GJ|HR|HP|JK|JH|KA|KL|LD|MP|MH|MN|ML|MZ|NL|OR|PY|PB|"
    "RJ|SK|TN|TG|TR|UP|UT|UK|WB"
)

# Fixed value: IPv4 or IPv6.
IP_ADDRESS = (
    r"^(?:(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    r"(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"
    r"|((([0-9A-Fa-f]{1,4}:){7}([0-9A-Fa-f]{1,4}|:))"
    r"|(([0-9A-Fa-f]{1,4}:){1,6}:([0-9A-Fa-f]{1,4}|:))"
    r"|(([0-9A-Fa-f]{1,4}:){1,5}:([0-9A-Fa-f]{1,4}:){1,1}([0-9A-Fa-f]{1,4}|:))"
    r"|(([0-9A-Fa-f]{1,4}:){1,4}:([0-9A-Fa-f]{1,4}:){1,2}([0-9A-Fa-f]{1,4}|:))"
    r"|(([0-9A-Fa-f]{1,4}:){1,3}:([0-9A-Fa-f]{1,4}:){1,3}([0-9A-Fa-f]{1,4}|:))"
    r"|(([0-9A-Fa-f]{1,4}:){1,2}:([0-9A-Fa-f]{1,4}:){1,4}([0-9A-Fa-f]{1,4}|:))"
    r"|([0-9A-Fa-f]{1,4}:([0-9A-Fa-f]{1,4}:){1,5}([0-9A-Fa-f]{1,4}|:))"
    r"|(:((:[0-9A-Fa-f]{1,4}){1,6}))"
    r"|(::(ffff(:0{1,4})?:)?((25[0-5]|(2[0-4]|1{0,1}[0-9])?[0-9])\.){3,3}"
    r"(25[0-5]|(2[0-4]|1{0,1}[0-9])?[0-9])"
    r"|([0-9A-Fa-f]{1,4}:){1,4}:([0-9]{1,3}\.){3}[0-9]{1,3})))$"
)


@dataclass(frozen=True)
class Rule:
    """One pattern.

    The optional fields never change what is found, only what it costs:

    * ``max_length``: longest text a whole-value pattern can match, in characters.
    * ``literals``: a match contains at least one of these.
    * ``lead``: characters a match can start with, as the inside of a character class.
    * ``search``: an equivalent pattern that is linear in the text; group 1 is the match.
    * ``loose``: a pattern without back-references that matches wherever ``regex`` does.
    """

    entity: str
    regex: str
    score: float
    max_length: int | None = None
    literals: tuple[str, ...] = ()
    lead: str | None = None
    search: str | None = None
    loose: str | None = None

    @property
    def whole_value(self) -> bool:
        return self.max_length is not None

    @property
    def hinted(self) -> bool:
        """Whether a cheap test can tell that the rule does not hit."""
        return self.whole_value or bool(self.lead or self.search)

    @property
    def may_be_empty(self) -> bool:
        """Whether the pattern may match no character, as patterns of users can."""
        return _parser.parse(self.search or self.regex).getwidth()[0] == 0

    @property
    def trial(self) -> str:
        """Pattern that is found in every text the rule hits, fit for an alternation."""
        return self.loose or self.regex

    @property
    def group(self) -> int:
        return 1 if self.search else 0

    def spark_regex(self, flags: str = "") -> str:
        if self.search:
            return f"{JAVA_FLAGS}{flags}(?m){self.search}"
        lead = f"(?=[{self.lead}])" if self.lead else ""
        return f"{JAVA_FLAGS}{flags}{lead}{self.regex}"


@dataclass(frozen=True)
class Ruleset:
    """An ordered rule list; a rule's position breaks ties."""

    name: str
    rules: tuple[Rule, ...]
    flags: str = field(default="")

    def __post_init__(self) -> None:
        # A linear form stands for its pattern as it is, not for the pattern under other flags.
        if self.flags:
            plain = tuple(replace(r, search=None) if r.search else r for r in self.rules)
            object.__setattr__(self, "rules", plain)

    @property
    def entities(self) -> list[str]:
        return list(dict.fromkeys(rule.entity for rule in self.rules))

    def only(self, *entities: str) -> Ruleset:
        return replace(self, rules=tuple(r for r in self.rules if r.entity in entities))

    def with_rules(self, rules: DataFrame | Iterable[tuple[str, str, float]]) -> Ruleset:
        """Append user rules (entity, regex, score), with cost hints read off their patterns.

        Patterns have to be literals of the plan so that each task compiles them once, so a
        rule DataFrame is read to the driver. More than MAX_USER_RULES rows raise an error: a plan
        does not hold more patterns.
        """
        if isinstance(rules, DataFrame):
            rows = rules.select("entity", "regex", "score").limit(MAX_USER_RULES + 1).collect()
            if len(rows) > MAX_USER_RULES:
                raise ValueError(f"more than {MAX_USER_RULES} user rules")
            rules = [(row.entity, row.regex, row.score) for row in rows]
        added = tuple(
            Rule(entity, regex, float(score), **own_hints(regex)) for entity, regex, score in rules
        )
        return replace(self, rules=self.rules + added)


# What user patterns may hold to get hints: escapes that Python and Java read alike, no flags, no
# names, no look-around, no class inside a class.
_PLAIN = re.compile(
    r"(?:\\[dswbDSWB]|\\[^A-Za-z0-9]|\(\?:|\((?!\?)|[)|^$.*+?]|\{\d+(?:,\d*)?\}"
    r"|\[\^?(?:\\[dsw]|\\[^A-Za-z0-9]|[^\\\[\]&^])+\]|[^\\\[\](){}|^$.*+?])*"
)
_CATEGORIES = {
    _parser.CATEGORY_DIGIT: r"\d",
    _parser.CATEGORY_SPACE: r"\s",
    _parser.CATEGORY_WORD: r"\w",
}


def own_hints(regex: str) -> dict:
    """``lead`` of a pattern whose matches start with few kinds of character, or else ``literals``
    with what all its matches hold; nothing for a pattern that tells neither."""
    if not regex.isascii() or not _PLAIN.fullmatch(regex):
        return {}
    try:
        parsed = _parser.parse(regex)
    except (re.error, OverflowError):
        return {}
    if parsed.getwidth()[0] == 0:
        return {}
    lead, _ = _lead(parsed)
    # Letters and blanks are nearly everywhere.
    if lead and not re.search(f"[{lead}]", "abcdefghijklmnopqrstuvwxyz "):
        return {"lead": lead}
    held = max(_held(parsed), key=len, default="")
    return {"literals": (held,)} if held.strip() else {}


def _lead(parts) -> tuple[str | None, bool]:
    """Inside of a character class with all first characters, or None if some are not known; and
    whether the parts may match nothing."""
    lead = ""
    for kind, of in parts:
        own, empty = _lead_of(kind, of)
        if own is None:
            return None, False
        lead += own
        if not empty:
            return lead, False
    return lead, True


def _lead_of(kind, of) -> tuple[str | None, bool]:
    if kind is _parser.AT:
        return "", True
    if kind is _parser.LITERAL:
        return _escaped(of), False
    if kind is _parser.IN:
        out = ""
        for inner, value in of:
            if inner is _parser.LITERAL:
                out += _escaped(value)
            elif inner is _parser.RANGE:
                out += f"{_escaped(value[0])}-{_escaped(value[1])}"
            elif inner is _parser.CATEGORY and value in _CATEGORIES:
                out += _CATEGORIES[value]
            else:
                return None, False
        return out, False
    if kind is _parser.SUBPATTERN:
        return _lead(of[3])
    if kind is _parser.BRANCH:
        found = [_lead(branch) for branch in of[1]]
        if any(own is None for own, _ in found):
            return None, False
        return "".join(own for own, _ in found), any(empty for _, empty in found)
    if kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT):
        own, empty = _lead(of[2])
        return own, empty or of[0] == 0
    return None, False


def _escaped(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() else "\\" + c if c.isprintable() and c != " " else f"\\x{code:02x}"


def _held(parts) -> list[str]:
    """Runs of literal characters that every match holds."""
    runs, run = [], ""
    for kind, of in parts:
        if kind is _parser.LITERAL:
            run += chr(of)
            continue
        runs, run = [*runs, run], ""
        if kind is _parser.SUBPATTERN:
            runs += _held(of[3])
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and of[0] > 0:
            runs += _held(of[2])
    return [r for r in [*runs, run] if r]


# Entity, score in the column list, score in the text list (None: not in that
# list), pattern.
SHARED_PATTERNS = [
    ("AADHAAR", 0.8, 0.85, r"^([2-9][0-9]{3})([-\s]?(\d{4})){2}$"),
    ("PAN", 0.9, 0.9, r"^[A-Z]{5}[0-9]{4}[A-Z]$"),
    ("VISA_CARD", 0.9, 0.9, r"^(4\d{3}([-\s]?(\d{4})){3})$"),
    (
        "MASTER_CARD",
        0.9,
        0.9,
        r"^(?:5[1-5]\d{2}|2(2[2-9][1-9]|[3-6]\d{2}|7[01]\d|720))([-\s]?(\d{4})){3}$",
    ),
    ("AMEX_CARD", 0.9, 0.9, r"^(3[47]\d{2})([-\s]?)\d{6}\2\d{5}$"),
    ("RUPAY_CARD", 0.9, 0.9, r"^(?:6[05]\d{2}|8[12]\d{2}|508\d|35[36]\d)([-\s]?(\d{4})){3}$"),
    (
        "MAESTRO_CARD",
        0.9,
        0.9,
        r"^(?:5[0678]\d{2}|6013|6[237]\d{2})([-\s]?)\d{4}\1\d{4}\1\d{4}\1\d{0,3}$",
    ),
    ("IP_ADDRESS", 0.9, 0.9, IP_ADDRESS),
    (
        "MAC_ADDRESS",
        0.8,
        0.8,
        r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$|^([0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}$"
        r"|^[0-9A-Fa-f]{12}$|^([0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}$",
    ),
    ("VOTERID", 0.9, 0.9, r"^[A-Z]{3}[0-9]{7}$"),
    ("PASSPORT", 0.9, 0.9, r"^[A-PR-WY-Z][0-9]{7}$"),
    ("DRIVERLICENSE", 0.9, 0.9, r"^([A-Z]{2}[0-9]{2})([ -])([0-9]{4})[0-9]{7}$"),
    ("BANK_ACCOUNT_NUMBER", 0.8, 0.75, r"^\d{9,18}$"),
    ("IFSC", 0.9, 0.9, r"^[A-Z]{4}0[A-Z0-9]{6}$"),
    ("RATION_CARD_NUMBER", 0.9, 0.9, rf"^({STATE_CODES})[0-9]{{10}}$"),
    (
        "VEHICLE_IDENTIFICATION_NUMBER",
        0.9,
        0.9,
        rf"^({STATE_CODES})[ -]?[0-9]{{2}}[ -]?[A-Z]{{1,2}}[ -]?[0-9]{{4}}$",
    ),
    ("UPI_ID", 0.9, 0.9, r"^[0-9A-Za-z.-]{2,256}@[A-Za-z]{2,64}$"),
    ("GST_NUMBER", 0.9, 0.9, r"^\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]$"),
    ("PERSON", 0.9, None, r"\b[A-Z][a-z]+\b \b[A-Z][a-z]+\b"),
    ("GENDER", 0.9, 0.9, r"\b(Male|Female|Other|M|F|O)\b"),
    (
        "NATIONALITY",
        0.9,
        0.9,
        r"\b(Indian|American|British|Canadian|Australian|Nationality)\b",
    ),
    (
        "ADDRESS",
        0.9,
        0.9,
        r"\b\d{1,5}\s\w+\s(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr|Drive)\b",
    ),
    ("ZIPCODE", 0.9, None, r"\b[1-9][0-9]{5}\b(?!\.\d+)"),
    ("ZIPCODE", None, 0.9, r"\b\d{5}(-\d{4})?\b"),
    (
        "PASSWORD",
        0.9,
        0.9,
        r"\b(?=.*\d)(?=.*[a-z])(?=.*[A-Z])(?=.*[@#$%^&+=]).{8,}\b",
    ),
    ("POBOX", 0.9, 0.9, r"\bPO Box \d{1,5}\b"),
    ("PHONE_NUMBER", 0.9, 0.9, r"\b\d{3}[-. ]?\d{3}[-. ]?\d{4}\b"),
    ("TITLE", 0.9, 0.9, r"\b(Mr|Mrs|Miss)\b"),
    ("CVV", 0.9, None, r"^(?!000$|999$|0000$|9999$)[0-9]{3,4}(?![\s\W])$"),
    ("CVV", None, 0.9, r"^(?!000$|999$|0000$|9999$)[0-9]{3,4}$"),
    ("IMEI", 0.9, 0.9, r"^\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{6}[-\s]?\d{1}$"),
    ("IMSI", 0.9, 0.9, r"^(404|405)(40|44|82|71)\d{10,12}$"),
    (
        "UID",
        0.9,
        None,
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    ),
    (
        "DATE_TIME",
        0.9,
        None,
        r"\b((\d{4}[-/.]\d{2}[-/.]\d{2})|(\d{2}[-/.]\d{2}[-/.]\d{4}))\s*"
        r"(([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?(\s?(AM|PM))?)?\b",
    ),
]

# Cost hints, see Rule. Longest match per whole-value pattern:
MAX_LENGTHS = {
    "AADHAAR": 14,
    "PAN": 10,
    "VISA_CARD": 19,
    "MASTER_CARD": 19,
    "AMEX_CARD": 17,
    "RUPAY_CARD": 19,
    "MAESTRO_CARD": 23,
    "IP_ADDRESS": 39,
    "MAC_ADDRESS": 17,
    "VOTERID": 10,
    "PASSPORT": 8,
    "DRIVERLICENSE": 16,
    "BANK_ACCOUNT_NUMBER": 18,
    "IFSC": 11,
    "RATION_CARD_NUMBER": 12,
    "VEHICLE_IDENTIFICATION_NUMBER": 13,
    "UPI_ID": 321,
    "GST_NUMBER": 15,
    "CVV": 4,
    "IMEI": 20,
    "IMSI": 17,
    "UID": 36,
}

HINTS = {
    "AMEX_CARD": {"loose": r"^3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}$"},
    "MAESTRO_CARD": {"loose": r"^(?:5[0678]|60|6[237])\d{2}([-\s]?\d{4}){3}[-\s]?\d{0,3}$"},
    "PERSON": {"lead": "A-Z"},
    "GENDER": {"lead": "MFO"},
    "NATIONALITY": {
        "lead": "IABCN",
        "literals": ("Indian", "American", "British", "Canadian", "Australian", "Nationality"),
    },
    "ADDRESS": {"lead": r"\d"},
    "ZIPCODE": {"lead": r"\d"},
    # Every match starts at the first word character of a line and ends at its last word
    # boundary, and a line that fails there fails everywhere. Tried at each boundary, the
    # look-aheads would cost the square of the line length.
    "PASSWORD": {
        "search": r"^[^\w\n]*+((?=[^\n]*\d)(?=[^\n]*[a-z])(?=[^\n]*[A-Z])"
        r"(?=[^\n]*[@#$%^&+=])[^\n]{8,}\b)"
    },
    "POBOX": {"lead": "P", "literals": ("PO Box ",)},
    "PHONE_NUMBER": {"lead": r"\d"},
    "TITLE": {"lead": "M", "literals": ("Mr", "Miss")},
    "DATE_TIME": {"lead": r"\d"},
}


def _rules(score_column: int) -> tuple[Rule, ...]:
    return tuple(
        Rule(
            entity=row[0],
            regex=row[3],
            score=row[score_column],
            max_length=MAX_LENGTHS.get(row[0]),
            **HINTS.get(row[0], {}),
        )
        for row in SHARED_PATTERNS
        if row[score_column] is not None
    )


COLUMN_RULES = Ruleset("column", _rules(1))
TEXT_RULES = Ruleset("text", _rules(2))


def ruleset(name: str) -> Ruleset:
    try:
        return {"column": COLUMN_RULES, "text": TEXT_RULES}[name]
    except KeyError:
        raise ValueError(f"unknown ruleset {name!r}, expected 'column' or 'text'") from None
