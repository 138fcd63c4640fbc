"""Document classes: an identifier pattern, a region and keywords for each kind of paper."""

from __future__ import annotations

from dataclasses import dataclass

from hushmap.rules.values import JAVA_FLAGS

MIN_CLASS_SCORE = 5
SIMILARITY_PERCENT = 80

# Patterns of e-mail addresses and phone numbers.
EMAIL_PATTERN = r"[A-Za-z0-9._+\-\']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = (
    r"((\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"
    r"|[0-9]{10}|\+{1}[0-9 ]{11,15}|[0-9]{4} [0-9]{6})"
)
# Cost hint: phone numbers, and identifiers of most classes, hold at least this run of digits.
DIGIT_RUN = JAVA_FLAGS + r"\d{3}"
NRIC = "Singaporean National Registration Identity Card"


@dataclass(frozen=True)
class DocumentClass:
    name: str
    regex: str | None
    region: str | None
    keywords: tuple[str, ...]
    literals: tuple[str, ...] = ()

    @property
    def digit_run(self) -> bool:
        """Whether every match holds a DIGIT_RUN."""
        return not self.literals and self.name not in _WITHOUT_DIGIT_RUN

    @property
    def has_identifier(self) -> bool:
        return self.regex is not None and self.region is not None

    def spark_regex(self) -> str:
        return JAVA_FLAGS + self.regex


# Class, pattern, region, keywords. Two patterns hold backspace characters
# (\x08) where word boundaries were meant; they are kept because results depend on them.
_CLASSES = [
    ("Email", EMAIL_PATTERN, None, []),
    (
        "Phone Number",
        PHONE_PATTERN,
        None,
        ["phone", "telephone", "tel", "contact", "whatsapp", "telegram", "sms"],
    ),
    (
        "Banking",
        None,
        None,
        [
            "bank",
            "bank account",
            "statement",
            "ifsc",
            "branch",
            "savings",
            "account number",
            "amount",
            "credit",
            "debit",
        ],
    ),
    (
        "Payment Card",
        None,
        None,
        [
            "visa",
            "mastercard",
            "amex",
            "american express",
            "rupay",
            "debit card",
            "credit card",
            "atm card",
            "bank",
            "valid",
            "expires",
            "expiry",
            "thru",
            "cvv",
        ],
    ),
    (
        "Aadhaar Card",
        r"([0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{12})",
        "India",
        [
            "Aadhaar",
            "UID",
            "UIDAI",
            "Unique",
            "Identification",
            "Authority",
            "Address",
            "Government of India",
        ],
    ),
    (
        "Permanent Account Number",
        r"[A-Z]{5}?[0-9]{4}[A-Z]",
        "India",
        ["PAN", "income", "tax", "permanent", "account", "department", "India", "Govt."],
    ),
    (
        "Election Photo ID Card",
        r"[A-Za-z]{3}[0-9]{7}",
        "India",
        ["Voter ID", "EPIC", "Election", "Commission", "India", "Constituency"],
    ),
    (
        "Social Security Number",
        r"[0-9]{3}-[0-9]{2}-[0-9]{3,4}",
        "United States",
        ["SSN", "USA", "Social", "Security"],
    ),
    (
        "Social Insurance Number",
        r"([0-9]{3}-[0-9]{3}-[0-9]{3}|[0-9]{3} [0-9]{3} [0-9]{3})",
        "Canada",
        [
            "Development Canada",
            "Insurance",
            "Social Insurance",
            "Numero",
            "D'Assurance",
            "Canada",
        ],
    ),
    (
        "Permanent Resident Card",
        r"^([0-9]{4}-[0-9]{4})$",
        "Canada",
        ["Permanent", "Resident", "Card", "Nationality", "Government", "Canada"],
    ),
    (
        "Permanent Identity Card",
        r"^([0-9]{4}-[0-9]{4})$",
        "Hong Kong",
        ["Permanent", "Identity", "Card", "Hong Kong"],
    ),
    (
        "Resident ID Card",
        r"[0-9]{6}20[0-9]{2}[0-1][0-9][0-3][0-9][0-9]{3}[0-9]{1,2}",
        "China",
        ["National ID", "Resident ID", "身份证"],
    ),
    (
        "British Passport",
        r"(?:P<GBR)(?:[A-Z0-9<].+)",
        "United Kingdom",
        ["Passport", "United", "Kingdom", "<<<<"],
    ),
    ("Indian Passport", r"(?:P<IND)(?:[A-Z0-9<].+)", "India", ["Passport", "India", "<<<<"]),
    (
        "United States Passport",
        r"(?:P<USA)(?:[A-Z0-9<].+)",
        "United States",
        ["Passport", "United", "States", "America", "<<<<"],
    ),
    (
        "Saudi Arabian Passport",
        r"(?:P<SAU)(?:[A-Z0-9<].+)",
        "Saudi Arabia",
        ["Passport", "Saudi Arabia", "SAU", "<<<<"],
    ),
    (
        "Resident Identity (Iqama)",
        None,
        "Saudi Arabia",
        [
            "Kingdom",
            "Saudi",
            "Arabia",
            "Ministry",
            "Interior",
            "Permit",
            "Iqama",
            "Residen",
            "Identity",
        ],
    ),
    (
        "Saudi Driver's License",
        r"\x08[0-9]{10}\x08",
        "Saudi Arabia",
        ["Kingdom", "Saudi", "Arabia", "Ministry", "Interior", "Driving", "License"],
    ),
    (
        "Saudi Arabian Visa",
        r"(?:V<SAU)(?:[A-Z0-9<].+)",
        "Saudi Arabia",
        [
            "Visa",
            "Saudi Arabia",
            "V<SAU",
            "<<<<",
            "Entries",
            "Permitted",
            "Work",
            "Validity",
        ],
    ),
    (
        "Tawuniya Health Insurance",
        r"\x08[0-9]{5}\x08",
        "Saudi Arabia",
        ["Tawuniya", "Policy", "Holder", "Number", "Deductible", "Approval"],
    ),
    (
        "Nebraska Driver's License",
        r"[A-Z]{1}[0-9]{9,11}",
        "United States",
        ["License", "Nebraska", "Operator", "Class"],
    ),
    (
        "California Driver's License",
        r"[A-Z]{1}[0-9]{9,11}",
        "United States",
        ["License", "California", "Driver", "Class"],
    ),
    (
        "Maharashtra Driver's License",
        r"[A-Z]{2}[0-9]{2} [0-9]{12}",
        "India",
        ["Licence", "Indian Union", "Driving", "Maharashtra", "Motor"],
    ),
    (
        "Goa Driver's License",
        r"GA[0-9]{2} \d{11}",
        "India",
        ["Licence", "Driving", "Indian Union", "Goa State", "Motor"],
    ),
    (
        "Karnataka Driver's License",
        r"GA[0-9]{2} \d{11}",
        "India",
        ["Licence", "Driving", "Indian Union", "Karnataka", "Motor"],
    ),
    (
        "UUID4",
        r"[a-f0-9]{8}-?[a-f0-9]{4}-?4[a-f0-9]{3}-?[89ab][a-f0-9]{3}-?[a-f0-9]{12}",
        None,
        [],
    ),
    (
        "Professional Resume",
        None,
        None,
        ["Experience", "Education", "Skill", "References", "Resume", "Work"],
    ),
    (
        "Ukraine ID Card",
        r"(?:IDUKR)(?:[A-Z0-9<].+)",
        "Ukraine",
        ["Ukraine", "Passport", "Citizen", "IDUKR", "<<"],
    ),
    (
        "Ukrainian Passport",
        r"(?:P<UKR)(?:[A-Z0-9<].+)",
        "Ukraine",
        ["Ukraine", "Passport", "Authority", "P<UKR", "<<"],
    ),
    (
        "Russian Passport",
        r"(?:P<RUS)(?:[A-Z0-9<].+)",
        "Russia",
        ["Rus", "Federation", "Passport", "P<RUS", "<<"],
    ),
    (
        "Russia Driver's License",
        r"^[0-9 ]{9,11}$",
        "Russia",
        ["4a)", "4b)", "4c)", "9.", "TOBEP"],
    ),
    (
        NRIC,
        r"(?i)[a-z0-9]{9}?",
        "Singapore",
        ["Identity Card No", "Singapura", "Republic of Singapore"],
    ),
    (
        "Singaporean Passport",
        r"(?:P<SGP|PASGP)<<(?:[A-Z0-9<].+)",
        "Singapore",
        ["Singapore Citizen", "SGP", "PA", "Passport"],
    ),
    (
        "South African Identity Card",
        r"^[0-9]{5,}$",
        "South Africa",
        ["South Africa", "Identity Number"],
    ),
    (
        "South African Passport",
        r"(?:P<ZAF|PMZAF)<<(?:[A-Z0-9<].+)",
        "South Africa",
        ["South Africa", "Republique", "ZAF", "Passport"],
    ),
    (
        "South Korean Passport",
        r"(?:P<KOR|PPKOR)(?:[A-Z0-9<].+)",
        "South Korea",
        ["Korea", "KOR", "Passport", "PM"],
    ),
    (
        "North Korean Passport",
        r"(?:P<PRK|PPPRK)(?:[A-Z0-9<].+)",
        "North Korea",
        ["PRK", "Pyongyang", "Korea", "Passport"],
    ),
    (
        "Israeli Passport",
        r"(?:P<ISR|PMISR)(?:[A-Z0-9<].+)",
        "Israel",
        ["Israel", "Passport", "ISR"],
    ),
    (
        "Palestinian Passport",
        r"(?:P<PSE|PDPSE)(?:[A-Z0-9<].+)",
        "Palestine",
        ["Palestinian", "Palestine", "Passport", "PSE"],
    ),
    (
        "Australian Passport",
        r"(?:P<PSE|PDPSE)(?:[A-Z0-9<].+)",
        "Australia",
        ["Australia", "Passport", "AUS", "Australian"],
    ),
    (
        "Canadian Passport",
        r"(?:P<CAN|PPCAN)(?:[A-Z0-9<].+)",
        "Canada",
        ["PPCAN", "P<CAN", "CAN", "<<<", "Passport", "Canadian"],
    ),
    (
        "Irish Public Services Card",
        r"[A-Z][0-9]{7}",
        "Ireland",
        ["Public", "Services", "Card", "Ireland", "Eire", "Carta", "Seirbhisi", "Poibli"],
    ),
]

# Cost hints: every match contains one of these texts.
_LITERALS = {
    "Email": ("@",),
    "British Passport": ("P<GBR",),
    "Indian Passport": ("P<IND",),
    "United States Passport": ("P<USA",),
    "Saudi Arabian Passport": ("P<SAU",),
    "Saudi Driver's License": ("\b",),
    "Saudi Arabian Visa": ("V<SAU",),
    "Tawuniya Health Insurance": ("\b",),
    "Goa Driver's License": ("GA",),
    "Karnataka Driver's License": ("GA",),
    "Ukraine ID Card": ("IDUKR",),
    "Ukrainian Passport": ("P<UKR",),
    "Russian Passport": ("P<RUS",),
    "Singaporean Passport": ("P<SGP", "PASGP"),
    "South African Passport": ("P<ZAF", "PMZAF"),
    "South Korean Passport": ("P<KOR", "PPKOR"),
    "North Korean Passport": ("P<PRK", "PPPRK"),
    "Israeli Passport": ("P<ISR", "PMISR"),
    "Palestinian Passport": ("P<PSE", "PDPSE"),
    "Australian Passport": ("P<PSE", "PDPSE"),
    "Canadian Passport": ("P<CAN", "PPCAN"),
}

_WITHOUT_DIGIT_RUN = {NRIC, "Russia Driver's License"}

DOCUMENT_CLASSES = [
    DocumentClass(name, regex, region, tuple(keywords), _LITERALS.get(name, ()))
    for name, regex, region, keywords in _CLASSES
]
