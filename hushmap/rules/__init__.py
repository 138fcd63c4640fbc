from hushmap.rules.documents import DOCUMENT_CLASSES, DocumentClass
from hushmap.rules.elements import DATA_ELEMENTS
from hushmap.rules.names import NAME_RULES, NameRule
from hushmap.rules.values import COLUMN_RULES, TEXT_RULES, Rule, Ruleset, ruleset

__all__ = [
    "COLUMN_RULES",
    "DATA_ELEMENTS",
    "DOCUMENT_CLASSES",
    "DocumentClass",
    "NAME_RULES",
    "NameRule",
    "Rule",
    "Ruleset",
    "TEXT_RULES",
    "ruleset",
]
