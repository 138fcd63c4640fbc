"""SQL fragments that find pattern hits in the checking engine.

Its regexes know no look-around or back-references and take word boundaries as ASCII. Letters
outside ASCII are therefore masked by '_' where boundaries matter, and the few patterns that
do not exist there are put as equivalent SQL.
"""

from __future__ import annotations

import re

from hushmap.rules import COLUMN_RULES, TEXT_RULES, Rule, Ruleset
from workload.fixtures import text

WORD = r"\p{L}\p{M}\p{N}_"
MASK = "regexp_replace(value, '[^\\P{L}a-zA-Z]', '_', 'g')"

AMEX = r"^3[47]\d{2}(\d{11}|-\d{6}-\d{5}| \d{6} \d{5})$"
MAESTRO_HEAD = r"^(?:5[0678]\d{2}|6013|6[237]\d{2})"


def matches(rule: Rule, list_name: str) -> str:
    """SQL list of the texts a rule finds in column ``value``."""
    if rule.entity == "AMEX_CARD":
        return f"regexp_extract_all(value, {text(AMEX)})"
    if rule.entity == "MAESTRO_CARD":
        forms = "|".join(
            rf"{sep}\d{{4}}{sep}\d{{4}}{sep}\d{{4}}{sep}\d{{0,3}}" for sep in ("", "-", " ")
        )
        return f"regexp_extract_all(value, {text(f'{MAESTRO_HEAD}(?:{forms})$')})"
    if rule.entity == "CVV":
        return (
            "CASE WHEN value IN ('000', '999', '0000', '9999') THEN [] "
            "ELSE regexp_extract_all(value, '^[0-9]{3,4}$') END"
        )
    if rule.entity == "ZIPCODE" and list_name == "column":
        # A decimal part is marked by chr(1) and marked numbers are left out.
        marked = rf"regexp_replace({MASK}, '\.(\d)', chr(1) || '\1', 'g')"
        found = rf"regexp_extract_all({marked}, '\b[1-9][0-9]{{5}}\b' || chr(1) || '?')"
        return f"list_filter({found}, lambda x: NOT contains(x, chr(1)))"
    if rule.entity == "ADDRESS":
        doubled = f"regexp_replace(value, '([^{WORD}])', '\\1\\1', 'g')"
        inner = rule.regex.replace(r"\b", "").replace(r"\s", r"\s\s").replace(r"\w", f"[{WORD}]")
        found = (
            f"regexp_extract_all({doubled}, "
            f"{text(f'(?:^|[^{WORD}])({inner})(?:$|[^{WORD}])')}, 1)"
        )
        return rf"list_transform({found}, lambda x: regexp_replace(x, '(\s)\s', '\1', 'g'))"
    if rule.entity == "PASSWORD":
        return PASSWORD_MATCHES
    if r"\b" in rule.regex:
        return f"regexp_extract_all({MASK}, {text(rule.regex)})"
    return f"regexp_extract_all(value, {text(rule.regex)})"


# Per line: from the first to the last word character, if what follows the first one holds all
# four kinds of character.
_LINE_REST = f"regexp_replace(x, '^[^{WORD}]*', '')"
_LINE_BODY = f"regexp_replace({_LINE_REST}, '[^{WORD}]*$', '')"
_LINE_HITS = (
    f"regexp_matches({_LINE_REST}, '[0-9]') AND regexp_matches({_LINE_REST}, '[a-z]') "
    f"AND regexp_matches({_LINE_REST}, '[A-Z]') AND regexp_matches({_LINE_REST}, '[@#$%^&+=]') "
    f"AND length({_LINE_BODY}) >= 8"
)
PASSWORD_MATCHES = (
    f"list_transform(list_filter(string_split(value, chr(10)), lambda x: {_LINE_HITS}), "
    f"lambda x: {_LINE_BODY})"
)


def hits(rules: Ruleset, source: str, ids: list[str]) -> str:
    """SQL for all hits of a rule list in table ``source`` with column ``value``."""
    keys = ", ".join(ids)
    parts = []
    for position, rule in enumerate(rules.rules):
        found = matches(rule, rules.name)
        parts.append(
            f"SELECT {keys}, {position} AS position, {text(rule.entity)} AS entity, "
            f"CAST({rule.score} AS DOUBLE) AS score, "
            f"unnest(range(len(found))) AS nth, unnest(found) AS text "
            f"FROM (SELECT {keys}, {found} AS found FROM {source}) AS t"
        )
    return "\nUNION ALL\n".join(parts)


def column_hits(source: str, ids: list[str]) -> str:
    return hits(COLUMN_RULES, source, ids)


def text_hits(source: str, ids: list[str]) -> str:
    return hits(TEXT_RULES, source, ids)


def confidence(top: str, total: str) -> str:
    """top / total with two decimals, halves as binary floating point rounds them."""
    table = "[" + ", ".join(str(round((2 * k + 1) / 200, 2)) + "::DOUBLE" for k in range(100)) + "]"
    return (
        f"CASE WHEN ({top} * 200) % {total} = 0 AND (({top} * 200) // {total}) % 2 = 1 "
        f"THEN {table}[(({top} * 200) // {total}) // 2 + 1] "
        f"ELSE round({top}::DOUBLE / {total}, 2) END"
    )


def label_sql(source: str, keys: list[str], order: str = "row_id, position") -> str:
    """Label by count with confidence and entity list, as CTEs ending in ``labels``."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = t.{x}" for x in keys)
    return f"""
counts AS (
  SELECT {k}, entity, count(*) AS n, min(row({order})) AS seen, max(score) AS score
  FROM {source} GROUP BY {k}, entity),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, seen) AS rn,
         sum(n) OVER (PARTITION BY {k}) AS total FROM counts),
lists AS (
  SELECT {k}, string_agg(entity || ':' || n, '|' ORDER BY seen) AS entities
  FROM counts GROUP BY {k}),
labels AS (
  SELECT {", ".join("c." + x for x in keys)}, c.entity AS highest_label,
         {confidence("c.n", "c.total::BIGINT")} AS confidence_score, t.entities
  FROM ranked c JOIN lists t ON {on} WHERE rn = 1)"""


def spans(rules: Ruleset, source: str, ids: list[str]) -> str:
    """SQL for all hits with their offsets: entity, start, end, score, text."""
    keys = ", ".join(ids)
    parts = []
    for rule in rules.rules:
        found = matches(rule, rules.name)
        if rule.whole_value:
            starts = f"list_transform({found}, lambda x: 0)"
        elif rule.entity == "PASSWORD":
            lines = "string_split(value, chr(10))"
            good = f"list_filter(range(len({lines})), lambda i: len(list_filter([{lines}[i + 1]], lambda x: {_LINE_HITS})) > 0)"
            before = f"list_sum(list_transform({lines}[1:i], lambda x: length(x) + 1))"
            skipped = f"list_transform([{lines}[i + 1]], lambda x: length(x) - length({_LINE_REST}))[1]"
            starts = f"list_transform({good}, lambda i: coalesce({before}, 0) + {skipped})"
        elif rule.entity == "ADDRESS":
            inner = rule.regex.replace(r"\b", "").replace(r"\s", r"\s\s").replace(r"\w", f"[{WORD}]")
            doubled = f"regexp_replace(value, '([^{WORD}])', '\\1\\1', 'g')"
            around = f"(?:^|[^{WORD}])({inner})(?:$|[^{WORD}])"
            bare = f"(?:^|[^{WORD}])(?:{inner})(?:$|[^{WORD}])"
            whole = f"regexp_extract_all({doubled}, {text(around)}, 0)"
            group = f"regexp_extract_all({doubled}, {text(around)}, 1)"
            at = _starts(f"regexp_split_to_array({doubled}, {text(bare)})", whole)
            # A doubled prefix, with the character before the match, has each other character twice.
            head = f"left({doubled}, {at}[i] + strpos({whole}[i], {group}[i]) - 1)"
            starts = (
                f"list_transform(range(1, len({whole}) + 1), lambda i: length({head}) - "
                f"length(regexp_replace({head}, '[{WORD}]', '', 'g')) // 2)"
            )
        else:
            regex = re.sub(r"\((?!\?)", "(?:", rule.regex)
            starts = _starts(f"regexp_split_to_array({MASK}, {text(regex)})", found)
        parts.append(
            f"SELECT {keys}, {text(rule.entity)} AS entity, CAST(start AS INT) AS start, "
            f'CAST(start + length(text) AS INT) AS "end", CAST({rule.score} AS DOUBLE) AS score, text '
            f"FROM (SELECT {keys}, unnest({starts}) AS start, unnest({found}) AS text FROM {source}) AS t"
        )
    return "\nUNION ALL\n".join(parts)


def _starts(pieces: str, found: str) -> str:
    """Offsets of matches, from the pieces around them."""
    return (
        f"list_transform(range(1, len({found}) + 1), lambda i: CAST("
        f"coalesce(list_sum(list_transform(({pieces})[1:i], lambda s: length(s))), 0) + "
        f"coalesce(list_sum(list_transform(({found})[1:i - 1], lambda s: length(s))), 0) AS BIGINT))"
    )
