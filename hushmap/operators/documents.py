"""Contacts, identifiers and class of a text document."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.operators.detect import contains_any
from hushmap.operators.prepare import MIN_TOKEN_CHARS, TOKEN_BREAK, normalize_token
from hushmap.rules.documents import (
    DIGIT_RUN,
    DOCUMENT_CLASSES,
    EMAIL_PATTERN,
    MIN_CLASS_SCORE,
    PHONE_PATTERN,
    SIMILARITY_PERCENT,
    DocumentClass,
)
from hushmap.rules.values import JAVA_FLAGS
from hushmap.session import local_table, scratch_path

# Matched tokens are at most half as long again as the longest keyword, so this many rows of
# them are a few megabytes, fit to be broadcast.
MOST_BROADCAST = 50_000
# Parts that each token is dealt into where they are shuffled.
SALTS = 16
CLASS_SLOTS = 1024
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _distinct_matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(JAVA_FLAGS + regex), F.lit(group))
    )


def emails(text: Column) -> Column:
    """Distinct e-mail addresses in order of appearance."""
    found = _distinct_matches(text, EMAIL_PATTERN)
    return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def phones(text: Column) -> Column:
    """Distinct phone numbers, and the country prefixes captured with them."""
    both = F.array_union(
        _distinct_matches(text, PHONE_PATTERN, 1), _distinct_matches(text, PHONE_PATTERN, 2)
    )
    found = F.filter(both, lambda p: p != "")
    return F.when(text.rlike(DIGIT_RUN), found).otherwise(F.array().cast("array<string>"))


def class_identifiers(
    text: Column, exclude: Sequence[str] = (), everywhere: bool = False
) -> Column:
    """array<struct<class_position, class, found>> of the regional classes that hit.

    ``everywhere`` takes in the classes that belong to no region. One look for a run of digits
    stands before the patterns that need one.
    """
    placed = [
        (place, rule)
        for place, rule in enumerate(DOCUMENT_CLASSES)
        if (rule.has_identifier or everywhere and rule.regex) and rule.name not in exclude
    ]
    digits = [(p, r) for p, r in placed if r.digit_run and r.region is not None]
    others = [(p, r) for p, r in placed if (p, r) not in digits]
    groups = []
    if digits:
        groups.append(F.when(text.rlike(DIGIT_RUN), _class_hits(text, digits)))
    if others:
        groups.append(_class_hits(text, others))
    return F.sort_array(F.flatten(F.array_compact(F.array(*groups))))


def _class_hits(text: Column, placed: list[tuple[int, DocumentClass]]) -> Column:
    per_class = [
        F.struct(
            F.lit(place).alias("class_position"),
            F.lit(rule.name).alias("class"),
            _identifier_matches(text, rule).alias("found"),
        )
        for place, rule in placed
    ]
    return F.filter(F.array(*per_class), lambda c: F.size(c["found"]) > 0)


def _identifier_matches(text: Column, rule: DocumentClass) -> Column:
    found = _distinct_matches(text, rule.regex)
    return F.when(contains_any(text, rule.literals), found) if rule.literals else found


def extract_emails(df: DataFrame, col: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    return df.select(*ids, F.explode(emails(F.col(col))).alias("email"))


def extract_phones(df: DataFrame, col: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    return df.select(*ids, F.explode(phones(F.col(col))).alias("phone"))


def extract_identifiers(
    df: DataFrame,
    col: str = "text",
    ids: Sequence[str] = ("doc_id",),
    exclude: Sequence[str] = (),
    everywhere: bool = False,
) -> DataFrame:
    """Distinct identifiers per document and class (ids, class_position, class, identifier).

    The pattern of one class, NRIC, takes any nine letters or digits; ``exclude`` leaves
    classes out. ``everywhere`` takes in the classes without a region, such as UUIDs.
    """
    found = class_identifiers(F.col(col), exclude, everywhere)
    return df.select(*ids, F.inline(found)).select(
        *ids, "class_position", "class", F.explode("found").alias("identifier")
    )


def similar(token: str, keyword: str) -> bool:
    ratio = SequenceMatcher(None, token, keyword).ratio()
    return ratio * 100 > SIMILARITY_PERCENT


@F.pandas_udf(T.BooleanType())
def _similar_pairs(tokens: pd.Series, keywords: pd.Series) -> pd.Series:
    return pd.Series(
        [similar(token, keyword) for token, keyword in zip(tokens, keywords, strict=True)],
        dtype=bool,
    )


def _keyword_rows() -> list[tuple[int, str, str]]:
    return [
        (position, rule.name, keyword.lower())
        for position, rule in enumerate(DOCUMENT_CLASSES)
        for keyword in rule.keywords
    ]


def _letters(token: Column) -> Column:
    """Bit set of the ASCII letters and digits of a text."""
    bits = [
        F.when(token.contains(letter), F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint")
        for place, letter in enumerate(LETTERS)
    ]
    return reduce(lambda left, right: left.bitwiseOR(right), bits)


def _keywords_by_token_length(spark: SparkSession) -> DataFrame:
    """Distinct keywords per length a similar token can have, with what that allows.

    With m matched characters the similarity is 2m / (a + b). It exceeds 80 % only if m is
    more than 0.4 (a + b), which bounds the characters left over on either side, and with
    them the edits between the two texts.
    """
    keywords = sorted({keyword for _, _, keyword in _keyword_rows()})
    longest = max(len(keyword) for keyword in keywords)
    rows = []
    for keyword in keywords:
        bits = sum(1 << place for place, letter in enumerate(LETTERS) if letter in keyword)
        for size in range(1, 2 * longest):
            both = size + len(keyword)
            matched = 4 * both // 10 + 1
            if matched <= min(size, len(keyword)):
                left_over = (len(keyword) - matched, size - matched)
                rows.append((size, keyword, bits, *left_over, (both - 1) // 5))
    return local_table(
        spark,
        rows,
        token_length=pa.int32(),
        keyword=pa.string(),
        keyword_letters=pa.int64(),
        keyword_spare=pa.int32(),
        token_spare=pa.int32(),
        max_edits=pa.int32(),
    )


def similar_tokens(vocabulary: DataFrame) -> DataFrame:
    """Pairs (token, keyword) of a distinct-token table that are more than 80 % similar.

    Each token meets the keywords of its length band. Bounds on the letters that only one side
    has, then on the edit distance, drop nearly all of those pairs within the join; only the
    rest is compared block by block.
    """
    keywords = F.broadcast(_keywords_by_token_length(vocabulary.sparkSession))
    measured = vocabulary.select(
        "token", F.length("token").alias("token_length"), _letters(F.col("token")).alias("letters")
    )
    close = F.expr(
        "bit_count(keyword_letters & ~letters) <= keyword_spare "
        "AND bit_count(letters & ~keyword_letters) <= token_spare "
        "AND levenshtein(token, keyword, max_edits) >= 0"
    )
    return (
        measured.join(keywords, "token_length")
        .filter(close)
        .filter((F.col("token") == F.col("keyword")) | _similar_pairs("token", "keyword"))
        .select("token", "keyword")
    )


def normal_tokens(text: Column) -> Column:
    """Tokens of a text in the form in which they are compared with keywords."""
    long = F.filter(F.split(text, TOKEN_BREAK), lambda t: F.length(t) >= MIN_TOKEN_CHARS)
    return F.transform(long, normalize_token)


def token_histogram(df: DataFrame, col: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows (ids, token, n) of the distinct tokens of each document, counted in its row.

    Equal tokens are neighbours once sorted, so their number is the distance between first ones.
    """
    sorted_in = df.select(F.struct(*ids).alias("ids"), F.sort_array(normal_tokens(F.col(col))).alias("s"))
    place = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))
    firsts = F.filter(place, lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    counted = F.transform(
        "h",
        lambda i, k: F.struct(
            F.get("s", i).alias("token"), (F.coalesce(F.get("h", k + 1), F.size("s")) - i).alias("n")
        ),
    )
    rows = sorted_in.withColumn("h", firsts).select("ids", F.explode_outer(counted).alias("e"))
    return rows.where("e.token IS NOT NULL").select(
        *[F.col("ids").getField(c).alias(c) for c in ids], "e.token", "e.n"
    )


def keyword_scores(
    df: DataFrame,
    col: str = "text",
    ids: Sequence[str] = ("doc_id",),
    exact: bool = False,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Per document and class the number of (token, keyword) pairs that are similar.

    Similarity is decided once per distinct token of the corpus. The tokens that match are written
    to the shared folder and counted. Up to ``most_broadcast`` rows of them are broadcast to the
    documents' tokens; more are shuffled with the documents' token histograms, every token in SALTS
    parts, so that one which stands in every document is spread. Classes without a pair have no row.
    """
    spark = df.sparkSession
    classes = local_table(
        spark,
        _keyword_rows(),
        class_position=pa.int32(),
        **{"class": pa.string()},
        keyword=pa.string(),
    )
    occurrences = (
        df.select(*ids, F.explode(F.split(col, TOKEN_BREAK)).alias("token"))
        .filter(F.length("token") >= MIN_TOKEN_CHARS)
        .withColumn("token", normalize_token(F.col("token")))
    )
    if exact:
        pairs = classes.select("keyword", F.col("keyword").alias("token")).distinct()
    else:
        pairs = similar_tokens(occurrences.select("token").distinct())
    per_token = (
        pairs.join(F.broadcast(classes), "keyword")
        .groupBy("token", "class_position", "class")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
    path = scratch_path(spark, "matched-tokens")
    per_token.write.parquet(path)
    matched = spark.read.schema(per_token.schema).parquet(path)
    if matched.count() <= most_broadcast:
        joined = occurrences.withColumn("n", F.lit(1)).join(F.broadcast(matched), "token")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")
        joined = (
            token_histogram(df, col, ids)
            .withColumn("_salt", salt)
            .join(matched.withColumn("_salt", salts), ["token", "_salt"])
        )
    return joined.groupBy(*ids, "class_position", "class").agg(
        F.sum(F.col("pairs") * F.col("n")).alias("score")
    )


def classify_documents(scores: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First class with the highest score and its country; no class below the minimum score."""
    # Score and place in one number: its maximum is the highest score of the earliest class.
    ranked = F.col("score") * CLASS_SLOTS + (CLASS_SLOTS - 1 - F.col("class_position"))
    classes = local_table(
        scores.sparkSession,
        [(place, rule.name, rule.region) for place, rule in enumerate(DOCUMENT_CLASSES)],
        class_position=pa.int32(),
        **{"class": pa.string()},
        country_of_origin=pa.string(),
    )
    best = scores.groupBy(*keys).agg(F.max(ranked).alias("_best"))
    place = (CLASS_SLOTS - 1 - F.col("_best") % CLASS_SLOTS).cast("int")
    return (
        best.withColumn("class_position", place)
        .withColumn("score", F.floor(F.col("_best") / CLASS_SLOTS))
        .join(F.broadcast(classes), "class_position")
        .select(
            *keys,
            F.when(F.col("score") >= MIN_CLASS_SCORE, F.col("class")).alias("pii_class"),
            "score",
            "country_of_origin",
        )
    )


def document_report(
    df: DataFrame,
    col: str = "text",
    path: str = "doc_id",
    exclude: Sequence[str] = (),
    addresses: DataFrame | None = None,
) -> DataFrame:
    """One report per document: class, score, country, identifiers of the first class that
    hits, e-mails and phone numbers.

    ``addresses`` (path, addresses array) comes from a user model, see ``scan_with_model``.
    """
    nothing = F.array().cast("array<string>")
    text = F.col(col)
    contacts = df.select(
        F.col(path).alias("file_path"),
        F.try_element_at(class_identifiers(text, exclude), F.lit(1))["found"].alias("_found"),
        emails(text).alias("emails"),
        phones(text).alias("phone_numbers"),
    )
    scored = df.select(F.col(path).alias("file_path"), text.alias("text"))
    classes = classify_documents(keyword_scores(scored, "text", ["file_path"]), ["file_path"])
    report = contacts.join(classes, "file_path", "left")
    if addresses is None:
        report = report.withColumn("addresses", nothing)
    else:
        report = report.join(addresses, "file_path", "left")
    return report.select(
        "file_path",
        "pii_class",
        F.coalesce("score", F.lit(0)).alias("score"),
        "country_of_origin",
        F.lit(0).alias("faces"),
        F.coalesce("_found", nothing).alias("identifiers"),
        "emails",
        "phone_numbers",
        F.coalesce("addresses", nothing).alias("addresses"),
    )
