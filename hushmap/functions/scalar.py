"""Column expressions shared by scans and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
NOT_AVAILABLE = "N/A"

# What two-decimal rounding of the ratio (2k + 1) / 200 gives for k = 0..99 in binary floating
# point: the only ratios where the last digit depends on the representation.
HALF_CENT_ROUNDED = [round((2 * k + 1) / 200, 2) for k in range(100)]


def dot_part(name: Column, n: int) -> Column:
    """n-th dot-separated part, '' when there is none."""
    return F.split_part(name, F.lit("."), F.lit(n))


def before_dot(name: Column) -> Column:
    """Text before the first dot, or all of it."""
    return F.substring_index(name, ".", 1)


def json_member(json: Column, member: str) -> Column:
    """Member of a JSON object as string; objects and arrays come back as JSON text."""
    return F.get_json_object(json, f"$.{member}")


def repaired_text(text: Column) -> Column:
    """Python-style literals turned into JSON: quotes, booleans, no trailing commas."""
    repaired = F.replace(text, F.lit("'"), F.lit('"'))
    repaired = F.replace(repaired, F.lit("False"), F.lit("false"))
    repaired = F.replace(repaired, F.lit("True"), F.lit("true"))
    return F.rtrim(repaired, F.lit(","))


def repair_json(text: Column) -> Column:
    """Repaired JSON text; null when it still does not parse."""
    repaired = repaired_text(text)
    return F.when(F.try_parse_json(repaired).isNotNull(), repaired)


def repaired_document(text: Column) -> Column:
    """Repaired JSON as a variant; null when it does not parse."""
    return F.try_parse_json(repaired_text(text))


def host_region(host: Column) -> Column:
    return _host_part(host, 3)


def host_source(host: Column) -> Column:
    return _host_part(host, 5)


def _host_part(host: Column, n: int) -> Column:
    parts = F.split(F.coalesce(host, F.lit("")), r"\.")
    return F.coalesce(F.try_element_at(parts, F.lit(n)), F.lit(NOT_AVAILABLE))


def iso_epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of a UTC time such as 2024-01-02T03:04:05.678Z."""
    parsed = F.try_to_timestamp(
        F.regexp_replace(text, "Z$", "+0000"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")
    )
    return F.unix_seconds(parsed)


def human_size(size: Column) -> Column:
    """Size with unit and no decimals; halves go to the even neighbour."""

    def scaled(power: int, unit: str) -> Column:
        return F.concat(
            F.bround(size / F.lit(float(KIB**power)), 0).cast("bigint").cast("string"),
            F.lit(f" {unit}"),
        )

    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < KIB**2, scaled(1, "KB"))
        .when(size < KIB**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def kilobytes(size: Column) -> Column:
    return size / F.lit(float(KIB))


def source_name(source_type: Column) -> Column:
    return F.trim(F.split_part(source_type, F.lit(","), F.lit(1)))


def sub_service_name(source_type: Column) -> Column:
    parts = F.split(source_type, ",")
    return F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), F.lit(NOT_AVAILABLE))


def confidence(top: Column, total: Column) -> Column:
    """top / total with two decimals, rounded as binary floating point rounds it."""
    half_cents = top * 200
    is_half_cent = (half_cents % total == 0) & (F.floor(half_cents / total) % 2 == 1)
    index = (F.floor(half_cents / total) / 2).cast("int") + 1
    table = F.array(*[F.lit(value) for value in HALF_CENT_ROUNDED])
    return F.when(is_half_cent, F.try_element_at(table, index)).otherwise(
        F.round(top / total, 2)
    )


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot, or the whole name."""
    return F.lower(F.substring_index(name, ".", -1))


def as_string(value: Column) -> Column:
    return value.cast("string")
