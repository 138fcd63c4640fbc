"""Verify detected values by check digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmap.functions.checksums import VERIFIED_ENTITIES, identify_entity


def verify_hits(hits: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Entities that the texts of verifiable hits turn out to be, per key, with their score.

    Texts that no validator accepts are reported as a null entity with score 0.
    """
    checked = hits.filter(F.col("entity").isin(VERIFIED_ENTITIES))
    return identify_entity(checked, "text", keys).distinct()
