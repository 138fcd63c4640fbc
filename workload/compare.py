"""Results of both engines in one comparable form."""

from __future__ import annotations

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(value) for value in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple("" if v is None else "~" + v for v in row))


def _plain(value) -> str | None:
    """Whole numbers alike, whether a column with nulls came as floats or as integers."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        if value != value:
            return None
        return str(int(value)) if value.is_integer() else repr(round(float(value), 9))
    return str(value)
