"""Small lists on the driver, whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame


def all_rows(df: DataFrame, most: int) -> list[tuple]:
    """Every row of a list that must have at most ``most`` of them; an error if it has more."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a list of more than {most} rows")
    return rows
