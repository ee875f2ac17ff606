"""The bound that operators on dimensions check."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most rows of a dimension: labels, profiles, aspects, candidates, names of a registry.
DIMENSION_ROWS = 50_000


def dimension(rows: DataFrame, what: str, most: int = DIMENSION_ROWS) -> DataFrame:
    """`rows`, after a check that they are few enough for one task or a broadcast."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{what} are a dimension of at most {most} rows")
    return rows
