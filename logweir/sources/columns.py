"""Column-array payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_from_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Turn parallel arrays into rows, element i of each array into row i.

    Shorter arrays are padded with NULL.
    """
    return df.select(*(keep or []), F.inline(F.arrays_zip(*columns)))
