"""Rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half up of the number scaled as a double, as DuckDB rounds: 0.5025 is stored below the half and gives 0.502 for 3 places.

    Spark's own ``round`` takes the shortest decimal text of a double, so it gives 0.503.
    """
    scale = F.lit(10.0**places)
    return F.round(x * scale) / scale
