"""Changes along the observations of a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moves(observations: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each observation whose value differs from the one before it: old, new and percent (if neither is 0)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = observations.withColumns({"old": F.lag(value).over(w), "_n": F.row_number().over(w)})
    rows = rows.filter((F.col("_n") > 1) & ~F.col("old").eqNullSafe(F.col(value)))
    return rows.withColumnRenamed(value, "new").drop("_n")


def compacted(observations: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The first observation of each run of equal values."""
    w = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*values)
    rows = observations.withColumns({"_was": F.lag(state).over(w), "_n": F.row_number().over(w)})
    return rows.filter((F.col("_n") == 1) | ~F.col("_was").eqNullSafe(state)).drop("_was", "_n")
