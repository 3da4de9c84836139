"""Keep-first deduplication and unions in a given order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key in that order (ties are settled by the order alone, so give a total one)."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_turn(frames: list[DataFrame], ordinal: str = "ordinal") -> DataFrame:
    """The union of frames with the number of the frame that a row comes from."""
    return reduce(DataFrame.unionByName, [f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames)])
