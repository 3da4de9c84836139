"""Days and rows that land again: replayed, late or doubled ones count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotwatch.schemas import FX, INCOMING

#: How long after a day its rows may still land; its keys are remembered so long.
LATE = "7 days"


def noon(day: Column) -> Column:
    """Noon of a day, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(day) * 86400 + 43200)


def once(rows: DataFrame, day: str, keys: list[str], late: str = LATE) -> DataFrame:
    """A stream's rows, of those with equal keys the first to come; what comes later than `late` after the latest day is left out.

    Rows without a day are left out too: there is no telling when they may be forgotten.
    """
    return rows.filter(F.col(day).isNotNull()).withColumn("_at", noon(F.col(day))).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def rates(spark: SparkSession, landing: str, root: str, late: str = LATE) -> StreamingQuery:
    """Rates (FX) that land in a folder, one row a day, appended to root/rates; a correction of a day is an upsert (operators.fx), not a landing."""
    found = once(spark.readStream.schema(FX).parquet(landing), "date", ["date"], late)
    return found.writeStream.format("parquet").option("path", f"{root}/rates").option("checkpointLocation", f"{root}/_rates").trigger(availableNow=True).start()


def listings(spark: SparkSession, landing: str, root: str, late: str = LATE) -> StreamingQuery:
    """Listings (INCOMING and day) that land in a folder, one row for each id and day, appended to root/landed."""
    found = once(spark.readStream.schema(f"{INCOMING}, day date").parquet(landing), "day", ["id", "day"], late)
    return found.writeStream.format("parquet").option("path", f"{root}/landed").option("checkpointLocation", f"{root}/_landed").trigger(availableNow=True).start()
