"""Full-state snapshots of each day as validity intervals, and the changes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(snapshots: DataFrame, state: list[str], key: str = "id", day: str = "snapshot_date") -> DataFrame:
    """key, state, valid_from, last_day, valid_to: runs of snapshots in a row that hold a key with the same state.

    valid_to is the day of the first snapshot that holds it no longer or
    otherwise, null while the last one does.  Snapshots may skip days: what
    counts is the one that follows.  Of a key that a snapshot holds twice the
    greatest state counts; nulls are states like others; rows without a key or
    a day are no part of a snapshot.
    """
    rows = snapshots.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, F.col(day).alias("_day")).agg(F.max(F.struct(*state)).alias("_state"))
    # One row a day: few, whatever a day holds.
    order = Window.orderBy("_day")
    days = snapshots.filter(F.col(day).isNotNull()).select(F.col(day).alias("_day")).distinct().withColumns({"_n": F.row_number().over(order), "_next": F.lead("_day").over(order)})
    w = Window.partitionBy(key).orderBy("_n")
    placed = rows.join(days, "_day")
    follows = F.coalesce((F.lag("_n").over(w) == F.col("_n") - 1) & F.lag("_state").over(w).eqNullSafe(F.col("_state")), F.lit(False))
    runs = placed.withColumn("_follows", follows).withColumn("_run", F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(w))
    out = runs.groupBy(key, "_run").agg(F.first("_state").alias("_state"), F.min("_day").alias("valid_from"), F.max("_day").alias("last_day"), F.max_by("_next", "_n").alias("valid_to"))
    return out.select(key, "_state.*", "valid_from", "last_day", "valid_to")


def changes(found: DataFrame, state: list[str], key: str = "id") -> DataFrame:
    """day, key, kind (new, changed, gone, back), before and after (structs of the state) of intervals."""
    w = Window.partitionBy(key).orderBy("valid_from")
    now = F.struct(*state)
    rows = found.withColumns({"_before": F.lag(now).over(w), "_ended": F.lag("valid_to").over(w), "_next": F.lead("valid_from").over(w), "_now": now, "_first": F.row_number().over(w) == 1})
    kind = F.when(F.col("_first"), "new").when(F.col("_ended") == F.col("valid_from"), "changed").otherwise("back")
    came = rows.select(F.col("valid_from").alias("day"), key, kind.alias("kind"), F.when(~F.col("_first"), F.col("_before")).alias("before"), F.col("_now").alias("after"))
    went = rows.filter(F.col("valid_to").isNotNull() & ~F.col("_next").eqNullSafe(F.col("valid_to")))
    return came.unionByName(went.select(F.col("valid_to").alias("day"), key, F.lit("gone").alias("kind"), F.col("_now").alias("before"), F.lit(None).cast(rows.schema["_now"].dataType).alias("after")))
