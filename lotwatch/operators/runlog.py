"""Totals of a run and the health of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.operators.quantiles import exact_median

SHOWN, ESCALATED = 2, 7


def totals(store: DataFrame) -> DataFrame:
    """active, median_gbp (exact; nulls skipped, zeros counted) and by_country of active listings; the median is found by counts, in jobs of its own."""
    active = store.filter("status = 'active'")
    middle = exact_median(active, "price.gbp")
    by = active.groupBy("country").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "count")))).alias("by_country"))
    return active.agg(F.count(F.lit(1)).alias("active"), F.round(F.lit(middle).cast("double"), 2).alias("median_gbp")).join(F.broadcast(by))  # a row each


def with_streaks(results: DataFrame, previous: DataFrame) -> DataFrame:
    """results(source, ok, ...) with consecutive_failures, carried on from the previous run's log."""
    before = previous.select("source", F.col("consecutive_failures").alias("_before"))
    streak = F.when(F.col("ok"), F.lit(0)).otherwise(F.coalesce("_before", F.lit(0)) + 1).cast("long")
    return results.join(before, "source", "left").withColumn("consecutive_failures", streak).drop("_before")


def streaks(runs: DataFrame, by: str = "source", order: str = "run") -> DataFrame:
    """runs(source, run, ok) with the failures in a row up to each run: islands between successes."""
    w = Window.partitionBy(by).orderBy(order)
    islands = runs.withColumn("_island", F.sum(F.col("ok").cast("int")).over(w))
    inside = Window.partitionBy(by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.count_if(~F.col("ok")).over(inside)).drop("_island")


def health(log: DataFrame) -> DataFrame:
    """Failing sources and whether to show or escalate them."""
    level = F.when(F.col("consecutive_failures") >= ESCALATED, "escalate").when(F.col("consecutive_failures") >= SHOWN, "show").otherwise("quiet")
    return log.filter("not ok").select("source", "note", "consecutive_failures", level.alias("level"))
