"""The daily reconcile as a stream: every micro-batch of landed rows merges into the next version of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotwatch.operators.reconcile import reconcile
from lotwatch.operators.validate import seen_sources, source_counts, split
from lotwatch.schemas import INCOMING, LISTING
from lotwatch.sources.store import append, is_complete, read_or_empty, write_store


#: Where changes go whose table isn't named as they are.
TABLES = {"price_changed": "price_changes", "status_changed": "status_changes"}


def merge_batch(root: str, day_of: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: versions follow the batches' numbers, so a batch that is run again writes nothing twice, and one that died midway is written anew."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{root}/listings/version={number}"
        store = read_or_empty(spark, f"{root}/listings/version={number - 1}", LISTING)
        rows = batch.withColumn("ordinal", F.monotonically_increasing_id())
        good, _ = split(rows)
        # Only sources with a valid row make their listings age, so an outage withdraws nothing.
        out = reconcile(store, good, seen_sources(source_counts(rows)), day_of(number))
        if not is_complete(spark, done):  # else the batch died after it, or is run again
            write_store(out.store, root, str(number))
        for name in ("new", "price_changed", "status_changed", "possible_relists"):
            append(getattr(out, name), f"{root}/{TABLES.get(name, name)}", batch=str(number))

    return merge


def stream(spark: SparkSession, landing: str, root: str, day_of: Callable[[int], str], **trigger) -> StreamingQuery:
    """Start merging the Parquet files that land in a folder."""
    rows = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", 1).parquet(landing)
    return rows.writeStream.foreachBatch(merge_batch(root, day_of)).option("checkpointLocation", f"{root}/_stream").trigger(**(trigger or {"availableNow": True})).start()
