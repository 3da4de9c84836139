"""The store, change log, run log and rates as Parquet in versioned folders: a run never writes where it reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.operators import fx


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to path was finished: a job that died leaves files, but not the mark of its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_store(store: DataFrame, root: str, version: str) -> str:
    """A new version, by source so that relists read only their own, newest first within a file; what a job that died left of it gives way."""
    path = f"{root}/listings/version={version}"
    if is_complete(store.sparkSession, path):
        raise ValueError(f"{path} is there already")
    store.sortWithinPartitions("source", F.desc("first_seen"), F.desc("id")).write.mode("overwrite").partitionBy("source").parquet(path)
    return path


def newest_first(store: DataFrame) -> DataFrame:
    """The store in its order: first seen and id, both descending."""
    return store.orderBy(F.desc("first_seen"), F.desc("id"))


def latest_run(spark: SparkSession, path: str, schema: str, key: str = "run") -> DataFrame:
    """Rows of the last run that a log of runs holds; an empty table where there is none."""
    rows = read_or_empty(spark, path, f"{schema}, {key} string")
    last = rows.agg(F.max(key).alias(key))
    return rows.join(F.broadcast(last), key).drop(key)  # one row


def append(df: DataFrame, path: str, **keys: str) -> None:
    """Rows of one run, in its own partition, which a rerun replaces."""
    rows = df.withColumns({k: F.lit(v) for k, v in keys.items()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_rates(spark: SparkSession, log: DataFrame, day: DataFrame, path: str) -> DataFrame:
    """The rates with that day's in the place of earlier ones, written to a new path in order of date."""
    fx.upsert(log, day).orderBy("date").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
