"""Intermediate tables in the folder that all nodes share, and the package for the nodes' Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one, as in tests, gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not path and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return path or f"{tempfile.gettempdir()}/lotwatch-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers anywhere can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lotwatch_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "lotwatch_core.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "lotwatch").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._lotwatch_sent = True
