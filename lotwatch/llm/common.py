"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.operators.files import shared_folder

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers anywhere can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lotwatch_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "lotwatch.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "lotwatch").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._lotwatch_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no extra column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def once(c: Column) -> Column:
    """c, evaluated where it stands: no filter or lambda above takes its expression in and runs it again for each element.

    The partition's number counts as not deterministic, which is what keeps the
    optimizer from moving the expression.
    """
    return F.when(F.spark_partition_id() >= 0, c)


#: Short rows that one file takes where their number is known.
ROWS_A_FILE = 200_000


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir, which all nodes share, and go on from the files there.

    `most`, if given, is a bound on its rows, which are short: they go into no
    more files than that needs.

    Unlike a checkpoint, files tell the optimizer their true size: a checkpoint
    keeps the estimate of the plan before it, which loops of joins multiply.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lotwatch-{uuid.uuid4().hex}"
    out = df if most is None else df.coalesce(max(1, min(partitions(spark), -(-most // ROWS_A_FILE))))
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(texts: Iterable[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, to bound what a task holds."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
