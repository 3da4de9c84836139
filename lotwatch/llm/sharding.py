"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows (ids and sizes, never texts) are numbered once, and by a hash of that
number, which equal rows don't share, fall into parts.  With the parts'
counts known, the number of rows that each part sends to each block of each
shard is drawn from the multivariate hypergeometric law, under which a uniform
random permutation would send them.  Then every part permutes its rows and
deals them out by its row of the matrix, the rows are exchanged, and every
block permutes what it got: its rows take the block's slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table

#: Parts, and blocks of all shards together, are at most so many: the matrix has at most their product of cells.
MOST_PARTS = 1024
LEAST_PARTS, PART_ROWS = 16, 5000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn` of good + bad.

    numpy's sampler stops at 10 ** 9: beyond it the law is inverted over 12
    standard deviations, outside of which there is less than double precision
    can tell.
    """
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if good + bad else 0
    n = good + bad
    mean = drawn * good / n
    width = int(12 * math.sqrt(max(1.0, mean * bad / n))) + 30
    low, high = max(0, drawn - bad, int(mean) - width), min(good, drawn, int(mean) + width)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.r_[0.0, np.cumsum(steps)]
    p = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1]))


def matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Rows from each part to each block: row sums are counts, column sums capacities."""
    rng = np.random.default_rng(seed)
    left = np.array(capacities, np.int64)
    out = np.zeros((len(counts), len(left)), np.int64)
    for i, n in enumerate(counts):
        if left.sum() < 10**9:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, todo = int(left.sum()), n
            for j, c in enumerate(left.tolist()):
                rest -= c
                out[i, j] = hypergeometric(rng, c, rest, todo)
                todo -= int(out[i, j])
        left -= out[i]
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shards(docs: DataFrame, count: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs; law `rows`.

    Shards' row counts differ by one at most, slots are gapless from 0, and all
    permutations are equally likely, as far as a 64-bit hash of seed and number
    can tell; repeated rows and null ids are rows of their own and spread like
    any others.  The numbers follow the rows' places in the table's files, so
    the same files give the same shards.  A null text has no bytes; very long
    texts count whole; an empty table gives an empty result; other columns are
    ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Written, so that a row keeps its number whatever task reads it again.
    rows = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    n_parts = max(LEAST_PARTS, min(MOST_PARTS, rows.count() // PART_ROWS))

    def mixed(k: int):
        return F.xxhash64(F.lit(seed + k), "number")

    rows = rows.withColumn("part", F.pmod(mixed(0), F.lit(n_parts)).cast("int"))
    got = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # n_parts rows
    counts = [got.get(i, 0) for i in range(n_parts)]
    blocks = max(1, n_parts // count)
    capacities = [c for s in even(sum(counts), count) for c in even(s, blocks)]
    drawn = matrix(counts, capacities, seed)
    inner = np.array(capacities).reshape(count, blocks)
    start = (np.cumsum(inner, axis=1) - inner).ravel()
    sent = docs.sparkSession.sparkContext.broadcast((np.cumsum(drawn.ravel()), np.cumsum(counts) - counts, start))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, first, start = sent.value
        for b in batches:
            part = b.column("part").to_numpy()
            block = np.searchsorted(ends, first[part] + b.column("place").to_numpy(), "right") - part.astype(np.int64) * len(start)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("number"), pa.array(block.astype(np.int32)), pa.array(start[block])], ["doc_id", "size", "text_crc32", "number", "block", "start"])

    permuted = rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(mixed(1))).cast("long") - 1)
    dealt = permuted.mapInArrow(deal, "doc_id long, size long, text_crc32 long, number long, block int, start long")
    slot = F.col("start") + F.row_number().over(Window.partitionBy("block").orderBy(mixed(2))) - 1
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.floor(F.col("block") / blocks).cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
