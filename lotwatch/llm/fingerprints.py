"""Quartile bucket digests of texts and their bounded difference score.

Every byte triplet in a sliding window of five bytes is hashed into one of 256
buckets.  The digest is the length on a logarithmic scale, then two bits per
bucket: the quartile of its count among the buckets.  Two digests differ by the
sum over buckets of their quartile distances (opposite quartiles count double)
plus the difference of their lengths, bounded by what unrelated digests come to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import partitions, ship, table, text_of

BUCKETS = 256
#: Offsets of the triplets' bytes in the window of five.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
COST = np.array([0, 1, 2, 6], np.int64)
#: Where a row without an id stands: after all others.
NO_ID = -(2**63)
#: Score of unrelated digests: the mean cost of two random quartiles, for every bucket.
BOUND = BUCKETS * float((COST * [4, 6, 4, 2]).sum()) / 16
STEP = 1.15  # lengths whose digests differ by one


def byte_runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of runs of texts, of about `most` bytes, without a copy. Nulls count as empty."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def digests(column: pa.Array) -> list[str]:
    out: list[str] = []
    for data, ends in byte_runs(column):
        lengths = np.diff(ends)
        n = len(lengths)
        owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, lengths)
        parts = [data.astype(np.uint32) * f for f in FACTORS]
        counts = np.zeros(n * BUCKETS, np.int64)
        for k, (a, b, c) in enumerate(TRIPLETS):
            m = len(data) - c
            if m <= 0:
                continue
            h = parts[0][a : a + m] + parts[1][b : b + m] + parts[2][c : c + m] + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            inside = owner[:m] == owner[c:]
            counts += np.bincount((owner[:m] + (h >> np.uint32(24)))[inside], minlength=n * BUCKETS)
        table_ = counts.reshape(n, BUCKETS)
        ranked = np.sort(table_, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        code = sum((table_ > ranked[:, [q]]).astype(np.uint8) for q in range(3)).reshape(n, -1, 4)
        packed = code[:, :, 0] << 6 | code[:, :, 1] << 4 | code[:, :, 2] << 2 | code[:, :, 3]
        size = np.minimum(255, np.round(np.log1p(lengths) / np.log(STEP))).astype(np.uint8)
        raw = np.concatenate([size[:, None], packed.astype(np.uint8)], axis=1).tobytes().hex()
        w = 2 * (1 + BUCKETS // 4)
        out += [raw[i : i + w] for i in range(0, n * w, w)]
    return out


def likeness(left: pa.Array, right: pa.Array) -> np.ndarray:
    """1 - difference / bound, from 0 to 1, of digests in pairs."""

    def opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(len(column), -1)
        code = np.stack([raw[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(column), -1)
        return raw[:, 0].astype(np.int64), code.astype(np.int64)

    if not len(left):
        return np.zeros(0)
    (n, a), (m, b) = opened(left), opened(right)
    score = COST[np.abs(a - b)].sum(axis=1) + np.abs(n - m)
    return np.maximum(0.0, 1.0 - score / BOUND)


def with_next(docs: DataFrame, per_task: int = 4) -> DataFrame:
    """docs (doc_id, text) with its fingerprint, and text and fingerprint of the next one by descending doc_id.

    A global order without one task that holds all: ids are cut at their
    quantiles into ranges, `per_task` a shuffle partition, and each range also
    gets the first row of the one that follows.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns({"k": F.coalesce("doc_id", F.lit(NO_ID)), "h": F.xxhash64("text")})
    n = per_task * partitions(spark)
    found = keyed.select(F.col("k").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.1 / n)
    cuts = Bucketizer(splits=[-float("inf"), *(sorted(set(found)) or [0.0]), float("inf")], inputCol="d", outputCol="range")
    ranged = cuts.transform(keyed.withColumn("d", F.col("k").cast("double"))).withColumn("range", F.col("range").cast("int")).drop("d")
    # An id that fills several quantiles (or none at all, as the nulls') has as many ranges, by the text's hash; larger ids come before it.
    hot = {int(v): m for v, m in Counter(found).items() if m > 1 and (abs(v) < 2**53 or v == NO_ID)}
    part = F.lit(n)
    for v, m in hot.items():
        part = F.when(F.col("k") == v, m - 1 - F.floor((F.col("h").cast("double") / 2.0**63 + 1) / 2 * m * (1 - 1e-12))).otherwise(part)
    ranged = ranged.withColumn("range", (F.col("range") * (n + 1) + part).cast("int"))
    # At most 2 n rows come to the driver: the first key of each range.
    top = ranged.groupBy("range").agg(F.min(F.struct((-F.col("k").cast("decimal(20,0)")).alias("down"), "h", "k")).alias("top"))
    heads = sorted(((r["range"], r["top"]["k"], r["top"]["h"]) for r in top.collect()), reverse=True)
    follow = [(k, h, heads[i - 1][0]) for i, (_, k, h) in enumerate(heads)]
    schema = "k long, h long, follows int"
    first = ranged.join(F.broadcast(spark.createDataFrame(follow, schema)), ["k", "h"]).dropDuplicates(["k", "h", "follows"])
    both = ranged.withColumn("ahead", F.lit(0)).unionByName(first.withColumn("range", F.col("follows")).drop("follows").withColumn("ahead", F.lit(1)))

    @F.arrow_udf("string")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array(digests(text), pa.string())

    w = Window.partitionBy("range").orderBy("ahead", F.desc("k"), "h")
    both = both.withColumn("fingerprint", fingerprint("text"))
    return both.withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)}).filter("ahead = 0").drop("k", "h", "range", "ahead")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row's text and of its edited text, and their likeness.

    The edited text: the last floor(n_chars / 2) code points give way to the
    first as many of the next document by descending doc_id (ties: by a hash of
    the text; null ids come last; after the last comes the first).  A null text
    counts as empty; a text of fewer than three bytes has an even digest; a
    very long one is digested whole; a lone row follows itself, and so may
    rows equal in id and text; an empty table gives an empty result; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(text_of(docs)).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited", F.sha2("edited", 256).alias("edited_sha256"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("fingerprint")
            edited = pa.array(digests(b.column("edited")), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_chars"), b.column("edited_sha256"), own, edited, pa.array(likeness(own, edited)), pa.array(likeness(own, b.column("next_fingerprint")))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
