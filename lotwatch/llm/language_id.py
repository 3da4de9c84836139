"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 2- and 3-grams of lower-cased letters (runs of other characters are
one space) are taken over all labelled rows and summed by Spark; the matrix of
log-probabilities (buckets x languages, a size fixed by two parameters) is
broadcast, and each batch is scored by gathering its rows in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import chunks, cut, ship, table, text_of

BITS = 14
#: More labels than this are refused: the matrix must stay small enough to broadcast.
MOST_LANGUAGES = 500
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, index of its text, and whether each text has a letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    letter = _letters()[points]
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    # Keep letters, and the first of each run of other characters as a space.
    keep = letter | np.r_[True, letter[:-1]] if len(letter) else letter
    c, owner = np.where(letter, points, 32)[keep].astype(np.uint32), owner[keep]
    buckets, owners = [], []
    for k, n in enumerate((2, 3)):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, k * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        same = owner[:m] == owner[n - 1 :]
        buckets.append((h >> np.uint32(32 - BITS))[same])
        owners.append(owner[:m][same])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), lettered
    return np.concatenate(buckets), np.concatenate(owners), lettered


def train(docs: DataFrame, smoothing: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (buckets x languages) and log-priors from text and lang of docs.

    Every row with a language counts; null texts count for the prior alone.
    """
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            at = 0
            for part in chunks(x.as_py() for x in b.column(0)):
                names, which = np.unique(np.array(langs[at : at + len(part)], object), return_inverse=True)
                at += len(part)
                bucket, owner, _ = grams(part)
                for i, name in enumerate(names):
                    mine = bucket[which[owner] == i]
                    sums[name] = sums.get(name, 0) + np.bincount(mine, minlength=size)
                    rows[name] = rows.get(name, 0) + int((which == i).sum())
        for name, total in sums.items():
            at = np.flatnonzero(total)
            # Bucket -1 holds the number of rows.
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows[name], total[at]].astype(np.int64))], ["lang", "bucket", "n"])

    labelled = docs.filter(F.col("lang").isNotNull())
    counted = cut(labelled.select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # (MOST_LANGUAGES + 1) * (2 ** BITS + 1) short rows at most, as Arrow.
    priors = counted.filter("bucket = -1").limit(MOST_LANGUAGES + 1).toPandas()
    if len(priors) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(priors["lang"])
    at = {x: i for i, x in enumerate(languages)}
    cells = counted.filter("bucket >= 0").toArrow().to_pandas()
    matrix = np.full((size, len(languages)), smoothing)
    matrix[cells["bucket"].to_numpy(), cells["lang"].map(at).to_numpy(dtype=np.int64)] += cells["n"].to_numpy()
    prior = priors.set_index("lang")["n"].reindex(languages).to_numpy(dtype=float)
    return languages, np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum())


def predict(docs: DataFrame, languages: list[str], log_probability: np.ndarray, log_prior: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the posterior) of every row; `und` and 0 without a letter or a learned language."""
    sent = docs.sparkSession.sparkContext.broadcast((languages, log_probability.astype(np.float32), log_prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_, prior = sent.value
        for b in batches:
            best, sure = [], []
            for part in chunks(x.as_py() for x in b.column(1)):
                bucket, owner, lettered = grams(part)
                total = np.tile(prior, (len(part), 1))
                for i in range(len(names)):
                    total[:, i] += np.bincount(owner, table_[:, i][bucket], len(part))
                if not names:
                    best += [UNKNOWN] * len(part)
                    sure += [0.0] * len(part)
                    continue
                top = total.argmax(axis=1)
                p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best += [names[k] if ok else UNKNOWN for k, ok in zip(top, lettered, strict=True)]
                sure += np.where(lettered, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_of(docs).mapInArrow(score, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Learned from text and non-null lang of rows whose crc32(doc_id as text) mod
    4 is not 2 (a null id: neither learned from nor held out).  Null, empty and
    letterless texts give `und` with score 0, as do all rows if no row is
    labelled; very long texts count whole; repeated rows count and return each
    time; ties go to the first language by name; an empty table gives an empty
    result; other columns are ignored.
    """
    ship(docs.sparkSession)
    part = F.crc32(F.col("doc_id").cast("long").cast("string")) % 4
    model = train(docs.filter(part != 2).select("text", F.col("lang").cast("string").alias("lang")))
    found = predict(docs, *model)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
