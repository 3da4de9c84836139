"""Whitening of embeddings: streaming covariance, then a symmetric QR eigen-solve.

Every partition holds n, sums, mean and sum of squared deviations of the rows
that it has met, updated row by row (Welford, a rank-one update); the states
are merged by the parallel update formula, groups of bounded size at a time,
until one is left.  Its covariance's eigenvectors come from QR steps with
shifts.  The same pass over the whitened rows says how far their covariance is
from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table
from lotwatch.llm.vectors import matrix, padded, whole

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of x beyond count as this, so that sums stay whole numbers of 64 bits.
MOST = 1 << 31
#: States that are merged by one task.
FAN = 32
#: Eigenvalues below this share of the largest are nought in double precision: their components aren't whitened.
NOUGHT = 1e-13


@dataclass
class Moments:
    """n, whole sums, mean, and sum of products of deviations."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    squares: np.ndarray

    @classmethod
    def none(cls, d: int) -> "Moments":
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update by each row in turn."""
        step = np.empty_like(self.squares)
        for x in rows.astype(float):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, x - self.mean, out=step)
            self.squares += step
        if rows.dtype == np.int64:
            self.sums += rows.sum(0)

    def merge(self, other: "Moments") -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.squares += other.squares + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.sums += other.sums
        self.n = n


STATE = "part long, n long, sums array<long>, mean array<double>, squares array<double>"


def states(frame: pd.DataFrame, d: int) -> Iterator[Moments]:
    for r in frame.itertuples():
        yield Moments(r.n, np.array(r.sums), np.array(r.mean), np.array(r.squares).reshape(d, d))


def row(part: int, m: Moments) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [m.n], "sums": [m.sums], "mean": [m.mean], "squares": [m.squares.ravel()]})


def moments(x: DataFrame, width: int, d: int, of: Callable[[np.ndarray], np.ndarray] = lambda rows: rows) -> Moments:
    """Moments of of(rows) (d columns) of all rows of x (arrays of this width); one state of d * d numbers reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments.none(d)
        for b in batches:
            m.add(of(matrix(b.column("x"), width)))
        yield pa.RecordBatch.from_pandas(row(0, m), preserve_index=False)

    got = cut(x.select("x").mapInArrow(run, STATE).withColumn("part", F.spark_partition_id().cast("long")))
    while (n := got.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).first())["n"] > 1:
        fan = FAN if n["last"] >= FAN else n["last"] + 1

        def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            m = Moments.none(d)
            for other in states(frame.sort_values("part"), d):
                m.merge(other)
            return row(key[0], m)

        got = cut(got.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part").applyInPandas(merged, STATE))
    return next(states(got.toPandas(), d), Moments.none(d))


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by shifted QR steps.

    Each step factors the part that still hangs together, less a shift near its
    last eigenvalue, into Q R and goes on with R Q; where the last row has only
    its diagonal left, that is an eigenvalue.
    """
    a, n = np.array(a, float), len(a)
    vectors = np.eye(n)
    small, m = np.finfo(float).eps * max(np.abs(a).max(initial=0), 1e-300), n
    for _ in range(100 * n):
        while m > 1 and np.abs(a[m - 1, : m - 1]).max() <= small:
            m -= 1
        if m <= 1:
            break
        p, q, r = a[m - 2, m - 2], a[m - 1, m - 2], a[m - 1, m - 1]
        half = (p - r) / 2
        shift = r - (q * q / (half + np.copysign(np.hypot(half, q), half)) if q else 0.0)  # Wilkinson's
        turn, rest = np.linalg.qr(a[:m, :m] - shift * np.eye(m))
        a[:m, :m] = rest @ turn
        a[:m, :m] = (a[:m, :m] + a[:m, :m].T) / 2 + shift * np.eye(m)
        vectors[:, :m] = vectors[:, :m] @ turn
    else:
        raise ArithmeticError("the QR steps don't converge")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row with a whole vector and each component.

    Vectors that are null or hold null or non-finite entries are dropped;
    shorter vectors count as ending in zeros, entries of x beyond 2^31 as that,
    and a deviation that passes 64 bits is null.  Equal vectors count once in
    the fit and return each their rows, as do null ids.  Components without
    variance (fewer distinct vectors than entries, or one alone) have explained
    0 and a null whitened, and no part in identity_error.  Equal eigenvalues
    may take any order; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col("embedding")
    x = F.transform(v.cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * SCALE))).cast("long") + SHIFT)
    held = cut(rows.filter(whole(v)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")))
    width = held.agg(F.max(F.size("x"))).first()[0] or 1
    held = held.select("vec_id", padded(F.col("x"), width, SHIFT).alias("x"))
    fit = cut(held.select("x").distinct())
    m = moments(fit, width, width)
    n, sums = m.n, m.sums
    values, vectors = symmetric_qr(m.squares / max(1, n))
    shown = min(components, width)
    values, vectors, trace = values[:shown], vectors[:, :shown], float(np.trace(m.squares)) / max(1, n)
    sound = (values > NOUGHT * max(values[0], 0)) & (values > 0)
    scale = np.divide(vectors, np.sqrt(np.where(sound, values, 1.0)))

    def project(rows: np.ndarray) -> np.ndarray:
        return (rows * n - sums).astype(float) / max(1, n) @ scale

    second = moments(fit, width, shown, project) if n else Moments.none(shown)
    off = np.abs(second.squares / max(1, n) - np.eye(shown))[np.ix_(sound, sound)]
    error = float(off.max(initial=0.0))
    explained = np.where(sound, values / trace, 0.0) if trace > 0 else np.zeros(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column("x"), width)
            apart = x * n - sums  # whole, also where products wrap around and the true value fits
            exact = (apart * apart).sum(1)
            fits = ((x.astype(float) * n - sums) ** 2).sum(1) < 9.2e18
            got = np.where(sound, project(x), np.nan)
            k = len(x)
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(k), shown))),
                pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), k)),
                pa.array(np.full(k * shown, n, np.int64)),
                pa.array(np.repeat(exact, shown), mask=np.repeat(~fits, shown)),
                pa.array(got.ravel(), mask=np.tile(~sound, k)),
                pa.array(np.tile(explained, k)),
                pa.array(np.full(k * shown, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
