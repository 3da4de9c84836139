"""Nearest neighbours by multi-index hashing.

Signs of learned rotations give every vector a code of BITS bits, split into
substrings of 16, and each substring has an index from its values to rows.  If
no substring of a code lies within s bits of the query's, the codes differ in
more than s bits for each (pigeonhole), so probing all values within s bits,
substring after substring, meets every code within a known Hamming radius.  The
radius that a query needs follows from its k-th best cosine so far: the
calibration says within how many bits a vector that near lies.  Codes within it
are reranked by the vectors themselves.

Rotations and calibration are fitted on a bounded sample; every row is indexed.
The index is built in parts of bounded size, and queries come to them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table
from lotwatch.llm.vectors import lists, matrix, padded, whole

NEIGHBOURS, EVERY = 5, 50
BITS, WIDTH = 256, 16
SUBSTRINGS = BITS // WIDTH
#: Rows and bytes of the sample that rotations and radii are fitted on.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Rows and bytes of a part of the index; queries of a block.
PART, PART_BYTES, BLOCK = 8192, 32 << 20, 2048
#: A vector at the k-th cosine lies within the radius with this probability, nearer ones more surely.
SURE, SURE_Z = 0.98, 2.05
STEPS, SEED = 30, 11

def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def rotations(sample: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Directions (columns) whose signs are the bits: as many rotations as BITS needs, each moved to where signs lose least (ITQ)."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    base = np.eye(d)
    if d > BITS:  # the directions that hold most
        base = np.linalg.svd(sample, full_matrices=False)[2][:BITS].T if len(sample) >= BITS else np.linalg.qr(rng.normal(size=(d, BITS)))[0]
    flat, out = sample @ base, []
    for _ in range(-(-BITS // base.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(base.shape[1],) * 2))[0]
        for _ in range(STEPS if len(sample) else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        out.append(base @ turn)
    return np.concatenate(out, 1)[:, :BITS]


def encoded(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Codes as 16-bit substrings."""
    return np.packbits(rows @ directions > 0, axis=1).view(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(1, dtype=np.int64)


@dataclass
class Model:
    directions: np.ndarray
    #: Radii for cosines at `edges`, falling.
    edges: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    tags: np.ndarray

    def radius(self, cosine: float) -> int:
        """Bits within which a vector of this cosine or more lies, SURE at least."""
        return BITS if cosine == -np.inf else int(np.ceil(np.interp(cosine, self.edges, self.radii)))


def fitted(sample: np.ndarray, tags: np.ndarray) -> Model:
    """The radius for a cosine is a quantile over the sample's own pairs where it has enough, else that of as many random bits."""
    sample = unit(sample)
    directions = rotations(sample)
    edges = np.linspace(-1, 1, 81)
    p = np.arccos(edges) / np.pi
    radii = BITS * p + SURE_Z * np.sqrt(BITS * p * (1 - p))
    some = sample[:1024]
    codes = encoded(some, directions)
    bits = np.concatenate([distances(codes[i + 1 :], codes[i]) for i in range(len(some))]) if len(some) else np.empty(0)
    slot = np.clip(((((some @ some.T)[np.triu_indices(len(some), 1)]) + 1) * 40).astype(int), 0, 79)
    for k in range(80):
        here = bits[slot == k]
        if len(here) >= 300:
            radii[k] = np.quantile(here, SURE)
    radii = np.maximum.accumulate(radii[::-1])[::-1]
    return Model(directions, edges, np.minimum(radii, BITS), sample, tags)


class Index:
    """Rows of a part by the values of each substring of their codes; all substrings' values stand one behind another."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        order, values, starts = [], [], []
        for j in range(SUBSTRINGS):
            by = np.argsort(codes[:, j], kind="stable")
            held, first = np.unique(codes[by, j], return_index=True)
            order.append(by)
            values.append(held)
            starts.append(first + j * len(codes))
        self.order, self.values = np.concatenate(order), np.concatenate(values)
        self.starts = np.r_[np.concatenate(starts), len(self.order)]
        self.sizes = np.array([len(v) for v in values])
        self.ends = np.cumsum(self.sizes)

    def probes(self, code: np.ndarray) -> "Probes":
        return Probes(self, np.bitwise_count(self.values ^ np.repeat(code, self.sizes)))


class Probes:
    """The occupied values of each substring by how many bits they differ from a query's."""

    def __init__(self, index: Index, apart: np.ndarray):
        self.index = index
        self.order = np.argsort(apart, kind="stable")
        self.rings = np.searchsorted(apart[self.order], np.arange(WIDTH + 2))

    def rows(self, s: int, substrings: int) -> np.ndarray:
        """Rows of the values that differ in s bits, of the first so many substrings."""
        at = self.order[self.rings[s] : self.rings[s + 1]]
        if substrings < SUBSTRINGS:
            at = at[: np.searchsorted(at, self.index.ends[substrings - 1])]
        first, n = self.index.starts[at], self.index.starts[at + 1] - self.index.starts[at]
        if not len(n) or n.max() == 1:
            return self.index.order[first]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.index.order[np.repeat(first, n) + inner]


def search(index: Index, vectors: np.ndarray, ids: np.ndarray, own: int, query: np.ndarray, code: np.ndarray, bound: float, model: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cosines of the k nearest of a part (ties: smaller ids), as far as they may be among the k nearest of all.

    own: the query's own row, or -1; bound: a cosine that the k-th nearest of all is known to reach.
    """
    met = np.zeros(len(ids), bool)
    if own >= 0:
        met[own] = True
    best, scores = np.empty(0, np.int64), np.empty(0)
    need, norm = model.radius(bound), np.sqrt((query * query).sum())
    probes = index.probes(code)
    for s in range(WIDTH + 1):
        # Once the first a substrings are probed within s bits and the others within s - 1, every code within s * SUBSTRINGS + a - 1 bits has been met.
        a = min(SUBSTRINGS, need + 1 - s * SUBSTRINGS)
        if a <= 0:
            break
        rows = probes.rows(s, a)
        fresh = np.zeros(len(ids), bool)
        fresh[rows] = True
        fresh &= ~met
        met |= fresh
        rows = np.flatnonzero(fresh)
        rows = rows[distances(index.codes[rows], code) <= need]
        there = vectors[rows]
        best = np.concatenate([best, rows])
        scores = np.concatenate([scores, (there * query).sum(1) / (np.sqrt((there * there).sum(1)) * norm)])
        first = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[first], scores[first]
        if len(best) == k:
            need = min(need, model.radius(max(bound, float(scores[-1]))))
    return best, scores


def nearest(rows: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest other rows by cosine.

    Null and zero vectors and those with a null or non-finite entry take no
    part; shorter vectors count as ending in zeros.  Very long vectors make
    parts of fewer rows.  Every row with a query's id is a query of its own,
    for which its copies are candidates; a row without an id is a candidate,
    last among its equals; ties in cosine fall to the smaller id; with fewer
    than k others all are returned; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col("embedding")
    held = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), v).filter(whole(v) & F.exists(v, lambda x: x != 0)).withColumn("tag", F.monotonically_increasing_id()))
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    got = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("width"), F.count_if(is_query).alias("queries")).first()
    n, width = got["n"], got["width"] or 1
    held = held.select("tag", "vec_id", padded(v.cast("array<double>"), width, 0.0).alias("v"))
    # A sample by a hash of the row; the filter keeps the sort small.
    most = min(SAMPLE, max(64, SAMPLE_BYTES // (8 * width)))
    mark = F.pmod(F.xxhash64("tag"), F.lit(1 << 30))
    sample = held.filter(mark < int((1 << 30) * min(1.0, 2 * most / max(1, n)))).orderBy(mark, "tag").limit(most).select("tag", "v").toArrow()
    scaled = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])  # noqa: E731  by powers of two: cosines stay the same to the last bit, and squares finite
    sent = spark.sparkContext.broadcast(fitted(scaled(matrix(sample["v"], width)) if len(sample) else np.empty((0, width)), sample["tag"].to_numpy()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            if not len(b):
                continue
            x = scaled(matrix(b.column("v"), width))
            codes = encoded(unit(x), model.directions)
            tags, ids = b.column("tag").to_numpy(), b.column("vec_id")
            bounds = np.full(len(x), -np.inf)
            for i in np.flatnonzero(ids.fill_null(1).to_numpy() % every == 0):
                seen = (model.sample @ unit(x[i : i + 1])[0])[model.tags != tags[i]]
                if len(seen) >= k:
                    bounds[i] = np.partition(seen, len(seen) - k)[len(seen) - k] - 1e-12
            yield pa.RecordBatch.from_arrays([b.column("tag"), ids, lists(x), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bounds)], ["tag", "vec_id", "v", "code", "bound"])

    coded = cut(held.mapInArrow(encode, "tag long, vec_id long, v array<double>, code binary, bound double"))
    parts = max(1, -(-n // min(part, max(256, PART_BYTES // (8 * width)))))
    blocks = max(1, -(-got["queries"] // block))
    dealt = lambda k, m: F.pmod(F.xxhash64("tag", F.lit(k)), F.lit(m))
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = coded.select("tag", "vec_id", "v", "code", dealt(1, parts).cast("int").alias("part"), every_one(blocks).alias("block"))
    queries = coded.filter(is_query).select("tag", "vec_id", "v", "code", "bound", dealt(2, blocks).cast("int").alias("block"), every_one(parts).alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = sent.value, []
        codes = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.uint16).reshape(len(t), SUBSTRINGS)
        if len(left) and len(right):
            x, ids, tags = matrix(left["v"], width), left["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), left["tag"].to_numpy()
            at = {t: i for i, t in enumerate(tags.tolist())}
            index = Index(codes(left))
            asked = zip(right["tag"].to_pylist(), right["vec_id"].to_pylist(), matrix(right["v"], width), codes(right), right["bound"].to_pylist(), strict=True)
            for tag, query_id, query, code, bound in asked:
                found, scores = search(index, x, ids, at.get(tag, -1), query, code, bound, model, k)
                out += [(tag, query_id, i, s) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
        tags, query_ids, found, scores = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"tag": pa.array(tags, pa.int64()), "query_id": pa.array(query_ids, pa.int64()), "vec_id": left["vec_id"].combine_chunks().take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.float64())})

    # Written as it is: pruned columns (as by a count) would be missing from what the function gets.
    pairs = cut(index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(meet, "tag long, query_id long, vec_id long, score double"))
    best = Window.partitionBy("tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
