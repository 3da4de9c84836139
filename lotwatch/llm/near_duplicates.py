"""MinHash near-duplicates with BagMinHash signatures of word-shingle multisets.

A text is the multiset of its 5-word shingles (a shorter one: of all its
words).  Each shingle's weight (its count) is cut into levels, grouped as
[1, 2), [2, 4), [4, 8) ...; every group is a Poisson process of that rate whose
points carry a level and a signature component, and points above the weight are
thinned out.  The first point of each component over all shingles is the
signature, and two signatures agree in a component with probability sum of
minima / sum of maxima, the weighted Jaccard likeness.  Points come in order of
time, so a shingle is left as soon as its next point is too late to count.

Bands of the signature name buckets.  In a bucket, documents are not paired
all with all: each meets the bucket's representative first, and most of a group
of copies is one component then.  What a bucket still holds of different
components is compared in full: in one list where the bucket is small, else in
blocks, each two blocks in a group of their own: signatures first, then the
texts of those that may have a link, of which only links that join components
come out.  Before pairs are verified on the texts, those
whose signatures agree too seldom are left.  Links that join components are all
that classes need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table, text_of
from lotwatch.llm.components import components
from lotwatch.llm.fingerprints import byte_runs

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 30, 5
#: Buckets of at most so many texts are compared as one list.
SMALL = 16
#: Texts, and their bytes, of a block of a larger bucket, and columns of the matrices that compare two blocks.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 2 << 20, 4096
#: Signatures of a block where only they are compared.
BRIEFS = 1024
#: Pairs are left if signatures agree so many standard deviations below what the least likeness gives (1 pair in 10^7).
DEVIATIONS = 5.5
U = np.uint64
_POWER = U(0x9E3779B97F4A7C15)
_FACTORS = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no pattern (splitmix64's finish)."""
    x = (x ^ (x >> U(30))) * _FACTORS[0]
    x = (x ^ (x >> U(27))) * _FACTORS[1]
    return x ^ (x >> U(31))


def shingles(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text index of every shingle of texts laid end to end."""
    n = len(ends) - 1
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~blank
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(solid & (np.r_[True, blank[:-1]] | edge[:-1]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Word hash: a polynomial of its bytes, by place in the word.
    start = np.zeros(len(data), np.int64)
    start[first] = first
    place = np.arange(len(data)) - np.maximum.accumulate(start)
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _POWER, np.uint64))
    values = np.where(solid, (data.astype(np.uint64) + U(1)) * powers[place], U(0))
    word = mixed(np.add.reduceat(values, first))
    owner = np.searchsorted(ends, first, "right") - 1
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    # A text of fewer words is one shingle of all of them.
    many = np.maximum(size - width + 1, (size > 0).astype(np.int64))
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    who = np.repeat(np.arange(n), many)
    at += begin[who]
    last = begin + size
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < last[who]
        h += np.where(inside, word[np.minimum(at + k, len(word) - 1)] * _FACTORS[k % 5] + U(k + 1), U(0))
    return mixed(h), who


def multisets(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) and its count, in order of text and hash."""
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return h[at], who[at], np.diff(np.r_[at, len(h)])


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(h: np.ndarray, who: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash: m values for each of n multisets (0 where one is empty)."""
    best = np.full(n * m, np.inf)
    value = np.zeros(n * m, np.uint64)
    total = np.bincount(who, weight, n)
    # By this time a document has found all components with high probability; what it lacks comes later.
    limit = np.where(total > 0, m * (np.log(m) + 1.5) / np.maximum(total, 1), 0.0)
    level = np.floor(np.log2(weight)).astype(np.int64)
    element = np.repeat(np.arange(len(h)), level + 1)
    group = np.arange(len(element)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    seed = mixed(h[element] + group.astype(np.uint64) * _FACTORS[2])
    rate = np.exp2(group.astype(np.float64))
    w, doc = weight[element], who[element]
    time, drawn = np.zeros(len(element)), 0
    active = np.arange(len(element))
    while True:
        # Many draws at once when few processes are left.
        step = int(min(64, max(1, 40_000 // max(1, len(active)))))
        while len(active):
            s, d, r, t = seed[active], doc[active], rate[active], time[active]
            k = (drawn + 1 + np.arange(step)).astype(np.uint64)
            x = mixed(s[:, None] + k[None, :] * _POWER)
            t = t[:, None] + np.cumsum(-np.log(_unit(x)), axis=1) / r[:, None]
            ok = t <= limit[d][:, None]
            y = mixed(x ^ _FACTORS[3])
            # The level within its group; above the weight the point is thinned out.
            top = r[:, None] * (1 + _unit(mixed(y ^ _FACTORS[4])))
            hit = ok & (np.floor(top) <= w[active][:, None])
            to = (d[:, None] * m + (y % U(m)).astype(np.int64))[hit]
            th, yh = t[hit], y[hit]
            np.minimum.at(best, to, th)
            won = best[to] == th
            value[to[won]] = yh[won]
            # A point that comes too late ends its process.
            time[active] = t[:, -1]
            active = active[ok[:, -1]]
            drawn += step
            step = int(min(64, max(1, 40_000 // max(1, len(active)))))
        empty = (np.isinf(best).reshape(n, m).any(axis=1)) & (total > 0)
        if not empty.any():
            return value.reshape(n, m)
        # Such documents start again with a later limit; what they found stays the earliest.
        limit = np.where(empty, limit * 2, 0.0)
        active, drawn = np.flatnonzero(empty[doc]), 0
        time[active] = 0.0


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit bucket of each band."""
    parts = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[2], (len(sig), bands)).copy()
    for k in range(rows):
        h = mixed(h ^ parts[:, :, k]) + _POWER
    return h


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, id, hash, set_a and set_b (128 bits that name the multiset), buckets and brief (a byte of each signature component) of every row of docs (doc_id, text, id, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for data, ends in byte_runs(b.column("text"), 3 << 20):
                n = len(ends) - 1
                h, who, count = multisets(*shingles(data, ends, width))
                sums = []
                for f in _FACTORS[3:5]:
                    each = mixed(h ^ f) * count.astype(np.uint64)
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, who, each)
                    sums.append(total.view(np.int64))
                filled = np.bincount(who, minlength=n) > 0
                sig = signatures(h, who, count, n, bands * rows)
                buckets = band_hashes(sig, bands, rows).view(np.int64)
                brief = pa.array([x.tobytes() for x in (sig >> U(56)).astype(np.uint8)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(filled * bands)].astype(np.int32)), pa.array(buckets[filled].ravel()))
                kept = [b.column(c).slice(at, n) for c in ("doc_id", "id", "hash")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1]), lists, brief], ["doc_id", "id", "hash", "set_a", "set_b", "buckets", "brief"])
                at += n

    return docs.mapInArrow(run, "doc_id long, id long, hash long, set_a long, set_b long, buckets array<long>, brief binary")


def overlap(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """Weighted Jaccard likeness of the shingle multisets of texts in pairs."""
    n = len(left)
    sides = []
    for column in (left, right):
        h, who, at = [], [], 0
        for data, ends in byte_runs(column, 8 << 20):
            x, y = shingles(data, ends, width)
            h.append(x)
            who.append(y + at)
            at += len(ends) - 1
        sides.append(multisets(np.concatenate(h), np.concatenate(who)))
    h, who, count = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((h, who))
    h, who, count = h[order], who[order], count[order]
    twin = np.r_[(h[1:] == h[:-1]) & (who[1:] == who[:-1]), False] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(twin)
    shared = np.bincount(who[at], np.minimum(count[at], count[at + 1]), n)
    total = np.bincount(who, count, n)
    return shared / np.maximum(total - shared, 1)


def enough_of(values: int, least: float) -> float:
    """Agreeing components of `values` that a pair of likeness `least` hardly ever falls short of."""
    return values * least - DEVIATIONS * (values * least * (1 - least)) ** 0.5


def likely(pairs: DataFrame, own: DataFrame, values: int, least: float) -> DataFrame:
    """Those pairs (a, b) whose signatures agree about as often as likeness `least` gives, or more often."""
    enough = enough_of(values, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, values) for c in ("sa", "sb"))
            near = pa.array((left == right).sum(axis=1) >= enough)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    one, two = own.select(F.col("node").alias("a"), F.col("brief").alias("sa")), own.select(F.col("node").alias("b"), F.col("brief").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def likely_of_few(few: DataFrame, own: DataFrame, values: int, least: float) -> DataFrame:
    """As likely: pairs (a, b) of different components of small buckets, few(bucket, node, comp); a bucket's signatures come as one list."""
    enough = enough_of(values, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").flatten()
            node, comp = (held.field(c).to_numpy() for c in ("node", "comp"))
            sizes = batch.column("held").value_lengths().to_numpy()
            brief = np.frombuffer(b"".join(held.field("brief").to_pylist()), np.uint8).reshape(-1, values)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            a, b = [], []
            for k in range(1, int(sizes.max(initial=1))):
                at = np.flatnonzero((bucket[k:] == bucket[:-k]) & (comp[k:] != comp[:-k]))
                for some in np.array_split(at, len(at) // 50_000 + 1):
                    near = some[(brief[some] == brief[some + k]).sum(axis=1) >= enough]
                    a.append(np.maximum(node[near], node[near + k]))
                    b.append(np.minimum(node[near], node[near + k]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    met = meeting(few.select("node", "comp", F.col("bucket").alias("place")), own.select("node", "brief")).groupBy("place").agg(F.collect_list(F.struct("node", "comp", "brief")).alias("held"))
    return met.select("held").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those pairs (a, b) whose texts' likeness is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                near = pa.array(overlap(b.column("ta"), b.column("tb"), width) >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def name(doc_id: Column, text: Column) -> Column:
    """A row's id; without one, a negative number from its text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseOR(F.lit(-(2**63))))


def ordered(parts: DataFrame) -> DataFrame:
    """Distinct pairs (a > b) of the columns node and b."""
    return parts.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def bridges(batch: pa.Table, left: np.ndarray, right: np.ndarray, width: int, least: float) -> tuple[list[int], list[int]]:
    """Rows of batch (comp, text) in pairs: enough links from rows left to rows right to join every two components that a likeness of `least` or more joins."""
    h, who, at = [], [], 0
    for data, ends in byte_runs(batch.column("text").combine_chunks(), 8 << 20):
        x, y = shingles(data, ends, width)
        h.append(x)
        who.append(y + at)
        at += len(ends) - 1
    h, who, count = multisets(np.concatenate(h), np.concatenate(who))
    total = np.bincount(who, count, at)
    # A shingle's second occurrence counts as another element, so that sets of elements overlap as the multisets do.
    again = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    _, col, rows = np.unique(mixed(np.repeat(h, count) + again.astype(np.uint64) * _FACTORS[2]), return_inverse=True, return_counts=True)
    who, several = np.repeat(who, count), rows[col] > 1
    col, who = (np.cumsum(rows > 1) - 1)[col[several]], who[several]
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    # How many elements two texts share: a product of matrices, some columns at a time.
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((rows > 1).sum()), COLUMNS):
        some = slice(*np.searchsorted(col, [first, first + COLUMNS]))
        holds = np.zeros((at, COLUMNS), np.float32)
        holds[who[some], col[some] - first] = 1
        shared += holds[left] @ holds[right].T
    shared = shared.astype(np.float64)
    comp = batch.column("comp").to_numpy()
    near = shared / np.maximum(total[left][:, None] + total[right] - shared, 1) >= least
    x, y = np.nonzero(near & (comp[left][:, None] != comp[right]))
    x, y = left[x], right[y]
    _, firsts = np.unique(np.stack([comp[x], comp[y]]), axis=1, return_index=True)
    # A forest of components says as much as all of their links.
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    a, b = [], []
    for i, j in zip(x[firsts].tolist(), y[firsts].tolist(), strict=True):
        one, two = top(int(comp[i])), top(int(comp[j]))
        if one != two:
            root[one] = two
            a.append(i)
            b.append(j)
    return a, b


def dealt(crowd: DataFrame, held: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """crowd(bucket, node, comp, size) once for each pair of blocks of its bucket that it stands in: bucket, low, high, block, node, comp, and held's other columns.

    Every block of texts outside the bucket's largest component meets every
    block; those of the largest component don't meet each other.  A node meets
    what held(node, ...) has of it once, with all its places, and is dealt out
    after that.
    """
    per = crowd.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("n", "size", "comp")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / block), F.ceil(size / block_bytes), F.lit(1)).cast("int")

    most = F.col("most")
    largest = cut(largest.select("bucket", most["comp"].alias("main"), blocks(F.col("n") - most["n"], F.col("size") - most["size"]).alias("others"), blocks(most["n"], most["size"]).alias("mains")))
    main, place = F.col("comp") == F.col("main"), F.xxhash64("node")
    stands = F.struct(
        "bucket",
        F.when(main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int").alias("block"),
        F.when(main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1).alias("last"),
    )
    met = meeting(crowd.join(largest, "bucket").select("node", "comp", stands.alias("place")), held)
    met = met.select("*", "place.*").select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("meets"))
    kept = [F.col(c) for c in held.columns if c != "node"]
    return met.select("bucket", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "block", "node", "comp", *kept)


def meeting(places: DataFrame, held: DataFrame) -> DataFrame:
    """places(node, comp, place) with the other columns of held(node, ...): a node, which has a place in each band at most, meets held once."""
    each = places.groupBy("node", "comp").agg(F.collect_list("place").alias("places"))
    return each.join(held, "node").select("*", F.explode("places").alias("place")).drop("places")


def near_others(crowd: DataFrame, own: DataFrame, values: int, least: float) -> DataFrame:
    """Those (bucket, node) of crowd whose signature agrees often enough with one of another component of the bucket.

    Blocks of signatures meet, a hundred bytes a text, so that only texts that
    may have a link go on to be compared.
    """
    enough = enough_of(values, least)

    def run(group: pa.Table) -> pa.Table:
        block, comp = group.column("block").to_numpy(), group.column("comp").to_numpy()
        brief = np.frombuffer(b"".join(group.column("brief").to_pylist()), np.uint8).reshape(-1, values)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        near = np.zeros(len(block), bool)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            hit = ((brief[some][:, None, :] == brief[right][None, :, :]).sum(axis=2) >= enough) & (comp[some][:, None] != comp[right][None, :])
            near[some[hit.any(axis=1)]] = True
            near[right[hit.any(axis=0)]] = True
        return group.select(["bucket", "node"]).filter(pa.array(near))

    met = dealt(crowd.withColumn("size", F.lit(values)), own.select("node", "brief"), BRIEFS, BRIEFS * values)
    return met.groupBy("bucket", "low", "high").applyInArrow(run, "bucket long, node long").distinct()


def crossing(crowd: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) that join all the components that a bucket's texts of likeness `least` or more join, of buckets of any size.

    A bucket is cut into blocks of about BLOCK texts or BLOCK_BYTES; each two
    that must meet are a group of their own, of which only what joins
    components comes out.
    """

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        a, b = bridges(group, np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()), width, least)
        node = group.column("node")
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    sized = meeting(crowd.select("node", "comp", F.col("bucket").alias("place")), texts.select("node", "size")).withColumnRenamed("place", "bucket")
    met = dealt(sized, texts.select("node", "text"), BLOCK, BLOCK_BYTES)
    return met.groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """doc_id, id (see name), hash (of the text), class_id and stays (it is the class's first document) of every row of docs.

    Classes are the components of likeness `least` or more.  Texts with equal
    multisets of shingles are one text from the start; null, empty and all
    other texts without a word are one too.  A class is named by its smallest
    id.  Rows are told apart by id and text: of texts that share an id but are
    not alike, one bears the id and each other one a negative number made from
    its shingles; a row without an id is named by its text, a negative number
    too.  Equal rows stay or go together; an empty table has no classes; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    named = text_of(docs).withColumns({"id": name(F.col("doc_id"), F.col("text")), "hash": F.xxhash64("text")})
    sketched = cut(sketch(named, width, bands, rows))
    # Each distinct multiset, known by its first row; all that share it share its buckets.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "id", "hash")).alias("first")
    sets = cut(sketched.groupBy("set_a", "set_b").agg(first, F.first("buckets").alias("buckets"), F.first("brief").alias("brief")))
    # Where an id is the first of several multisets, the smallest of them bears it.
    key = F.struct("set_a", "set_b")
    shared = cut(sets.groupBy(F.col("first.id").alias("id")).agg(F.min(key).alias("bearer"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "bearer"))
    other = F.xxhash64("set_a", "set_b").bitwiseOR(F.lit(-(2**63)))
    own = sets.withColumn("id", F.col("first.id")).join(shared, "id", "left").withColumn("node", F.when(F.col("bearer") != key, other).otherwise(F.col("id"))).drop("id", "bearer")

    # Each distinct multiset meets the smallest node of each of its buckets.
    spread = own.select("node", F.explode("buckets").alias("bucket"))
    smallest = cut(spread.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("other")).filter("b <> other").select("bucket", "b"))
    held = cut(spread.join(smallest, "bucket"))
    needed = own.join(held.select("node").distinct(), "node", "left_semi").select("node", F.col("first.id").alias("id"), F.col("first.hash").alias("hash"))
    read = cut(named.select("id", "hash", "text").join(needed, ["id", "hash"]).dropDuplicates(["node"]).select("node", "text", F.octet_length("text").alias("size")))

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(likely(pairs, own, bands * rows, least), read, width, least)

    found = components(cut(linked(ordered(held.filter("node <> b")))))
    # Buckets that still hold different components.
    parts = cut(held.select("bucket", "node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed_ = cut(parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", "n"))
    parts = cut(parts.join(mixed_, "bucket"))
    few, crowd = parts.filter(F.col("n") <= small), parts.filter(F.col("n") > small)
    crowd = crowd.select("bucket", "node", "comp")
    crowd = cut(crowd.join(cut(near_others(crowd, own, bands * rows, least)), ["bucket", "node"], "left_semi"))
    pairs = likely_of_few(few, own, bands * rows, least)
    new = cut(verified(pairs, read, width, least).union(crossing(crowd, read, width, least)))
    found = components(new.union(found.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    classes = own.select("set_a", "set_b", "first", "node").join(found, "node", "left").withColumn("class_id", F.coalesce("comp", "node")).drop("comp")
    is_first = (F.col("node") == F.col("class_id")) & (F.col("id") == F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    return sketched.select("doc_id", "id", "hash", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "id", "hash", "class_id", is_first.alias("stays"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each class.

    Of rows with that id and text, the one that comes first by a hash of its
    other columns.  Null and empty texts are one class; no row of a text that
    is like no other goes, whatever its id; an empty table stays empty.
    """
    stays = near_duplicates(docs).filter("stays").select(F.col("id").alias("name"), "hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumns({"name": name(F.col("row.doc_id"), F.col("row.text")), "hash": F.xxhash64(F.coalesce("row.text", F.lit("")))})
    others = [F.col("row")[c].cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    # Partitioned by name and text already: equal rows are numbered without a further shuffle.
    w = Window.partitionBy("name", "hash").orderBy(F.xxhash64(*others) if others else F.lit(0))
    rows = rows.join(stays, ["name", "hash"], "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "stays")
