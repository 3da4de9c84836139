"""Phrase collocations from suffix arrays of word ids.

Every shard (a run of a partition's texts with a bounded number of words) holds
its words as ids, with a 0 between pieces.  Prefix doubling in numpy sorts the
suffixes by their first words; intervals of the lengths of common prefixes give
the shard's count of each n-gram, and the shards' counts are added by key.

An n-gram can only recur LEAST times if all shorter ones inside do.  So two
passes count hashes of one- and two-word, then of three-word n-grams, and note
which may reach LEAST in a bitmap of fixed size; the last pass sends the texts
of what is left.  Equal hashes only add to a count, and a full bitmap prunes
less, so the last pass's counts are exact for every phrase that reaches LEAST.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table

#: Candidates have 2 to LONGEST words and occur so often at least.
LONGEST, LEAST = 4, 30
#: A candidate goes where a longer one has this share (in hundredths) of its count.
COVER = 80
#: The score is floor(SCALE * a / (l + r)); each lang's first TOP are returned.
SCALE, TOP = 2_000_000, 2000
#: Words that a shard holds.
SHARD = 1_500_000
#: Bytes of a text that are cut into words at once.
SEGMENT = 4 << 20
#: Bits of the map of n-grams that may be frequent (16 MB); more n-grams share bits.
BITS = 1 << 27

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z and turns what ends a piece into 0xFF, a byte that UTF-8 never holds.
BYTES = bytes(0xFF if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP = re.compile(rb"[ \t\xff]")
AHEAD = re.compile(rb"(?:[ \t]+[^ \t\xff]+){0,%d}" % (LONGEST - 1))


def segments(data: bytes, most: int = SEGMENT) -> Iterator[tuple[bytes, bytes]]:
    """Parts of data of about `most` bytes, cut between words, each with the words of the same piece that follow it."""
    start = 0
    while (at := GAP.search(data, start + most)) is not None:
        yield data[start : at.start()], AHEAD.match(data, at.start()).group()
        start = at.start()
    yield data[start:], b""


class Words(dict):
    """Ids of one lang's words; new ones go on from the last id that the shard has given."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({b"\xff": 0})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class Shard:
    """Word ids of texts, told apart by lang; 0 stands between pieces."""

    def __init__(self):
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.known: dict[str, Words] = {}
        self.ids: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.starts: list[np.ndarray] = [np.zeros(1, bool)]
        self.size = 0

    def add(self, lang: str, body: bytes, ahead: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = Words(lang, self.words, self.langs)
        tokens = [b"\xff", *body.replace(b"\xff", b" \xff ").split()]
        counted = len(tokens)
        tokens += ahead.split()
        self.ids.append(np.fromiter(map(self.known[lang].__getitem__, tokens), np.int32, len(tokens)))
        self.starts.append(np.arange(len(tokens)) < counted)
        self.size += counted

    def sealed(self) -> "Shard":
        self.w = np.concatenate([*self.ids, np.zeros(LONGEST, np.int32)])
        self.start = np.concatenate([*self.starts, np.zeros(LONGEST, bool)]) & (self.w > 0)
        self.ids, self.starts, self.known = [], [], {}
        return self

    def intervals(self, deepest: int, some: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n up to deepest: n, a place of each distinct n-gram inside a piece, and its count.

        Prefix doubling: ranks by one word give those by two, these those by
        four.  some: the suffixes to take, if not all that are counted.
        """
        w, n = self.w, len(self.w)
        rank, width = w, 1
        while 2 * width < deepest:
            key = rank.astype(np.int64)
            key *= int(rank.max()) + 1
            key[: n - width] += rank[width:]
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.int32)
            del key, order
            width *= 2
        sa = np.flatnonzero(self.start if some is None else self.start & some)
        sa = sa[np.argsort(rank[sa].astype(np.int64) * (int(rank.max()) + 1) + rank[sa + width])]
        del rank
        same = np.ones(max(0, len(sa) - 1), bool)  # as the suffix before it, for the first n words
        inside = np.ones(len(sa), bool)  # no piece ends in the first n words
        for k in range(1, deepest + 1):
            word = w[sa + k - 1]
            same &= word[1:] == word[:-1]
            inside &= word > 0
            heads = np.flatnonzero(np.r_[True, ~same][: len(sa)])
            counts = np.diff(np.r_[heads, len(sa)])
            whole = inside[heads]
            yield k, sa[heads[whole]], counts[whole]

    def hashes(self, places: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of the n-grams at these places, alike in every shard."""
        if not hasattr(self, "word_hash"):
            seeds = {x: xxhash.xxh64_intdigest(x) for x in set(self.langs)}
            self.word_hash = np.fromiter((xxhash.xxh64_intdigest(x, seeds[y]) for x, y in zip(self.words, self.langs, strict=True)), np.uint64, len(self.words))
        h = np.full(len(places), n, np.uint64)
        for j in range(n):
            h = (h ^ self.word_hash[self.w[places + j]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h


def may_recur(bits: np.ndarray | None, shard: Shard, places: np.ndarray, n: int) -> np.ndarray:
    """Whether the bitmap allows that the n-grams at these places are frequent."""
    at = shard.hashes(places, n) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[Shard]:
    shard = Shard()
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            for body, ahead in segments(text.as_buffer().to_pybytes().translate(BYTES)):
                shard.add(lang.as_py(), body, ahead)
                if shard.size >= size:
                    yield shard.sealed()
                    shard = Shard()
    if shard.size:
        yield shard.sealed()


def hashed_counts(texts: DataFrame, lengths: tuple[int, ...], sent, size: int) -> DataFrame:
    """hash, c: a shard's counts of its n-grams of these lengths (up to 2, or 3 alone, if both two-word ones inside may recur)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            some = None
            if max(lengths) > 2:  # suffixes whose first two-word n-grams may all recur
                two = may_recur(sent.value, shard, np.arange(len(shard.w) - 1), 2)
                some = np.zeros(len(shard.w), bool)
                some[: len(two) - 1] = two[:-1] & two[1:]
            for n, places, counts in shard.intervals(max(lengths), some):
                if n not in lengths:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(shard.hashes(places, n).view(np.int64)), pa.array(counts)], ["hash", "c"])

    return texts.mapInArrow(run, "hash long, c long")


def exact_counts(texts: DataFrame, sent, size: int) -> DataFrame:
    """lang, words, phrase, f: a shard's counts of its n-grams that may recur; words 0: the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "phrase", "f"]
        for shard in shards(batches, size):
            langs, words = np.array(shard.langs, object), pa.array(shard.words, pa.binary()).cast(pa.string())
            each, n = np.unique(langs[shard.w[shard.start]].astype(str), return_counts=True) if shard.start.any() else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.string()), pa.array([0] * len(each), pa.int32()), pa.array([""] * len(each)), pa.array(list(n), pa.int64())], names)
            for n, places, counts in shard.intervals(LONGEST):
                inner = min(n, LONGEST - 1)
                keep = np.logical_and.reduce([may_recur(sent.value, shard, places + j, inner) for j in range(n - inner + 1)])
                places, counts = places[keep], counts[keep]
                grams = shard.w[places[:, None] + np.arange(n)]
                phrases = pc.binary_join_element_wise(*[words.take(pa.array(g)) for g in grams.T], " ")
                yield pa.RecordBatch.from_arrays([pa.array(langs[grams[:, 0]], pa.string()), pa.array(np.full(len(counts), n, np.int32)), phrases, pa.array(counts)], names)

    return texts.mapInArrow(run, "lang string, words int, phrase string, f long")


def bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """The bits of the hashes that are counted `least` times or more: BITS / 64 rows at most reach the driver."""
    # Few hashes recur within a task, so they are dealt out before they are added.
    often = counts.repartition("hash").groupBy("hash").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    at = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    slots = often.select(F.shiftright(at, 6).alias("slot"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, size: int = SHARD) -> DataFrame:
    """lang, words, phrase, f of every phrase of 1 to LONGEST words with f >= least; words 0: each lang's number of words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = bitmap(hashed_counts(texts, (1, 2), None, size), least)
    sent = spark.sparkContext.broadcast(bits)
    bits = bits | bitmap(hashed_counts(texts, (3,), sent, size), least)
    sent = spark.sparkContext.broadcast(bits)
    counts = exact_counts(texts, sent, size).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return cut(counts.filter((F.col("f") >= least) | (F.col("words") == 0)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """Each lang's `top` phrases by how much they occur together: lang, rank, phrase, a, l, r, n, score.

    A null lang is `und`, a null or empty text has no words; very long texts
    are cut between words with the words that follow, so that none is lost;
    repeated rows count each time, and ids play no part; ties in score fall to
    the larger a, then to the phrase in byte order; an empty table has no
    phrases; other columns are ignored.
    """
    grams = frequent_phrases(docs, least, size)
    phrase = F.split("phrase", " ")
    candidates = grams.filter("words >= 2")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    parts = cuts.select("*", F.array_join(F.slice(phrase, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(phrase, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = grams.filter((F.col("words") >= 1) & (F.col("words") < LONGEST))
    parts = parts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    parts = parts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # The product may pass 64 bits, so it is a decimal.
    scored = parts.withColumn("score", F.expr(f"cast({SCALE} as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    scored = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    # Sub-phrases of longer candidates, with the largest count of any that holds them.
    inner = candidates.filter("words > 2").select("lang", F.col("f").alias("longer"), "words", "phrase")
    inner = inner.select("lang", "longer", "words", "phrase", F.explode(F.expr("sequence(2, words - 1)")).alias("m"))
    inner = inner.select("lang", "longer", "phrase", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("i"))
    inner = inner.select("lang", "longer", F.array_join(F.slice(phrase, F.col("i"), F.col("m")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(COVER) * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    totals = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(range(len(p))) AS piece, unnest(p) AS piece_text
  FROM (SELECT lang, row_number() OVER () AS doc, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
lists AS (SELECT lang, list_filter(string_split_regex(piece_text, '[ \\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= {LEAST}),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS first_part, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS j FROM candidates)),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score, c.j
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first_part JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM candidates)) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < {COVER} * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""
