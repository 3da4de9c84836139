"""Sum-of-squares packing of token pieces into sequences.

Every document becomes its ids plus an end id; only longer ones are cut, so
that all pieces but the first hold exactly `size` tokens.  A piece goes into the
open sequence with room that leaves the smallest sum of squared counts of open
sequences per residual gap (ties: the tightest gap).  Pieces are dealt by hash into groups of a
bounded number, each packed by one task: a group leaves at most a handful of
sequences part full, so many groups cost next to nothing, and nothing is ever
gathered whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, ship, table, text_of

#: Pieces a group has on average; a group is packed by one task.
GROUP = 20_000
# Fixed value: Unicode's white space, what \s is to the tokenizer.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: letters of Latin scripts, which any version of Unicode knows as such.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
WORD = f" ?[{LETTERS}]+"
#: Where a text may be cut, as no token goes on there: before runs of blanks, and behind words where blanks, signs (but for the apostrophe) or digits follow, and behind a lone line end.
CHUNK = re.compile(f"{WORD}(?=[!-&(-/:-@\\[-`{{-~0-9{WHITE}]|\\Z)|[\t\n\r\f\v](?=[{LETTERS}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD = re.compile(WORD)
#: Remembered chunks of a worker, by their memory; beyond it the memory starts afresh.
CACHE_BYTES = 160 << 20
#: Longer chunks aren't remembered, and are cut once more where that is safe.
LONG = 1000


class Ids(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library.

    A text is encoded chunk by chunk, and the dictionary remembers the chunks'
    ids.  Words go straight to the tokenizer's model, all else through the
    tokenizer.  A chunk without a
    safe place to cut (a run of blanks or letters may have none) is encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        assert not any(re.search(f"^[{LETTERS}]|[{WHITE}]", x) for x in special)  # so that no cut parts one
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})" if special else "(?!)")
        # Pairs of bytes, as the vocabulary shows them, that some token holds: there a cut could part what belongs together.
        self.inside = {t[i : i + 2] for t in self.tokenizer.get_vocab(with_added_tokens=False) for i in range(len(t) - 1)}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.white = {chr(i) for i in range(0x3001) if re.match(f"[{WHITE}]", chr(i))}
        self.tokenize = self.tokenizer.model.tokenize
        self.held = 0

    def parts(self, chunk: str) -> Iterator[str]:
        """chunk, cut about every LONG characters between two blanks or two letters whose bytes no token holds side by side."""
        for k, part in enumerate(self.special.split(chunk)):
            start = at = 0
            # Every second part is a special token's string, which stays whole.
            while k % 2 == 0 and (at := max(at + 1, start + LONG)) < len(part):
                a, b = part[at - 1], part[at]
                alike = (a in self.white and b in self.white) or (a.isalpha() and b.isalpha())
                if alike and self.shown[a.encode()[-1]] + self.shown[b.encode()[0]] not in self.inside:
                    yield part[start:at]
                    start = at
            yield part[start:]

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONG:
            return b"".join(map(self.encoded, self.parts(chunk)))
        if WORD.fullmatch(chunk):
            got = array("I", [t.id for t in self.tokenize("".join(map(self.shown.__getitem__, chunk.encode())))]).tobytes()
        else:
            got = self.encoded(chunk)
        self[chunk] = got
        self.held += 4 * len(chunk) + len(got) + 200
        return got

    def of(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, CHUNK.findall(text)))
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        return out


@lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    return Ids(path)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to size), the longest taken first.

    Of the open bins that have room the one is taken that leaves the smallest
    sum of squared counts of open bins per gap (ties: the tightest); a new bin
    is opened where none has room.
    """
    count = np.zeros(size + 1, np.int64)  # open bins per gap; a full bin (gap 0) isn't open
    opened: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        # Taking gap g: count[g] falls by one, count[g - s] rises by one; halves of the change less one (at gap s half less, which settles ties only).
        change = count[: size - s + 1] - count[s:]
        change[count[s:] == 0] = 2 * len(lengths)  # no such bin
        gap = int(change.argmin()) + s
        if count[gap]:
            b = opened[gap].pop()
            count[gap] -= 1
        else:
            b, gap, n = n, size, n + 1
        bins[k], offsets[k] = b, size - gap
        if gap > s:
            opened[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_by(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for d, text in zip(b.column(0), b.column(1), strict=True):
                raw = ids.of(text.as_py()) + end
                n = len(raw) // 4
                # The first piece takes what whole pieces leave.
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                out += [(d.as_py(), k, i, j - i, zlib.crc32(raw[4 * i : 4 * j])) for k, (i, j) in enumerate(pairwise(cuts))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, group: int = GROUP) -> DataFrame:
    """Every piece of every row of docs and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; very long texts, blank ones too,
    are encoded whole, chunk by chunk; repeated rows and null ids are documents
    of their own, and pieces of equal length are taken in the order in which
    the group holds them; an empty table has no pieces; other columns are
    ignored.  One scan of sizes sets
    the number of groups; then pieces (not texts) are shuffled once.
    """
    ship(docs.sparkSession)
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, (got["n"] + (got["bytes"] or 0) // (4 * size)) // group)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=pdf["part"].to_numpy() * (1 << 40) + bins, offset=offsets).drop(columns="part")

    # Pieces are numbered (and written, so that they keep their numbers) and dealt by that alone: copies of a document spread over the groups.
    numbered = cut(pieces(docs, tokenizer_path, end_id, size).withColumn("number", F.monotonically_increasing_id()))
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups))).drop("number")
    return dealt.groupBy("part").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
