"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens that no vocabulary piece can straddle.  The
distinct new pre-tokens of a batch are held as one ragged array of symbols
(flat ids plus an owner per symbol).  In every round each sequence applies its
lowest-rank pair at all of its places at once, until no sequence has a pair
left; the surviving symbols are the tokens.  A symbol outside the vocabulary
counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import chunks, ship, table, text_of

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Remembered pre-tokens of a worker, by their memory, and the longest that is remembered; beyond it the memory starts afresh.
CACHE_BYTES, LONGEST = 96 << 20, 64
RUN = 16


class RankMerger:
    """Pair table of a sentencepiece BPE model with byte fallback, and the merging on arrays."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                score[sp.id_to_piece(i)] = sp.get_score(i)
        symbols = {p: i for i, p in enumerate(score)}
        joined = {c for p in score if len(p) > 1 for c in p}
        for c in sorted(joined):
            symbols.setdefault(c, len(symbols))
        self.n = len(symbols) + 1
        rank = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, s in score.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (rank[s], symbols[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.by_char = np.full(0x110000, self.n - 1, dtype=np.int64)
        points = np.arange(0x110000)
        self.weight = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.by_char[ord(c)] = i
                if c in score:
                    self.weight[ord(c)] = 1
        # No piece holds a space mark behind another character, so a text may be cut before each.
        assert not any(SPACE in p.lstrip(SPACE) for p in score)
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in joined)
        # A long run of spaces becomes whole runs of the longest piece from the left.
        run = f"{SPACE}{{{RUN}}}(?={SPACE}{{{RUN + 1}}})|" if SPACE * RUN in score else ""
        self.find = re.compile(f"{run}{SPACE}*[^{SPACE}{alone}]+|[{alone}]|{SPACE}+").findall
        self.known: dict[str, int] = {}
        self.held = 0

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) sequence."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, weight = self.by_char[points], self.weight[points]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        total = np.zeros(len(sequences), np.int64)
        rank = np.full(len(ids), NONE, np.int32)
        made = np.zeros(len(ids), np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same], made[same] = self._look_up(ids[same], ids[same + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                ended = np.repeat(done, sizes)
                total += np.bincount(owner[ended], weight[ended], len(total)).astype(np.int64)
                keep = ~ended
                ids, weight, owner, rank, made = ids[keep], weight[keep], owner[keep], rank[keep], made[keep]
                if not len(ids):
                    break
                sizes, least = sizes[~done], least[~done]
            segment = np.repeat(np.arange(len(sizes)), sizes)
            chosen = rank == least[segment]
            # Of overlapping places (aaa), every other one from the left.
            first = chosen & ~np.r_[False, chosen[:-1]]
            place = np.arange(len(ids))
            since = place - np.maximum.accumulate(np.where(first, place, 0))
            at = np.flatnonzero(chosen & (since % 2 == 0))
            new = made[at]
            # A merge that makes a pair of no higher rank must come alone: the leftmost of its sequence.
            risky = np.zeros(len(at), bool)
            has = (at > 0) & (owner[at - 1] == owner[at])
            risky[has] |= self._look_up(ids[at[has] - 1], new[has])[0] <= rank[at[has]]
            after = np.minimum(at + 2, len(ids) - 1)
            has = (at + 2 < len(ids)) & (owner[after] == owner[at])
            risky[has] |= self._look_up(new[has], ids[after[has]])[0] <= rank[at[has]]
            has[:-1] &= at[1:] == at[:-1] + 2
            has[-1:] = False
            risky[has] |= self._look_up(new[has], new[has])[0] <= rank[at[has]]
            if risky.any():
                alone = np.zeros(len(sizes), bool)
                alone[segment[at[risky]]] = True
                leftmost = np.r_[True, segment[at[1:]] != segment[at[:-1]]]
                at = at[leftmost | ~alone[segment[at]]]
            ids[at], weight[at] = made[at], 1
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            ids, weight, owner, rank, made = ids[keep], weight[keep], owner[keep], rank[keep], made[keep]
            touched = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(ids)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched], made[touched] = self._look_up(ids[touched], ids[touched + 1])
        return total

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = [p for p in set().union(*parts) if p not in known]
        if new:
            known.update(zip(new, self.merge(new).tolist(), strict=True))
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
            else:
                self.held += 4 * len(p) + 180
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return out


@lru_cache(maxsize=2)
def merger(model_path: str) -> RankMerger:
    return RankMerger(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs.

    A null text counts as empty (0 bytes, 0 tokens); a very long text counts
    whole, at once; repeated rows and null ids each return their own row; an
    empty table gives an empty result; other columns are ignored.  Map only: no
    shuffle.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model_path)
        for b in batches:
            n = [k for c in chunks(x.as_py() for x in b.column(1)) for k in m.count(c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = text_of(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
