"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Native throughout.  Token counts are summed into cells of source, language and
topic; the cells' weights are raked in turn to the targets of each margin until
all are met; a document's probability is its cell's weight over its cell's
tokens, scaled so that no cell asks for more than it has: then the expected
sample has the targets' shares in every margin.  Only cells are iterated over,
each round written to the checkpoint folder.

Tokens are estimated natively as a fourth of the text's UTF-8 bytes, which
holds for scripts with and without blanks alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, once, table

MARGINS = ("source", "lang", "topic")
#: Rounds end when no margin is further than this from its target, or after so many.
NEAR, MOST_ROUNDS = 1e-10, 25
#: Targets are shares to this power: 1 leaves the mix, 0 makes it even.
TEMPER = {"source": 1.0, "lang": 0.9, "topic": 0.9}
TOKENS = 1.0  # sampled tokens hoped for, as a share of all; less where a probability would exceed 1
SEED = "mix"
#: Documents of a stratum (a cell, or of a large one a part of about so many) are drawn systematically.
STRATUM = 5000
BYTES_A_TOKEN = 4
#: Topics: what marks one, and about how many bytes of it a mark stands for.
TOPICS = (
    ("license", "[Ll]icen[cs]e|[Cc]opyright|[Ww]arrant(?:y|ies)|[Rr]ights reserved", 60),
    ("code", r'[=({] *"|[;{}]|\) *:', 30),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9]|[0-9][0-9 ().-]{8,}[0-9]", 20),
    ("symbols", "[#*$%&|<>]{3}", 5),
)
#: A topic's marks stand for a hundredth of the text at least, else it is prose.
PARTS, OTHER = 100, "prose"


def topic_of(text: Column) -> Column:
    """The topic whose marks stand for most of a text (ties: the first in TOPICS)."""
    scores = once(F.array(*[F.regexp_count(text, F.lit(mark)) * size for _, mark, size in TOPICS]))

    def named(s: Column) -> Column:
        most = F.array_max(s)
        names = F.array(*[F.lit(name) for name, _, _ in TOPICS])
        return F.when((most > 0) & (most * PARTS >= F.octet_length(text)), F.get(names, F.array_position(s, most).cast("int") - 1)).otherwise(OTHER)

    return F.get(F.transform(F.array(scores), named), F.lit(0))


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """Targets of a margin: its values' shares of all tokens, to a power, scaled to sum to 1; a value without tokens has none."""
    total = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).withColumn("t", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(temper))).otherwise(0.0))
    whole = total.agg(F.sum("t").alias("all"))
    return total.join(F.broadcast(whole)).select(margin, F.coalesce(F.try_divide("t", "all"), F.lit(0.0)).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, near: float = NEAR) -> DataFrame:
    """cells(margins, tokens) with weight: shares whose margins are `near` their targets(value, target), or come so after `rounds`.

    Where empty cells leave no such weights, the last round's stand: the last
    margin met, the others as near as they came.
    """
    whole = cells.agg(F.sum("tokens").cast("double").alias("all"))
    cells = cells.join(F.broadcast(whole)).withColumn("weight", F.coalesce(F.try_divide(F.col("tokens").cast("double"), "all"), F.lit(0.0))).drop("all")
    # Cells bear their targets, so that a round joins nothing but its sums: each plan that the driver has run stays in its memory.
    goals = [f"_{m}" for m in MARGINS]
    for margin, goal in zip(MARGINS, goals, strict=True):
        cells = cells.join(targets[margin].select(margin, F.col("target").alias(goal)), margin)
    cells = cut(cells.select(*MARGINS, "tokens", "weight", *goals))
    for _ in range(rounds):
        for margin, goal in zip(MARGINS, goals, strict=True):
            sums = cells.groupBy(margin).agg(F.sum("weight").alias("sum"))
            factor = F.coalesce(F.try_divide(goal, "sum"), F.lit(0.0))
            cells = cells.join(sums, margin).select(*MARGINS, "tokens", (F.col("weight") * factor).alias("weight"), *goals)
        cells = cut(cells)
        if off(cells, MARGINS[:-1]) <= near:  # the last one is met by its turn
            break
    return cells.drop(*goals)


def off(cells: DataFrame, margins: tuple[str, ...]) -> float:
    """The largest distance of some margins' weights from the targets that cells bear."""
    sums = [cells.groupBy(m).agg(F.sum("weight").alias("sum"), F.max(f"_{m}").alias("target")).select("sum", "target") for m in margins]
    return reduce(DataFrame.unionAll, sums).agg(F.max(F.abs(F.col("sum") - F.col("target"))).alias("off")).first()["off"] or 0.0


def keys(source: Column, lang: Column, text: Column) -> dict[str, Column]:
    """The cell of a document, and its tokens."""
    text = F.coalesce(text, F.lit(""))
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = ((F.octet_length(text) + (BYTES_A_TOKEN - 1)) / BYTES_A_TOKEN).cast("long")
    return {"source": value(source), "lang": value(lang), "topic": topic_of(text), "tokens": tokens}


def calibrated(cells: DataFrame, targets: dict[str, DataFrame] | None, temper: dict[str, float] | None, rounds: int, tokens: float) -> DataFrame:
    """weight and probability of each cell(margins, tokens).

    Where a cell wants a probability over 1, all are divided by the largest, so
    that the expected sample meets the targets: it is smaller, not off them.
    """
    targets = targets or {m: cut(tempered(cells, m, (temper or TEMPER)[m])) for m in MARGINS}
    raked = rake(cells, targets, rounds)
    per_token = F.try_divide(F.col("weight"), F.col("tokens").cast("double"))
    whole = raked.agg(F.sum("tokens").cast("double").alias("all"), F.max(per_token).alias("most"))
    share = F.lit(tokens) * per_token * F.col("all") / F.greatest(F.lit(1.0), F.lit(tokens) * F.col("most") * F.col("all"))
    return raked.join(F.broadcast(whole)).select(*MARGINS, "weight", F.coalesce(F.least(F.lit(1.0), share), F.lit(1.0)).alias("probability"))


def mark(doc_id: Column, seed: str) -> Column:
    """Hexadecimal digits by id and seed."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))))


def part(digits: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(digits, first, n), 16, 10).cast("long")


def drawn(rows: DataFrame, seed: str, stratum: int = STRATUM) -> DataFrame:
    """rows(doc_id, margins, tokens, probability, ...) with `sampled`.

    Strata are cells, split by a hash where they are large.  Within one
    documents stand by tokens, those of one size by a hash, and every (1 / probability)-th is taken from a hashed start on: each document
    has its cell's probability, and a cell's sampled tokens are nearly its
    share of them, where independent draws would miss it by chance.
    """
    rows = rows.withColumn("_digits", mark(F.col("doc_id"), seed))
    counts = rows.groupBy(*MARGINS).agg(F.ceil(F.count(F.lit(1)) / stratum).alias("_parts"))
    rows = rows.join(counts, list(MARGINS)).withColumn("_part", F.pmod(part(F.col("_digits"), 1, 8), F.col("_parts")))
    w = Window.partitionBy(*MARGINS, "_part").orderBy("tokens", part(F.col("_digits"), 9, 13), "doc_id")
    start = part(F.md5(F.concat_ws(":", F.lit(seed), *MARGINS, "_part")), 1, 13) / F.lit(float(1 << 52))
    at = lambda place: F.floor(place * F.col("probability") + start)
    place = F.row_number().over(w)
    return rows.withColumn("_place", place).withColumn("sampled", at(F.col("_place")) > at(F.col("_place") - 1)).drop("_digits", "_parts", "_part", "_place")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] | None = None, rounds: int = MOST_ROUNDS, tokens: float = TOKENS, seed: str = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled of every row of docs.

    targets: a frame (value, target) for each margin; by default the corpus's
    own shares to the powers `temper` (TEMPER).  Null sources and languages are values of
    their own (""); null and empty texts have no tokens, and a cell without
    tokens has weight 0 and its documents probability 1 (they take no share);
    a very long text counts whole.  Rows are drawn each by itself (see drawn),
    repeated ones and those without an id too; an empty table has no cells;
    other columns are ignored.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in keys(F.col("source"), F.col("lang"), F.col("text")).items()]))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    out = rows.join(calibrated(cells, targets, temper, rounds, tokens), list(MARGINS))
    out = drawn(out.withColumn("probability", F.round("probability", 9)), seed)
    return out.select("doc_id", *MARGINS, "tokens", F.round("weight", 7).alias("weight"), F.round("probability", 5).alias("probability"), "sampled")


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] | None = None, rounds: int = MOST_ROUNDS, tokens: float = TOKENS, seed: str = SEED) -> DataFrame:
    """The rows of docs that mix() would sample, with all their columns; cells and numbers of rows are shuffled, texts once, to the rows that stay.

    Nulls, empty and long texts, repeated rows and empty tables are as there;
    columns may have any names.  docs is read twice, so it should be a table.
    """
    numbered = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"))
    keyed = cut(numbered.select("number", F.col("row.doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in keys(F.col("row.source"), F.col("row.lang"), F.col("row.text")).items()], F.xxhash64("row.doc_id", "row.text").alias("hash")))
    cells = cut(keyed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    out = keyed.join(calibrated(cells, targets, temper, rounds, tokens), list(MARGINS)).withColumn("probability", F.round("probability", 9))
    stay = cut(drawn(out, seed).filter("sampled").select("number", "hash"))
    # The hash makes sure that a number is the same row's in both reads.
    rows = numbered.withColumn("hash", F.xxhash64("row.doc_id", "row.text")).join(stay, ["number", "hash"], "left_semi")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    scores = ", ".join(f"len(regexp_extract_all(text, '{mark}')) * {size} AS s{i}" for i, (_, mark, size) in enumerate(TOPICS))
    most = f"greatest({', '.join(f's{i}' for i in range(len(TOPICS)))})"
    topic = f"CASE WHEN {most} = 0 OR {most} * {PARTS} < bytes THEN '{OTHER}' " + " ".join(f"WHEN s{i} = {most} THEN '{name}'" for i, (name, _, _) in enumerate(TOPICS)) + " END"
    steps = [
        f"""t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, octet_length(encode(text)) AS bytes, {scores}
  FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents))""",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST((bytes + {BYTES_A_TOKEN - 1}) // {BYTES_A_TOKEN} AS BIGINT) AS tokens FROM t)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, t / sum(t) OVER () AS target FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN sum(tokens) ** {TEMPER[m]} ELSE 0 END AS t FROM cells GROUP BY {m}))")
    n = 0
    for _ in range(12):  # enough for the tables at hand; more rounds change nothing
        for m in MARGINS:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT r.* REPLACE (coalesce(weight * target / nullif(sum(weight) OVER (PARTITION BY r.{m}), 0), 0) AS weight) FROM r{n} r JOIN t_{m} t ON r.{m} = t.{m})")
            n += 1
    steps.append(f"k AS (SELECT *, {TOKENS} * weight * sum(tokens) OVER () / nullif(tokens, 0) AS share FROM r{n})")
    steps.append("p AS (SELECT source, lang, topic, weight, coalesce(least(1.0, share / greatest(1.0, max(share) OVER ())), 1.0) AS probability FROM k)")
    digits = f"md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    cell = "source, lang, topic"
    part = lambda d, first, n: f"CAST(('0x' || substr({d}, {first}, {n})) AS BIGINT)"
    start = part(f"md5(concat_ws(':', '{SEED}', source, lang, topic, part))", 1, 13)
    steps += [
        f"q AS (SELECT doc_id, {cell}, d.tokens, weight, round(probability, 9) AS probability, {digits} AS digits FROM d JOIN p USING ({cell}))",
        f"s AS (SELECT *, {part('digits', 1, 8)} % CAST(ceil(count(*) OVER (PARTITION BY {cell}) / {STRATUM}.0) AS BIGINT) AS part FROM q)",
        f"o AS (SELECT *, row_number() OVER (PARTITION BY {cell}, part ORDER BY tokens, {part('digits', 9, 13)}, doc_id NULLS FIRST) AS place, {start} / {float(1 << 52)} AS begin FROM s)",
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {cell}, tokens, round(weight, 7) AS weight, round(probability, 5) AS probability, floor(place * probability + begin) > floor((place - 1) * probability + begin) AS sampled FROM o"


OP2_SQL = _sql()
