"""Possible relists: a new listing like one of the same source that has ended."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lotwatch.operators.files import cut, ship

SIMILAR = 0.75
PRICE_WITHIN = 15.0
#: Steps of a price's logarithm by which prices meet.
STEP = 0.02
#: Titles longer than this aren't compared by their characters first.
LONG_TITLE = 300


@F.pandas_udf(DoubleType())
def likeness(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff/Obershelp ratio of (old, new), which depends on their order."""
    for old, new in batches:
        yield pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(old, new, strict=True)], dtype=float)


# Else a filter on its result would run it a second time.
likeness = likeness.asNondeterministic()


def characters(title: Column) -> Column:
    """Each character of a title with how many of it stand before: what two such lists share bounds what the titles can match."""
    each = F.filter(F.array_sort(F.split(title, "")), lambda x: x != "")
    numbered = F.transform(each, lambda x, i: F.concat(x, (i - F.array_position(each, x)).cast("string")))
    return F.when(F.length(title) <= LONG_TITLE, numbered)


def step_of(amount: Column) -> Column:
    return F.when(amount > 0, F.floor(F.log(amount) / STEP).cast("long"))


def ended_states(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """States of ended listings with their turns: `ordinal` to `until`, and `rank`, the listing's own turn in the store.

    A listing's state is the store's until its id comes in this run, then the incoming one's until that comes again.
    """
    state = ["id", "source", "title", "status", "country", F.col("price.amount").alias("amount")]
    held = store.select(*state, F.lit(-1).cast("long").alias("ordinal"), F.col("first_seen").alias("since"))
    came = incoming.select(*state, F.col("ordinal").cast("long").alias("ordinal"), F.lit(None).cast("date").alias("since"))
    w = Window.partitionBy("id").orderBy("ordinal")
    return held.unionByName(came).withColumn("until", F.lead("ordinal").over(w)).withColumn("rank", F.min("ordinal").over(w)).filter("status <> 'active'")


def preferred(prefix: str = "") -> Column:
    """Of equally likely predecessors the greatest of this counts: first in the store's order, seen first the latest, the greater id."""
    return F.struct((-F.col("rank")).alias("rank"), F.coalesce(F.unix_date(f"{prefix}since"), F.lit(-(1 << 40))).alias("since"), F.col(f"{prefix}id").alias("id"))


def leading(old: DataFrame, by: list[str]) -> DataFrame:
    """old without those that another one of the same `by`, which has come before and stays, is preferred to at every turn.

    Those that came once, be it from the store or in this run, are preferred in
    the order in which they came, so one of them stays, which partial sums
    find.  Only listings that came again in this run are compared turn by turn.
    """
    once = F.col("until").isNull() & (F.col("rank") == F.col("ordinal"))
    one = old.filter(once).groupBy(*by).agg(F.max_by(F.struct(*[c for c in old.columns if c not in by]), preferred()).alias("r")).select(*by, "r.*").select(*old.columns)
    w = Window.partitionBy(*by).orderBy("ordinal", F.desc(preferred())).rowsBetween(Window.unboundedPreceding, -1)
    again = old.filter(~once).withColumn("_best", F.max(F.when(F.col("until").isNull(), preferred())).over(w))
    return one.unionByName(again.filter(F.col("_best").isNull() | (preferred() > F.col("_best"))).drop("_best"))


def relists(fresh: DataFrame, store: DataFrame, incoming: DataFrame, least: float = SIMILAR, within: float = PRICE_WITHIN) -> DataFrame:
    """id, prior_id, reasons, similarity of new listings with a likely predecessor.

    A similarity join in which what a new listing meets doesn't grow with a
    source that holds many alike:

    - Pairs meet by their second signal: the country, or steps of the price.
      Steps that lie wholly within the limit need no look at the price; only
      those at its ends do.
    - Of ended listings alike in what they meet by (source, title, and country
      or step) only those stay that could ever be the choice (`leading`).
    - Lengths, then the characters that titles share, bound the likeness from
      above; pairs of distinct titles that pass are compared once.
    """
    ship(fresh.sparkSession)
    old = ended_states(store, incoming).withColumn("title", F.lower(F.coalesce("title", F.lit(""))))
    new = fresh.select("id", "source", F.lower(F.coalesce("title", F.lit(""))).alias("title"), "country", F.col("price.amount").alias("amount"), "ordinal")
    # |new - old| / old <= within, for positive prices: old lies between new / (1 + w) and new / (1 - w).
    low, high = F.log(F.col("amount") / (1 + within / 100)), F.log(F.col("amount") / (1 - within / 100))
    first, last = F.floor(low / STEP).cast("long"), F.floor(high / STEP).cast("long")
    edge = lambda s: (s <= first + 1) | (s >= last - 1)  # noqa: E731  a step more at either end, for what rounding may do
    steps = F.when(F.col("amount") > 0, F.sequence(first - 1, last + 1))
    price_meets = F.transform(steps, lambda s: F.struct(F.when(edge(s), "edge").otherwise("inner").alias("by"), s.cast("string").alias("of")))
    none = F.array().cast("array<struct<by:string,of:string>>")
    country = F.when(F.col("country") != "XX", F.array(F.struct(F.lit("country").alias("by"), F.col("country").alias("of"))))
    # Prices below nought meet as edges of a step of their own.
    odd = F.when(F.col("amount") < 0, F.array(F.struct(F.lit("edge").alias("by"), F.lit("below").alias("of"))))
    meets = new.withColumn("meet", F.explode(F.concat(*[F.coalesce(c, none) for c in (country, price_meets, odd)])))

    of = F.coalesce(step_of(F.col("amount")).cast("string"), F.when(F.col("amount") < 0, "below"))
    kinds = F.array(
        F.when(F.col("country") != "XX", F.struct(F.lit("country").alias("by"), F.col("country").alias("of"), F.lit(None).cast("double").alias("at"))),
        F.when(of.isNotNull(), F.struct(F.lit("inner").alias("by"), of.alias("of"), F.lit(None).cast("double").alias("at"))),
        F.when(of.isNotNull(), F.struct(F.lit("edge").alias("by"), of.alias("of"), F.col("amount").alias("at"))),
    )
    had = leading(old.withColumn("k", F.explode(F.array_compact(kinds))), ["source", "title", "k"])
    had = had.select("source", F.struct("k.by", "k.of").alias("meet"), *[F.col(c).alias(f"old_{c}") for c in ("id", "title", "country", "amount", "ordinal", "since")], "until", "rank")

    # A likeness of `least` bounds how far lengths may differ, so pairs meet by steps of it too.
    long = 0.001 - math.log(least / (2 - least))
    size = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / long).cast("long")
    meets = meets.withColumn("long", size("title"))
    near = (-1, 0, 1) if least < 1 else (0,)
    had = had.withColumn("long", F.explode(F.array(*[size("old_title") + k for k in near])))
    by_title = [F.col("old_title") == F.col("title")] if least >= 1 else []
    had = had.select(*[F.col(c).alias(f"_{c}") if c in ("source", "meet", "long") else F.col(c) for c in had.columns])
    # Files say little of how large either side becomes here, so neither is to be broadcast.
    pairs = meets.join(had.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in ("source", "meet", "long")] + by_title).filter((F.col("id") != F.col("old_id")) & (F.col("old_ordinal") < F.col("ordinal")) & (F.col("until").isNull() | (F.col("until") >= F.col("ordinal"))))
    delta = F.when((F.col("old_amount") != 0) & (F.col("amount") != 0), F.abs(F.col("amount") - F.col("old_amount")) / F.col("old_amount") * 100)
    same = F.coalesce((F.col("old_country") != "XX") & (F.col("old_country") == F.col("country")), F.lit(False))
    pairs = pairs.withColumns({"_same": same, "_delta": F.when(delta <= within, delta)}).filter("_same or _delta is not null")

    if least >= 1:
        found = pairs.withColumn("similarity", F.lit(1.0))
    else:
        both = F.length("old_title") + F.length("title")
        shared = F.size(F.array_intersect(characters(F.col("old_title")), characters(F.col("title"))))
        likely = pairs.filter(2 * F.least(F.length("old_title"), F.length("title")) >= F.lit(least) * both)
        titles = cut(likely.select("old_title", "title").distinct())  # or the filters would move to the pairs before it, of which there are many more
        alike = titles.filter(F.coalesce(2 * F.when(shared >= 0, shared), both) >= F.lit(least) * both)
        alike = alike.withColumn("similarity", likeness("old_title", "title")).filter(F.col("similarity") >= least)
        found = likely.join(alike, ["old_title", "title"])
    chosen = F.struct("similarity", preferred("old_"))
    best = found.groupBy("id", "ordinal").agg(F.max_by(F.struct("old_id", "old_country", "_same", "_delta", "similarity"), chosen).alias("b")).select("id", "b.*")
    reasons = F.array_compact(
        F.array(
            F.format_string("title similarity %.2f", "similarity"),
            F.when(F.col("_same"), F.concat(F.lit("same country ("), "old_country", F.lit(")"))),
            F.when(F.col("_delta").isNotNull(), F.concat(F.lit("price within "), F.format_number("_delta", 0), F.lit("%"))),
        )
    )
    return best.select("id", F.col("old_id").alias("prior_id"), reasons.alias("reasons"), "similarity")
