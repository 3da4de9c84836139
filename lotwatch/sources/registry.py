"""Sources by name, each a function from landed payloads and rates to INCOMING rows, read apart from one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.operators.sets import in_turn
from lotwatch.operators.validate import attempts, rules, violations
from lotwatch.schemas import RUN_LOG
from lotwatch.sources import payloads as p

Parser = Callable[[DataFrame, DataFrame], DataFrame]
#: In the order in which a run takes them.
SOURCES: dict[str, Parser] = {
    "ebay": p.api_items,
    "bringatrailer": p.auctions,
    "carsandbids": p.community_auctions,
    "hemmings": p.linked_titles,
    "goonet_exchange": p.list_view,
    "carsensor": p.cassettes,
    "yahoo_auctions": p.all_auctions,
    "kaidee": p.page_ads,
    "classiccars": p.linked_data,
    "kijiji": p.keyed_state,
    "barnfinds": p.feed,
    "flex": p.used_boxes,
    "kuruma_ex": p.car_items,
}
#: Sources of several requests, of which some may fail, and what shows that a page is no answer.
PLANNED: dict[str, Callable[[], Column]] = {
    "ebay": lambda: ~F.col("body").rlike(r"^\s*\{"),
    "yahoo_auctions": lambda: (F.col("kind") == "closed") & ~F.col("body").contains("__NEXT_DATA__"),
    "kaidee": lambda: F.coalesce(F.size(p.ads_of(F.col("body"))), F.lit(0)) <= 0,
}
#: Sources whose pages hold items before any gate, of which none at all means a moved layout, and how many a page has.
FOUND: dict[str, Callable[[], Column]] = {"ebay": lambda: p.api_found(F.col("body"))}
#: Rows of a source are numbered within this.
ROWS = 1 << 44


def landed(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Bodies of the files that a crawler left for a source, named <turn>-<kind>[-...]: url, body, turn, kind."""
    rows = spark.read.text(f"{folder}/{source}", wholetext=True).select(F.input_file_name().alias("url"), F.nullif(F.col("value"), F.lit("")).alias("body"))
    name = F.substring_index("url", "/", -1)
    return rows.withColumns({"turn": F.coalesce(F.regexp_extract(name, "^([0-9]+)", 1).try_cast("int"), F.lit(0)), "kind": F.nullif(F.regexp_extract(name, "^[0-9]+-([a-z]+)", 1), F.lit(""))})


def answered(rows: DataFrame, source: str) -> tuple[DataFrame, str]:
    """The pages of a source that are answers, and a note if some aren't.

    An error if no page is an answer, if one isn't and the source has no plan of
    several requests, or if no answer holds a single item where some must
    (the canary: a search without any hit is a moved layout, not an empty market).
    """
    rows = p.numbered(rows)
    bad = F.col("body").isNull() | F.coalesce(PLANNED.get(source, lambda: F.lit(False))(), F.lit(False))
    raw = F.when(~bad, FOUND.get(source, lambda: F.lit(None).cast("int"))())
    tries = rows.select(F.lit(source).alias("source"), bad.alias("failed"), raw.alias("raw"))
    got = attempts(tries).first()
    if got is None or got["verdict"] == "failed":
        raise ValueError(f"all {got['tries'] if got else 0} requests failed")
    if got["verdict"] == "canary":
        raise ValueError(f"canary: no item in {got['tries'] - got['failures']} answers")
    note = f"{got['failures']} of {got['tries']} requests failed" if got["failures"] else ""
    if note and source not in PLANNED:
        raise ValueError(note)
    return rows.filter(~bad), note


def collect(spark: SparkSession, read: Callable[[str], DataFrame], rates: DataFrame, sources: dict[str, Parser] = SOURCES, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """Valid rows of all sources in turn, with a unique ordinal, and each source's result (RUN_LOG).

    A source that fails is noted and leaves the others alone.  Its pages are
    parsed once: what it gives, marked as valid or not, is kept (by default
    persisted; a job may write it instead), counted, and taken in from there.
    """
    frames, results = [], []
    for i, (name, parse) in enumerate(sources.items()):
        try:
            rows, note = answered(read(name), name)
            marked = keep(parse(rows, rates).withColumn("_fine", F.size(violations(rules())) == 0))
            n = marked.agg(F.count_if("_fine").alias("good"), F.count_if(~F.col("_fine")).alias("bad")).first()
            if n["bad"]:
                note = "; ".join(x for x in (note, f"{n['bad']} invalid record(s) dropped") if x)
            frames.append(marked.filter("_fine").drop("_fine").withColumn("ordinal", F.col("ordinal") + i * ROWS))
            results.append((name, True, n["good"], note, 0))
        except Exception as e:  # one source's failure is a result of its own
            results.append((name, False, 0, str(e)[:200], 0))
    log = spark.createDataFrame(results, RUN_LOG)
    if not frames:
        raise ValueError("no source could be read")
    return in_turn(frames, "turn").drop("turn"), log
