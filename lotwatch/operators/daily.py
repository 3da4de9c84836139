"""A day's run: rates, sources, reconcile, run log, changes and their summary, each written under the day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch import contracts
from lotwatch.functions.normalize import needs_translation
from lotwatch.operators import fx, runlog
from lotwatch.operators.contracts import require_documents
from lotwatch.operators.files import cut
from lotwatch.operators.reconcile import Reconciled, reconcile
from lotwatch.operators.validate import require, rules
from lotwatch.schemas import FX, LISTING, RUN_LOG
from lotwatch.sources import registry
from lotwatch.sources.store import append, is_complete, latest_run, read_or_empty, write_store

CHANGES = ("new", "price_changed", "status_changed", "possible_relists")
LINE = 90


@dataclass
class Run:
    store: DataFrame
    changes: Reconciled
    log: DataFrame
    totals: DataFrame


def translated(rows: DataFrame, translate: Callable[[Column], Column] | None) -> DataFrame:
    """rows with title_translated filled by `translate` where a title needs it; without one they stay."""
    if translate is None:
        return rows
    missing = F.col("title_translated").isNull() & needs_translation(F.col("title"))
    return rows.withColumn("title_translated", F.when(missing, translate(F.col("title"))).otherwise(F.col("title_translated")))


def checked_rates(day: DataFrame, symbols: list[str]) -> DataFrame:
    """The day's rates of these currencies, failing where one is missing or they are no rates of the base."""
    positive = F.forall(F.map_values("rates"), lambda r: r > 0)
    return require(fx.checked(day, symbols), {"date": F.col("date").isNotNull(), "base": F.col("base") == "GBP", "rates": positive}, "rates")


def merged(spark: SparkSession, rows: DataFrame, results: DataFrame, held: DataFrame, before: DataFrame, today: str) -> Run:
    """A run's rows and results into the store held: what is after, what changed, the log with streaks, and totals.

    Only sources with a valid row make their listings age.  The store is
    written once and read by all that follows.
    """
    seen = results.filter("ok and records > 0").select("source")
    changes = reconcile(held, rows, seen, today)
    store = cut(require(changes.store, rules(), "listing"))
    return Run(store, changes, runlog.with_streaks(results, before), runlog.totals(store))


def checked_changes(changes: Reconciled) -> dict[str, DataFrame]:
    """The changes by name, failing where one breaks its contract."""
    held = {"price_changed": contracts.PRICE_CHANGE, "status_changed": contracts.STATUS_CHANGE, "possible_relists": contracts.POSSIBLE_RELIST}
    return {name: require_documents(getattr(changes, name), held[name], name) if name in held else getattr(changes, name) for name in CHANGES}


def run_daily(
    spark: SparkSession,
    root: str,
    today: str,
    read: Callable[[str], DataFrame],
    fetched: DataFrame | None,
    sources: dict[str, registry.Parser] = registry.SOURCES,
    translate: Callable[[Column], Column] | None = None,
    run: str | None = None,
    symbols: list[str] = fx.SYMBOLS,
) -> Run:
    """Everything that a day does, from landed payloads to written tables under root.

    fetched: the day's rates (FX) of at least the currencies `symbols`, or None
    where they couldn't be had: the last known ones serve then, as they do for
    rates that lack one.  A run is named by its day (or `run`, for another on
    the same day); what a run of the same name left unfinished is replaced.
    Tables: listings/version=<run>, rates/version=<run>, and rows with run=<run>
    in run_log, totals and one table for each kind of change.
    """
    run = run or today
    known = [v for v in versions(spark, f"{root}/listings") if v < run and is_complete(spark, f"{root}/listings/version={v}")]
    log = read_or_empty(spark, f"{root}/rates/version={known[-1]}" if known else f"{root}/rates/none", FX)
    try:
        day = None if fetched is None else cut(checked_rates(fetched, symbols))
    except Exception:  # rates must not stop a run: each price keeps the rate and its day
        day = None
    day = fx.day_or_last(day, log)
    rows, results = registry.collect(spark, read, fx.by_currency(day), sources, keep=cut)
    held = read_or_empty(spark, f"{root}/listings/version={known[-1]}" if known else f"{root}/listings/none", LISTING)
    before = latest_run(spark, f"{root}/run_log", RUN_LOG) if known else spark.createDataFrame([], RUN_LOG)
    out = merged(spark, cut(translated(rows, translate)), results, held, before, today)
    fx.upsert(log, day.select(*log.columns)).write.mode("overwrite").parquet(f"{root}/rates/version={run}")
    for name, frame in checked_changes(out.changes).items():
        append(frame, f"{root}/{name}", run=run)
    append(require_documents(out.log, contracts.SOURCE_RESULT, "run log"), f"{root}/run_log", run=run)
    append(require_documents(out.totals, contracts.TOTALS, "totals"), f"{root}/totals", run=run)
    write_store(out.store, root, run)  # last: its end marks the run as done
    return out


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the versions in a folder, in order; none where there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))


def catches(new: DataFrame, store: DataFrame) -> DataFrame:
    """id and a line of each new listing."""
    rows = new.select("id").join(store, "id")
    price = F.concat_ws(" ", F.coalesce(F.col("price.amount").cast("string"), F.lit("None")), F.col("price.currency"))
    return rows.select("id", F.concat_ws(" | ", F.concat(F.lit("new: "), "id"), F.substring("title", 1, LINE), price, "url").alias("line"))


def summary(log: DataFrame, totals: DataFrame, changes: dict[str, DataFrame], rates_of: str) -> DataFrame:
    """One row: sources that answered of how many, active listings, new ones and price changes, and a line that says so."""
    ok = log.agg(F.count_if("ok").alias("sources_ok"), F.count(F.lit(1)).alias("sources"))
    row = ok.join(F.broadcast(totals.select("active")))
    for name in ("new", "price_changed"):
        row = row.join(F.broadcast(changes[name].agg(F.count(F.lit(1)).alias(name))))  # a row each
    line = F.format_string(f"run complete: fx {rates_of}, sources ok %d/%d, active %d, new %d, price changes %d", "sources_ok", "sources", "active", "new", "price_changed")
    return row.withColumn("line", line)
