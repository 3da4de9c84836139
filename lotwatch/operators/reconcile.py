"""Reconciling a run's listings with the store: new, moved, aged out, reactivated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.normalize import to_tenth
from lotwatch.operators.files import cut
from lotwatch.operators.relist import relists
from lotwatch.schemas import HISTORY, PRICE, RELIST

DAYS_TO_WITHDRAWN = 3


@dataclass
class Reconciled:
    """A run's changes and the store after it; relists are looked for when they, or the store with its marks of them, are asked for."""

    new: DataFrame
    price_changed: DataFrame
    status_changed: DataFrame
    relists: Callable[[], DataFrame]
    after: Callable[[DataFrame | None], DataFrame]

    @cached_property
    def possible_relists(self) -> DataFrame:
        return cut(self.relists())

    @cached_property
    def merged(self) -> DataFrame:
        """The store, but for this run's marks of relists, for those who don't read them."""
        return self.after(None)

    @cached_property
    def store(self) -> DataFrame:
        return self.after(self.possible_relists)


def _pct(old, new):
    return F.when((old != 0) & (new != 0), to_tenth((new - old) / old * 100))


def reconcile(store: DataFrame, incoming: DataFrame, seen: DataFrame, today: str, days: int = DAYS_TO_WITHDRAWN) -> Reconciled:
    """Merge incoming (INCOMING and a unique `ordinal`) into store (LISTING).

    A row is compared with the one before it of the same id: the store's, or an
    earlier one of this run.  seen(source): sources whose missing listings age.
    One shuffle by id serves the merge and all changes, which read what it
    brought together from the shared folder; relists join by source.
    """
    day = F.lit(today).cast("date")
    held = store.withColumns({"ordinal": F.lit(-1).cast("long"), "_old": F.lit(True)})
    came = incoming.withColumns({"ordinal": F.col("ordinal").cast("long"), "_old": F.lit(False)})
    both = held.unionByName(came, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("ordinal")
    was = F.lag(F.struct("price", "status")).over(w)
    both = both.withColumn("_was", was).withColumn("_new", ~F.col("_old") & F.col("_was").isNull())
    changed = ~F.col("_old") & F.col("_was").isNotNull()
    both = cut(both.withColumns({"_price_moved": changed & ~F.col("price.amount").eqNullSafe(F.col("_was.price.amount")), "_status_moved": changed & (F.col("status") != F.col("_was.status"))}))

    fresh = both.filter("_new")
    new = fresh.select("id", "ordinal")
    price_changed = both.filter("_price_moved").select("id", F.col("_was.price.gbp").alias("old_gbp"), F.col("price.gbp").alias("new_gbp"), _pct(F.col("_was.price.gbp"), F.col("price.gbp")).alias("pct"))
    moved = both.filter("_status_moved").select("id", F.col("_was.status").alias("old_status"), F.col("status").alias("new_status"))

    entry = F.when(F.col("_new") | F.col("_price_moved") | F.col("_status_moved"), F.struct("ordinal", F.struct(day.alias("date"), "status", "price").alias("entry")))
    filled = lambda c, ok: F.max_by(c, F.when(ok, F.col("ordinal")))
    frozen = ["source", "source_listing_id", "url", "description_snippet", "region", "year", "country", "drive_side", "king_cab"]
    merged = both.groupBy("id").agg(
        F.min_by(F.struct(*frozen, "history", "relist", "first_seen", "last_seen"), "ordinal").alias("f"),
        F.max_by(F.struct("title", "price", "status"), "ordinal").alias("l"),
        filled("title_translated", F.coalesce("title_translated", F.lit("")) != "").alias("title_translated"),
        filled("images", F.size("images") > 0).alias("images"),
        F.bool_or(~F.col("_old")).alias("came"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    merged = merged.join(seen.select(F.col("source").alias("_seen")).distinct(), F.col("f.source") == F.col("_seen"), "left")
    last_seen = F.when(F.col("came"), day).otherwise(F.col("f.last_seen"))
    aged = ~F.col("came") & (F.col("l.status") == "active") & F.col("_seen").isNotNull() & (F.date_diff(day, F.col("f.last_seen")) >= days)
    merged = merged.withColumn("_aged", F.coalesce(aged, F.lit(False)))
    gone = F.array(F.struct(day.alias("date"), F.lit("withdrawn").alias("status"), F.lit(None).cast(PRICE).alias("price")))
    history = F.concat(F.coalesce("f.history", F.array().cast(HISTORY)), F.transform("entries", lambda e: e["entry"]).cast(HISTORY), F.when(F.col("_aged"), gone).otherwise(F.array()).cast(HISTORY))
    none = F.struct(F.lit(False).alias("possible"), F.lit(None).cast("string").alias("prior_id"), F.array().cast("array<string>").alias("reasons")).cast(RELIST)
    columns = {c: F.col(f"f.{c}") for c in frozen} | {
        "title": F.col("l.title"),
        "title_translated": F.col("title_translated"),
        "images": F.coalesce("images", F.array().cast("array<string>")),
        "price": F.col("l.price"),
        "status": F.when(F.col("_aged"), "withdrawn").otherwise(F.col("l.status")),
        "first_seen": F.coalesce("f.first_seen", day),
        "last_seen": last_seen,
        "history": history,
        "relist": F.coalesce(F.col("found").cast(RELIST), F.col("f.relist"), none),
    }

    def after(relisted: DataFrame | None) -> DataFrame:
        mark = F.struct(F.lit(True).alias("possible"), "prior_id", "reasons").cast(RELIST).alias("found") if relisted is not None else None
        marked = merged.withColumn("found", F.lit(None).cast(RELIST)) if mark is None else merged.join(relisted.select("id", mark), "id", "left")
        return marked.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in store.columns])

    withdrawn = merged.filter("_aged").select("id", F.lit("active").alias("old_status"), F.lit("withdrawn").alias("new_status"))
    return Reconciled(new, price_changed, moved.unionByName(withdrawn), lambda: relists(fresh, both.filter("_old"), both.filter("not _old")), after)
