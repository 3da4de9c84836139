"""The daily reconcile as keyed state: every listing has its own entry, and a day only touches the listings that it names or ages.

Landed rows carry their listing as JSON and belong to a bucket of their source;
of a healthy source each bucket also gets a mark for the day.  A day is judged
once it is complete: a timer of the event time, or the first row of a later
day, settles it.  Then active listings that a healthy source hasn't shown for
some days are withdrawn, and those of a source that was out stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotwatch.operators.files import ship
from lotwatch.operators.reconcile import DAYS_TO_WITHDRAWN
from lotwatch.operators.validate import split
from lotwatch.schemas import INCOMING, LISTING

#: Buckets of a source.  It must stay as it is for the life of a checkpoint.
BUCKETS = 64
LANDED = "source string, bucket int, day date, ordinal long, id string, row string"
CHANGES = "kind string, id string, day date, old_gbp double, new_gbp double, pct double, old_status string, new_status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = ""


def bucket_of(listing_id):
    return F.pmod(F.xxhash64(listing_id), F.lit(BUCKETS)).cast("int")


def land(rows: DataFrame, day: str, folder: str) -> None:
    """Lands a day's rows (INCOMING and ordinal) that are valid, and for each source that has one a mark for each of its buckets."""
    spark = rows.sparkSession
    good, _ = split(rows)
    fields = [f.name for f in spark.createDataFrame([], INCOMING).schema]
    given = F.lit(day).cast("date").alias("day")
    own = good.select("source", bucket_of(F.col("id")).alias("bucket"), given, F.col("ordinal").cast("long").alias("ordinal"), "id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row"))
    none = F.lit(None).cast("string")
    marks = good.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"), given, F.lit(-1).cast("long").alias("ordinal"), none.alias("id"), none.alias("row"))
    own.unionByName(marks).write.mode("append").parquet(folder)


def close(spark: SparkSession, day: str, folder: str) -> None:
    """Lands word that a day is over, though no row of a later one has come."""
    after = date.fromisoformat(day) + timedelta(1)
    spark.createDataFrame([(CLOSING, 0, after, -1, None, None)], LANDED).coalesce(1).write.mode("append").parquet(folder)


def percent(old: float | None, new: float | None) -> float | None:
    """Change in percent with one decimal, halves up."""
    return float(Decimal(repr((new - old) / old * 100)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if old and new else None


class Keeper(StatefulProcessor):
    """State of one bucket of a source.

    listings: id to the listing as JSON; seen: a day to the ids last seen then
    (some may have been seen since); open: days that aren't settled.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listings = handle.getMapState("listings", "id string", "row string")
        self.seen = handle.getMapState("seen", "day string", "ids string")
        self.open = handle.getMapState("open", "day string", "healthy boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = sorted(((r.day.isoformat(), r.ordinal, r.id, r.row) for frame in rows for r in frame.itertuples()), key=lambda r: r[:2])
        out: list[tuple] = []
        if key[0] != CLOSING:
            days = sorted({r[0] for r in came})
            for day in days:
                out += self.settle(lambda d, day=day: d < day)
                named = [(r[2], json.loads(r[3])) for r in came if r[0] == day and r[3] is not None]
                for listing_id, row in named:
                    out += self.merged(listing_id, row, day)
                ids = {i for i, _ in named}
                if ids:
                    held = json.loads(self.seen.getValue((day,))[0]) if self.seen.containsKey((day,)) else []
                    self.seen.updateValue((day,), (json.dumps(sorted(ids.union(held))),))
                if not self.open.containsKey((day,)):
                    self.open.updateValue((day,), (True,))
                    end = datetime.fromisoformat(day).replace(tzinfo=timezone.utc) + timedelta(1)
                    self.handle.registerTimer(int(end.timestamp() * 1000))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).date().isoformat()
        yield self.frame(self.settle(lambda d: d < over))

    def merged(self, listing_id: str, row: dict, day: str) -> Iterator[tuple]:
        """Takes a row in: what is new or has moved."""
        entry = {"date": day, "status": row["status"], "price": row["price"]}
        if not self.listings.containsKey((listing_id,)):
            listing = row | {"first_seen": day, "last_seen": day, "history": [entry], "relist": {"possible": False, "prior_id": None, "reasons": []}}
            listing["images"] = row["images"] or []
            yield ("new", listing_id, day, None, None, None, None, None)
        else:
            listing = json.loads(self.listings.getValue((listing_id,))[0])
            was, now = listing["price"] or {}, row["price"] or {}
            moved, turned = was.get("amount") != now.get("amount"), listing["status"] != row["status"]
            if moved:
                yield ("price_changed", listing_id, day, was.get("gbp"), now.get("gbp"), percent(was.get("gbp"), now.get("gbp")), None, None)
            if turned:
                yield ("status_changed", listing_id, day, None, None, None, listing["status"], row["status"])
            listing["history"] += [entry] if moved or turned else []
            listing |= {"title": row["title"], "title_translated": row["title_translated"] or listing["title_translated"], "images": row["images"] or listing["images"], "price": row["price"], "status": row["status"], "last_seen": day}
        self.listings.updateValue((listing_id,), (json.dumps(listing),))

    def settle(self, over) -> list[tuple]:
        """Judges complete days, the earliest first: what was last seen long before them goes."""
        out = []
        for day in sorted(d for (d,) in list(self.open.keys()) if over(d)):
            last = (date.fromisoformat(day) - timedelta(DAYS_TO_WITHDRAWN)).isoformat()
            for seen in sorted(d for (d,) in list(self.seen.keys()) if d <= last):
                for listing_id in json.loads(self.seen.getValue((seen,))[0]):
                    listing = json.loads(self.listings.getValue((listing_id,))[0])
                    if listing["status"] == "active" and listing["last_seen"] == seen:
                        listing["status"] = "withdrawn"
                        listing["history"].append({"date": day, "status": "withdrawn", "price": None})
                        self.listings.updateValue((listing_id,), (json.dumps(listing),))
                        out.append(("status_changed", listing_id, day, None, None, None, "active", "withdrawn"))
                self.seen.removeKey((seen,))
            self.open.removeKey((day,))
        return out

    @staticmethod
    def frame(changes: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(changes, columns=["kind", "id", "day", "old_gbp", "new_gbp", "pct", "old_status", "new_status"])
        out["day"] = pd.Series([date.fromisoformat(d) for d in out["day"]], dtype=object)  # object, also where there is none
        return out.astype({c: float for c in ("old_gbp", "new_gbp", "pct")})


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes (CHANGES) of the days that land in a folder, as a stream."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1000).parquet(folder)
    # Noon of the day, whatever the session's time zone; the hour's delay lets further rows of the latest day in.
    rows = rows.withColumn("at", F.timestamp_seconds(F.unix_date("day") * 86400 + 43200)).withWatermark("at", "1 hour")
    return rows.groupBy("source", "bucket").transformWithStateInPandas(statefulProcessor=Keeper(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def start(spark: SparkSession, folder: str, root: str, **trigger) -> StreamingQuery:
    """Starts taking in what lands; changes are appended to root/changes, the state is kept in root/_state."""
    out = changes(spark, folder).writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/_state")
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The listings (LISTING) that the state holds."""
    state = spark.read.format("statestore").option("stateVarName", "listings").load(f"{root}/_state")
    return state.select(F.from_json(F.col("user_map_value.row"), LISTING).alias("l")).select("l.*")
