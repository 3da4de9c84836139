"""Backfill from the flat schema of before, and daily snapshots by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.functions import classify, normalize
from lotwatch.schemas import HISTORY, LISTING, PRICE

FLAT = (
    "id string, source string, source_url string, title string, price_original double, currency string, price_gbp double, fx_rate_used double, fx_date date, country string, region string, "
    "drive_side string, year int, condition_notes string, king_cab_signals array<string>, photo_urls array<string>, first_seen date, last_seen date, "
    "price_history array<struct<date:date,price_original:double,price_gbp:double>>, status string, relisted_from string"
)

# Countries as they were written before.
COUNTRIES = {"United States": "US", "United Kingdom": "GB", "Germany": "DE", "Australia": "AU", "Japan": "JP", "Canada": "CA"}


def converted(flat: DataFrame) -> DataFrame:
    """LISTING rows of flat ones: the history from the prices, the last status if the listing has ended, else one entry of what it is.

    An id loses its source and a dash in front, and nothing else; a currency is
    USD, a driver's side unknown, a rate's day the first sight's where missing.
    """
    start = F.concat("source", F.lit("-"))
    native = F.when(F.col("id").startswith(start), F.substring("id", F.length(start) + 1, F.length("id"))).otherwise(F.col("id"))
    currency, seen = F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")), F.coalesce("fx_date", "first_seen")

    def price(amount: Column, gbp: Column, day: Column) -> Column:
        return F.struct(amount.alias("amount"), currency.alias("currency"), gbp.alias("gbp"), F.col("fx_rate_used").alias("fx_rate"), day.alias("fx_date")).cast(PRICE)

    now, none = price(F.col("price_original"), F.col("price_gbp"), seen), F.lit(None).cast(PRICE)
    entry = lambda day, status, p: F.struct(day.alias("date"), status.alias("status"), p.alias("price"))
    past = F.transform(F.coalesce("price_history", F.array().cast("array<struct<date:date,price_original:double,price_gbp:double>>")), lambda h: entry(h["date"], F.lit("active"), price(h["price_original"], h["price_gbp"], h["date"])))
    end = F.when(F.col("status") == "active", F.array().cast(HISTORY)).otherwise(F.array(entry(F.col("last_seen"), F.col("status"), none)).cast(HISTORY))
    history = F.concat(past.cast(HISTORY), end)
    country = normalize.lookup(F.coalesce("country", F.lit("")), COUNTRIES, F.lit("XX"))
    columns = {
        "id": F.concat("source", F.lit(":"), native),
        "source_listing_id": native,
        "url": F.col("source_url"),
        "title_translated": F.lit(None).cast("string"),
        "description_snippet": F.col("condition_notes"),
        "country": country,
        "drive_side": F.coalesce(F.nullif("drive_side", F.lit("")), F.lit("unknown")),
        "king_cab": classify.keywords(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        "price": now,
        "images": F.coalesce("photo_urls", F.array().cast("array<string>")),
        "history": F.when(F.size(history) > 0, history).otherwise(F.array(entry(F.col("first_seen"), F.col("status"), now)).cast(HISTORY)),
        "relist": F.struct(F.lit(False).alias("possible"), F.lit(None).cast("string").alias("prior_id"), F.array().cast("array<string>").alias("reasons")),
    }
    names = flat.sparkSession.createDataFrame([], LISTING).columns
    return flat.select(*[columns.get(c, F.col(c)).alias(c) for c in names])


def imported(store: DataFrame, flat: DataFrame) -> DataFrame:
    """store with converted rows of ids that it lacks; running it again changes nothing."""
    return store.unionByName(converted(flat).join(store.select("id"), "id", "left_anti"))


def snapshots(spark: SparkSession, folder: str, schema: str = FLAT) -> DataFrame:
    """Rows of daily files, with the day from the file's name."""
    rows = spark.read.schema(schema).json(folder, multiLine=True).select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.withColumn("snapshot_date", F.to_date(F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})", 1))).drop("_file")
