"""Exchange rates: lookup, backward as-of, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The currencies that a day's rates must have.
SYMBOLS = ["USD", "EUR", "JPY", "AUD", "ZAR", "THB", "CAD", "MXN"]


def convert(df: DataFrame, rates: DataFrame, on: str = "currency") -> DataFrame:
    """df with the rate of its currency; rates(currency, rate). Spark broadcasts rates if they are small."""
    return df.join(rates.withColumnRenamed("currency", on), on, "left")


def as_of(df: DataFrame, rates: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """df with the last `value` of rates(key, at, value), of any days, not after the day df.at.

    Rates are a few a day: they are spread over the days until the next one, up
    to the last day of df, and met by equality of key and day, so that neither
    a key nor a day of many rows makes a task of its own.
    """
    w = Window.partitionBy(key).orderBy(at)
    end = df.agg(F.max(F.to_date(at)).alias("_end"))
    known = rates.filter(F.col(value).isNotNull()).select(key, F.to_date(at).alias("_from"), value, F.lead(F.to_date(at)).over(w).alias("_next"))
    known = known.join(F.broadcast(end)).withColumn("_until", F.coalesce(F.date_sub("_next", 1), F.greatest("_end", "_from")))  # one row
    days = known.filter("_until >= _from").select(key, value, F.explode(F.sequence("_from", "_until")).alias("_day"))
    return df.withColumn("_day", F.to_date(at)).join(days, [key, "_day"], "left").drop("_day").select(*df.columns, value)


def day_or_last(fetched: DataFrame | None, log: DataFrame) -> DataFrame:
    """The day's rates if they could be had, else the last ones of the log; an error where there are neither."""
    if fetched is not None:
        return fetched
    last = latest(log)
    if last.isEmpty():
        raise ValueError("no rates, and none from before")
    return last


def parsed(payload: DataFrame) -> DataFrame:
    """payload(body, fetched_at) to FX: the day, base and rates of an API's JSON."""
    data = F.from_json("body", "date date, base string, rates map<string,double>")
    return payload.select(data.alias("d"), "fetched_at").select("d.date", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "d.base", "d.rates")


def by_currency(day: DataFrame, base: str = "GBP") -> DataFrame:
    """currency, rate, date of a day's map of rates, and the base itself at 1."""
    rows = day.select("date", F.explode(F.map_concat("rates", F.create_map(F.lit(base), F.lit(1.0)))).alias("currency", "rate"))
    return rows.select("currency", "rate", "date")


def upsert(log: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """log with the rows of new in the place of those of the same key."""
    return log.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(log: DataFrame, key: str = "date") -> DataFrame:
    """The row of the greatest key, without a global sort."""
    row = log.agg(F.max_by(F.struct(*log.columns), key).alias("r"))
    return row.filter("r is not null").select("r.*")


def checked(payload: DataFrame, symbols: list[str]) -> DataFrame:
    """payload(date, base, rates) with the asked symbols only; an error if one is missing."""
    wanted = F.array(*map(F.lit, symbols))
    missing = F.array_except(wanted, F.map_keys("rates"))
    kept = F.map_filter("rates", lambda k, v: F.array_contains(wanted, k))
    fine = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("rates are missing: "), F.array_join(missing, ", ")))).otherwise(kept)
    return payload.withColumn("rates", fine)
