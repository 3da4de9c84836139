"""Browsing listings: filters, order, facets, comparison, histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.operators.files import cut


def matches(country=None, matched=None, drive=None, source=None, year_min=None, year_max=None, price_max=None) -> Column:
    """Optional conditions; an unknown year or price (0 counts as one) fails only a bound that is set, and 0 is a bound."""
    gbp, year = F.nullif(F.col("gbp"), F.lit(0.0)), F.nullif(F.col("year"), F.lit(0))
    conditions = [F.lit(True)]
    for name, value in (("country", country), ("matched", matched), ("drive_side", drive), ("source", source)):
        if value is not None:
            conditions.append(F.col(name) == value)
    if year_min is not None or year_max is not None:
        conditions.append(F.coalesce(year.between(year_min or 0, year_max or 9999), F.lit(False)))
    if price_max is not None:
        conditions.append(F.coalesce(gbp <= price_max, F.lit(False)))
    return reduce(lambda a, b: a & b, conditions)


def browse(listings: DataFrame, sort: str = "newest", first: int | None = None, **conditions) -> DataFrame:
    """Listings that match, with their section (active or ended) and place in it; unknown prices come last either way.

    first: only so many places of each section, as a page shows them; each task
    then keeps no more than these before they meet.  Without it all rows get a
    place: the rows are cut into ranges of their order, whose sizes say where
    each begins, so that no section is one task's.
    """
    section = F.when(F.col("status") == "active", "active").otherwise("ended")
    day = F.when(F.col("status") == "active", F.col("first_seen")).otherwise(F.col("last_seen"))
    rows = listings.filter(matches(**conditions)).withColumns({"section": section, "_day": day})
    gbp = F.nullif(F.col("gbp"), F.lit(0.0))
    order = [*{"price-asc": [gbp.asc_nulls_last()], "price-desc": [gbp.desc_nulls_last()]}.get(sort, []), F.desc("_day"), F.asc("id")]
    if first is not None:
        w = Window.partitionBy("section").orderBy(*order)
        return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first).drop("_day")
    spans = rows.repartitionByRange(F.asc("section"), *order).withColumn("_span", F.spark_partition_id())
    spans = cut(spans)  # a range's number must not change between its count and its use
    sizes = spans.groupBy("section", "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("section").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("section", "_span").orderBy(*order))
    out = spans.join(before.drop("_n"), ["section", "_span"]).withColumn("place", (F.col("_before") + place).cast("int"))
    return out.drop("_day", "_span", "_before")


def facets(listings: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column in one pass: facet, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return listings.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()


def compare(variants: DataFrame, key: str, left, right, columns: list[str], unknown: str = "—") -> DataFrame:
    """Two rows side by side, a row for each column; they differ if unequal and both known."""
    text = variants.filter(F.col(key).isin([left, right])).select(key, *[F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias(c) for c in columns])
    long = text.unpivot([key], columns, "field", "value")
    side = lambda k, name: F.max(F.when(F.col(key) == k, F.col("value"))).alias(name)
    out = long.groupBy("field").agg(side(left, "a"), side(right, "b"))
    return out.withColumn("differs", (F.col("a") != F.col("b")) & (F.col("a") != unknown) & (F.col("b") != unknown))


def sections(listings: DataFrame, by: str, shown: Column) -> DataFrame:
    """Shown, of how many, and whether the section is visible."""
    return listings.groupBy(by).agg(F.count_if(shown).alias("shown"), F.count(F.lit(1)).alias("total"), F.bool_or(shown).alias("visible"))


def history_points(observations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Observations with marks of the first and last of each key."""
    w = Window.partitionBy(key)
    up, down = w.orderBy(*order), w.orderBy(*[F.desc(c) for c in order])
    return observations.withColumns({"is_first": F.row_number().over(up) == 1, "is_last": F.row_number().over(down) == 1})


def priced_points(observations: DataFrame, key: str, at: str, value: str, least: int = 2) -> DataFrame:
    """low, high, since, until and number of observations of each key with `least` values or more."""
    g = observations.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.min(at).alias("since"), F.max(at).alias("until"), F.count(F.lit(1)).alias("n"), F.count(value).alias("_valued"))
    return g.filter(F.col("_valued") >= least).drop("_valued")


def with_label(df: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    """df with the label of labels(column, label) for a column's value, else the value itself. Spark broadcasts labels if they are small."""
    return df.join(labels.select(column, F.col("label").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.col(column).cast("string")))


def listed(df: DataFrame, by: str, name: str, text: Column, mark: str = "; ") -> DataFrame:
    """by, line: the texts of each group, in order of `name`, in one line."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(name).alias("k"), text.alias("t"))))
    return df.groupBy(by).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), mark).alias("line"))


def scaled(points: DataFrame, key: str, x: str, y: str, width: float = 600.0, height: float = 200.0, pad: float = 0.15) -> DataFrame:
    """Points of a chart: x over the width, y (padded) upwards over the height; keys with one point are left out."""
    w = Window.partitionBy(key)
    low, high = F.min(y).over(w), F.max(y).over(w)
    room = F.when(high > low, (high - low) * pad).otherwise(F.lit(1.0))
    at = points.withColumns({"_low": low - room, "_high": high + room, "_x0": F.min(x).over(w), "_x1": F.max(x).over(w), "_n": F.count(y).over(w)}).filter("_n >= 2")
    return at.select(key, x, y, F.coalesce(F.try_divide(F.col(x) - F.col("_x0"), F.col("_x1") - F.col("_x0")) * width, F.lit(0.0)).alias("px"), (height - (F.col(y) - F.col("_low")) / (F.col("_high") - F.col("_low")) * height).alias("py"))
