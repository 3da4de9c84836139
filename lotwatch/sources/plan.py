"""What a crawler should fetch: markets by queries, and search urls, in the order that settles which of two equal finds counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.functions.normalize import percent_encoded

#: Items of a page at most, asked of the source.
PAGE = 200


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (a few: a plan) with their turn."""
    return rows.withColumn("turn", F.row_number().over(Window.orderBy(*order)) - 1)


def market_plan(markets: DataFrame, queries: DataFrame, limit: int = PAGE) -> DataFrame:
    """turn, market, country, query, limit: every query in every market. Both tables are parameters of a few rows."""
    rows = markets.withColumn("m", F.monotonically_increasing_id()).crossJoin(queries.withColumn("q", F.monotonically_increasing_id()))
    return numbered(rows.withColumn("limit", F.lit(limit)), "m", "q").select("turn", "market", "country", "query", "limit")


def search_plan(spark: SparkSession, searches: list[tuple[str, str, list[str]]]) -> DataFrame:
    """turn, kind, url of searches (kind, template with {}, queries), the queries percent-encoded."""
    rows = spark.createDataFrame([(i, k, t, q) for i, (k, t, q) in enumerate((k, t, q) for k, t, queries in searches for q in queries)], "turn int, kind string, template string, query string")
    return rows.select("turn", "kind", F.replace("template", F.lit("{}"), percent_encoded(F.col("query"))).alias("url"))
