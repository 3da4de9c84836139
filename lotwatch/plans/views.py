"""Listings and observations as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.functions.normalize import to_gbp
from lotwatch.operators.fx import convert
from lotwatch.schemas import KEYWORDS, PRICE
from lotwatch.sources.legacy import FLAT

RATES = [("GBP", 1.0), ("USD", 1.25), ("EUR", 1.15), ("JPY", 187.3), ("THB", 45.0)]
CURRENCIES = [c for c, _ in RATES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "currency string, rate double")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings: id, source, country, status, amount, currency, rate, gbp, first_seen, year."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "sold").otherwise("withdrawn")
    rows = rows.select(
        F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("source"),
        F.col("n_name").alias("country"),
        status.alias("status"),
        F.col("o_totalprice").alias("amount"),
        F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("c_nationkey") % 5 + 1).cast("int")).alias("currency"),
        F.to_date("o_orderdate").alias("first_seen"),
        (F.col("o_orderkey") % 15 + 1968).cast("int").alias("year"),
    )
    rows = convert(rows, rates(spark))
    return rows.withColumn("gbp", to_gbp(F.col("amount"), F.col("currency"), F.col("rate")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: id, day, source, amount, status, ordinal."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("source"),
        F.col("value").alias("amount"),
        F.when(F.col("value") > 50, "active").otherwise("sold").alias("status"),
        F.col("event_id").alias("ordinal"),
    )


def priced(rows: DataFrame) -> DataFrame:
    """Listings with their price as the store has it."""
    return rows.withColumn("price", F.struct(F.col("amount"), F.col("currency"), F.col("gbp"), F.col("rate").alias("fx_rate"), F.col("first_seen").alias("fx_date")).cast(PRICE))


def arriving(obs: DataFrame) -> DataFrame:
    """Observations as INCOMING rows with day and ordinal; amounts in pounds."""
    name = F.col("id").cast("string")
    null = F.lit(None).cast("string")
    price = F.struct(F.col("amount"), F.lit("GBP").alias("currency"), F.col("amount").alias("gbp"), F.lit(1.0).alias("fx_rate"), F.col("day").alias("fx_date")).cast(PRICE)
    given = {
        "id": name, "source": F.col("source"), "source_listing_id": name, "url": F.lit("https://x.example/"), "title": F.concat(F.lit("obs "), name), "title_translated": null, "description_snippet": null, "region": null,
        "year": F.lit(None).cast("int"), "country": F.lit("XX"), "drive_side": F.lit("unknown"), "king_cab": F.lit(None).cast(KEYWORDS), "price": price, "images": F.array().cast("array<string>"), "status": F.col("status"),
    }
    return obs.select(*[c.alias(k) for k, c in given.items()], F.col("ordinal").cast("long").alias("ordinal"), "day")


def parts_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings in turn: the brand is the source, the type the title, the size the country; large ones are sold."""
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") > 25, "sold").otherwise("active")
    return p.select(F.concat(F.lit("ebay:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("source"), F.col("p_type").alias("title"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("country"), F.struct(F.col("p_retailprice").alias("amount")).alias("price"), F.col("p_partkey").cast("long").alias("ordinal"), F.lit(None).cast("date").alias("first_seen"), status.alias("status"))


def flat_listings(rows: DataFrame) -> DataFrame:
    """Listings in the flat schema of before, each with one price in its history."""
    entry = F.struct(F.col("first_seen").alias("date"), F.col("amount").alias("price_original"), F.col("gbp").alias("price_gbp"))
    given = {
        "id": F.concat(F.lit("old_site-"), F.substring("id", 5, 20)), "source": F.lit("old_site"), "source_url": F.lit("https://x.example/"), "title": F.lit("t"), "price_original": F.col("amount"), "currency": F.col("currency"),
        "price_gbp": F.col("gbp"), "fx_rate_used": F.col("rate"), "fx_date": F.col("first_seen"), "country": F.initcap("country"), "first_seen": F.col("first_seen"), "last_seen": F.col("first_seen"), "year": F.col("year"),
        "price_history": F.array(entry), "status": F.col("status"),
    }
    kinds = rows.sparkSession.createDataFrame([], FLAT).schema
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


LISTINGS_SQL = """listings AS (
  SELECT 'ord:' || o_orderkey AS id, o_orderpriority AS source, n_name AS country,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'sold' ELSE 'withdrawn' END AS status,
    o_totalprice AS amount, r.currency, r.rate, round(o_totalprice / r.rate, 2) AS gbp,
    CAST(o_orderdate AS DATE) AS first_seen, CAST(o_orderkey % 15 + 1968 AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN (VALUES (0, 'GBP', CAST(1 AS DOUBLE)), (1, 'USD', CAST(1.25 AS DOUBLE)), (2, 'EUR', CAST(1.15 AS DOUBLE)), (3, 'JPY', CAST(187.3 AS DOUBLE)), (4, 'THB', CAST(45 AS DOUBLE))) r(k, currency, rate)
    ON c_nationkey % 5 = r.k)"""
OBS_SQL = """obs AS (
  SELECT user_id AS id, CAST(ts AS DATE) AS day, event_type AS source, value AS amount,
    CASE WHEN value > 50 THEN 'active' ELSE 'sold' END AS status, event_id AS ordinal FROM events)"""
