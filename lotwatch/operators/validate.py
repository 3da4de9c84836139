"""Rules for listings, quarantine of rows that break them, health of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields of a listing may hold.
STATUSES = ["active", "sold", "withdrawn"]
SIDES = ["LHD", "RHD", "unknown"]
BODIES = ["pass", "fail", "unavailable"]
SOURCES = ["ebay", "bringatrailer", "carsandbids", "hemmings", "goonet_exchange", "carsensor", "yahoo_auctions", "kaidee", "classiccars", "kijiji", "barnfinds", "flex", "kuruma_ex", "mercadolibre", "justcars", "tokyocarz"]


def rules() -> dict[str, Column]:
    """Name of each rule, and what holds if a row keeps it."""
    c = F.col
    needed = ["id", "source", "url", "title", "country", "status", "price"]
    return {
        "required": ~F.greatest(*[c(x).isNull() for x in needed]),
        "id": c("id").rlike("^[a-z_]+:.+$"),
        "source": c("source").isin(SOURCES),
        "status": c("status").isin(STATUSES),
        "body": c("king_cab.body_style_check").isin(BODIES),
        "drive_side": c("drive_side").isin(SIDES),
        "country": c("country").rlike("^[A-Z]{2}$"),
        "currency": c("price.currency").rlike("^[A-Z]{3}$"),
        "year": c("year").isNull() | c("year").between(1971, 1980),
        "snippet": F.length(F.coalesce("description_snippet", F.lit(""))) <= 500,
        "url": c("url").rlike("^[a-z][a-z0-9+.-]*:"),
        "images": F.forall(F.coalesce("images", F.array().cast("array<string>")), lambda x: x.rlike("^[a-z][a-z0-9+.-]*:")),
    }


def violations(checks: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that can't be told counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def split(df: DataFrame, checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with what they break."""
    marked = df.withColumn("violations", violations(checks or rules()))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def require(df: DataFrame, checks: dict[str, Column], what: str) -> DataFrame:
    """df, failing where a row breaks a rule."""
    broken = violations(checks)
    say = F.concat(F.lit(f"{what} breaks "), F.array_join(broken, ", "))
    return df.filter(F.when(F.size(broken) > 0, F.raise_error(say).cast("boolean")).otherwise(True))


def source_counts(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """records and dropped of each source."""
    ok = F.size(violations(checks or rules())) == 0
    return df.groupBy("source").agg(F.count_if(ok).alias("records"), F.count_if(~ok).alias("dropped"))


def seen_sources(counts: DataFrame) -> DataFrame:
    """Sources with a valid row: only they make their listings age."""
    return counts.filter("records > 0").select("source")


def attempts(tries: DataFrame) -> DataFrame:
    """tries(source, failed, raw) to its verdict: failed if all tries did, canary if nothing at all came, warned if some failed.

    raw: what a try brought before any gate; null where that isn't known, as where it failed.
    """
    a = tries.groupBy("source").agg(F.count(F.lit(1)).alias("tries"), F.count_if("failed").alias("failures"), F.sum("raw").alias("raw"))
    verdict = F.when(F.col("failures") == F.col("tries"), "failed").when(F.col("raw") == 0, "canary").when(F.col("failures") > 0, "warned").otherwise("ok")
    return a.select("source", "tries", "failures", "raw", verdict.alias("verdict"))
