"""Variants of a model: flattened from their markets, filtered, and shown side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.display import body_type, engine_codes, engine_line

SPECS = (
    "version string, markets array<struct<market:string,name:string,variants:array<struct<id:string,name:string,years:struct<`from`:int,`to`:int>,body:string,"
    "engine:struct<code:string,codes:array<string>,displacement_cc:int,power_hp:double>,dimensions_mm:struct<length:int,width:int,height:int,wheelbase:int,bed_length:int>,"
    "weight_kg:double,transmission:string,colors:array<struct<name:string,hex:string>>,confidence:string>>>>"
)
UNKNOWN = "—"
#: Columns of a comparison, in order.
ROWS = ("years", "body", "engine", "power", "length", "width", "height", "wheelbase", "bed", "weight", "transmission", "colours", "confidence")


def variants(specs: DataFrame) -> DataFrame:
    """A row for each variant: its market (code and name), and what filters and pages derive from it."""
    markets = specs.select(F.explode("markets").alias("m")).select(F.col("m.market").alias("market"), F.col("m.name").alias("market_name"), F.explode("m.variants").alias("v"))
    rows = markets.select("market", "market_name", "v.*")
    e = lambda f: F.col(f"engine.{f}")
    return rows.withColumns(
        {
            "body_type": body_type(F.col("name"), F.col("body")),
            "engines": engine_codes(e("codes"), e("code")),
            "engine_line": engine_line(e("code"), e("displacement_cc"), e("power_hp")),
            "colour_names": F.coalesce(F.transform("colors", lambda c: c["name"]), F.array().cast("array<string>")),
        }
    )


def matches(region: str | None = None, body: str | None = None, year: int | None = None, engine: str | None = None, colour: str | None = None) -> Column:
    """Optional conditions on variants(): a year lies within the variant's, an engine and a colour are among its own."""
    conditions = [F.lit(True)]
    if region:
        conditions.append(F.col("market") == region)
    if body:
        conditions.append(F.col("body_type") == body)
    if year:
        conditions.append(F.lit(year).between(F.col("years.from"), F.col("years.to")))
    if engine:
        conditions.append(F.array_contains("engines", engine))
    if colour:
        conditions.append(F.array_contains("colour_names", colour))
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def facets(rows: DataFrame) -> DataFrame:
    """facet, value: distinct body types, engines and colours."""
    pairs = F.concat(
        F.array(F.struct(F.lit("body").alias("facet"), F.col("body_type").alias("value"))),
        F.transform("engines", lambda x: F.struct(F.lit("engine").alias("facet"), x.alias("value"))),
        F.transform("colour_names", lambda x: F.struct(F.lit("colour").alias("facet"), x.alias("value"))),
    )
    return rows.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def shown(rows: DataFrame) -> DataFrame:
    """id, name, market_name and the ROWS of a comparison as text, what isn't known as a dash."""
    e, d = (lambda f: F.col(f"engine.{f}")), (lambda f: F.col(f"dimensions_mm.{f}"))
    whole = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    unit = lambda c, u: F.when(c != 0, F.concat(whole(c), F.lit(f" {u}")))
    litres = F.when(e("displacement_cc") != 0, F.concat(F.lit(", "), F.format_number(e("displacement_cc") / 1000, 1), F.lit("L")))
    engine = F.when(F.nullif(e("code"), F.lit("")).isNotNull(), F.concat(e("code"), F.coalesce(litres, F.lit("")))).otherwise("not verified")
    n = F.size("colour_names")
    text = {
        "years": F.concat_ws("–", F.col("years.from").cast("string"), F.col("years.to").cast("string")),
        "body": F.col("body"),
        "engine": engine,
        "power": unit(e("power_hp"), "hp"),
        **{k: unit(d(f), "mm") for k, f in (("length", "length"), ("width", "width"), ("height", "height"), ("wheelbase", "wheelbase"), ("bed", "bed_length"))},
        "weight": unit(F.col("weight_kg"), "kg"),
        "transmission": F.col("transmission"),
        "colours": F.when(n > 0, F.concat(n.cast("string"), F.lit(" documented"))),
        "confidence": F.col("confidence"),
    }
    return rows.select("id", "name", "market_name", *[F.coalesce(text[k], F.lit(UNKNOWN)).alias(k) for k in ROWS])
