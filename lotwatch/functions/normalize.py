"""Scalar normalisation as Column functions: countries, years, prices, urls, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of countries and their codes, and the side they drive on.
COUNTRY_NAMES = {
    "united states": "US", "usa": "US", "united kingdom": "GB", "uk": "GB",
    "great britain": "GB", "germany": "DE", "deutschland": "DE", "australia": "AU",
    "japan": "JP", "south africa": "ZA", "canada": "CA", "netherlands": "NL",
    "france": "FR", "new zealand": "NZ", "belgium": "BE", "ireland": "IE",
    "thailand": "TH", "ประเทศไทย": "TH", "ไทย": "TH",
    "malaysia": "MY", "indonesia": "ID", "mexico": "MX", "méxico": "MX",
}
RIGHT_HAND = ["GB", "JP", "AU", "NZ", "ZA", "IE", "TH", "MY", "ID"]
LEFT_HAND = ["US", "CA", "DE", "FR", "NL", "BE", "IT", "ES", "SE", "CH", "AT", "MX", "PL"]
# How years and the driver's side are written.
YEAR = r"(?U)\b(19(?:7[0-9]|6[89]|80))\b"
ERA_YEAR = r"(?U)昭和\s*(4[6-9]|5[0-5])年"
RIGHT_TEXT, LEFT_TEXT = r"\brhd\b|right[ -]hand[ -]drive", r"\blhd\b|left[ -]hand[ -]drive"
RIGHT_WORD, LEFT_WORD = "右ハンドル", "左ハンドル"
#: Characters that percent-encoding leaves in a url.
SAFE = ":/?&=%"
BASE = "GBP"


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """A value of a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def country_code(value: Column) -> Column:
    """Two letters as they are (upper case), names by table, else XX."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.rlike("^[A-Za-z]{2}$"), F.upper(v)).otherwise(lookup(F.lower(v), COUNTRY_NAMES, F.lit("XX")))


def drive_side(country: Column, text: Column) -> Column:
    """What the text says outright, else what the country drives on, else unknown."""
    t = F.lower(F.coalesce(text, F.lit("")))
    right = t.rlike(RIGHT_TEXT) | t.contains(RIGHT_WORD)
    left = t.rlike(LEFT_TEXT) | t.contains(LEFT_WORD)
    return F.when(right, "RHD").when(left, "LHD").when(country.isin(RIGHT_HAND), "RHD").when(country.isin(LEFT_HAND), "LHD").otherwise("unknown")


def to_gbp(amount: Column, currency: Column, rate: Column) -> Column:
    """Null without an amount or a rate (0 counts as none), else rounded to pence."""
    return F.when(currency == BASE, F.round(amount, 2)).otherwise(F.round(F.try_divide(amount, F.nullif(rate, F.lit(0.0))), 2))


def price(amount: Column, currency: Column, rate: Column, day: Column) -> Column:
    """The price block with the rate captured on that day."""
    return F.struct(
        amount.cast("double").alias("amount"),
        currency.alias("currency"),
        to_gbp(amount, currency, rate).alias("gbp"),
        F.when(currency == BASE, F.lit(1.0)).otherwise(rate).alias("fx_rate"),
        day.alias("fx_date"),
    )


def safe_url(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise("")


def year_of(title: Column) -> Column:
    """The first year that the text names, if it lies in the model's range."""
    y = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), YEAR, 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(y.between(1971, 1980), y)


def year_of_era(title: Column) -> Column:
    """Like year_of, else by the era's count (46 to 55)."""
    n = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), ERA_YEAR, 1), F.lit("")).try_cast("int")
    return F.coalesce(year_of(title), n + 1925)


def slug_of(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def slug_of_title(title: Column) -> Column:
    """Where there is no url: the title in lower case, spaces as dashes."""
    return F.replace(F.lower(title), F.lit(" "), F.lit("-"))


def absolute(url: Column, base: str) -> Column:
    """url with the scheme or site that it leaves out."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def percent_encoded(text: Column, safe: str = "") -> Column:
    """UTF-8 bytes as %XX but for letters, digits, _ . - ~ and `safe`: a space is %20, unlike in forms."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    for c in sorted(set(safe) - {"%"}):
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.replace(out, F.lit("%25"), F.lit("%")) if "%" in safe else out


def before_labels(text: Column, labels: str) -> Column:
    """What stands before the first of the labels (alternatives of a pattern)."""
    return F.get(F.split(text, labels, 2), F.lit(0))


def host_of(url: Column) -> Column:
    """Host without www."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def region_of(url: Column, pattern: str) -> Column:
    return F.initcap(F.replace(F.regexp_extract(url, pattern, 1), F.lit("-"), F.lit(" ")))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def number_after(text: Column, pattern: str) -> Column:
    """Group 1 of a pattern as a number, thousands marks dropped."""
    return F.nullif(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def dollars(text: Column) -> Column:
    return number_after(text, r"\$\s?([0-9][0-9,]*)")


def yen(text: Column) -> Column:
    return number_after(text, r"[¥￥]\s?([0-9][0-9,]*)")


def ten_thousands_of_yen(text: Column) -> Column:
    return F.round(number_after(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*万円") * 10000, 0)


def from_cents(cents: Column) -> Column:
    return F.round(cents / 100, 2)


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def needs_translation(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\u3040-\\u30FF\\u3400-\\u9FFF]")


def to_tenth(c: Column) -> Column:
    """Rounded half up to a tenth by the binary value, as SQL engines round doubles; F.round goes by the decimal text."""
    return F.round(c * 10) / 10
