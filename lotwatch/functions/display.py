"""Text for reports and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions.normalize import lookup

# Currency signs, and those that pages know besides.
SIGNS = {"GBP": "£", "USD": "$", "EUR": "€", "JPY": "¥", "AUD": "A$", "CAD": "C$", "THB": "฿"}
SITE_SIGNS = {"ZAR": "R", "MXN": "MX$"}


def money(amount: Column, currency: Column, gbp: Column) -> Column:
    """Sign and whole units, and pounds beside a foreign price."""
    text = F.concat(lookup(currency, SIGNS, F.concat(currency, F.lit(" "))), F.format_number(amount, 0))
    extra = F.when((currency != "GBP") & gbp.isNotNull(), F.concat(F.lit(" (£"), F.format_number(gbp, 0), F.lit(")"))).otherwise("")
    return F.when(amount.isNull(), "no price shown").otherwise(F.concat(text, extra))


def pounds(gbp: Column) -> Column:
    return F.when(gbp.isNull(), "?").otherwise(F.concat(F.lit("£"), F.format_number(gbp, 0)))


def change(pct: Column) -> Column:
    """Arrow and whole percent; without a percentage only the rising arrow."""
    arrow = F.when(pct < 0, "▼").otherwise("▲")
    return F.concat(arrow, F.coalesce(F.concat(F.lit(" "), F.format_number(F.abs(pct), 0), F.lit("%")), F.lit("")))


def shown_title(title: Column, translated: Column) -> Column:
    return F.coalesce(F.nullif(translated, F.lit("")), title)


def page_name(listing_id: Column) -> Column:
    return F.replace(listing_id, F.lit(":"), F.lit("--"))


def site_money(amount: Column, currency: Column, gbp: Column) -> Column:
    """As a page shows it: sign, up to three decimals, and pounds behind a dot beside a foreign price."""
    number = F.regexp_replace(F.format_number(amount, 3), r"\.?0+$", "")
    text = F.concat(lookup(currency, SIGNS | SITE_SIGNS, F.concat(currency, F.lit(" "))), number)
    pence = F.floor(gbp + 0.5)
    extra = F.when((currency != "GBP") & gbp.isNotNull(), F.concat(F.lit(" · £"), F.format_number(pence, 0))).otherwise("")
    return F.when(amount.isNull(), "no price shown").otherwise(F.concat(text, extra))


def clock(timestamp: Column) -> Column:
    """HH:mm of an ISO timestamp's text; empty where it is too short."""
    return F.when(F.length(timestamp) >= 16, F.substring(timestamp, 12, 5)).otherwise("")


def body_type(name: Column, body: Column) -> Column:
    """Body style from a variant's name and body: parentheses dropped, the first keyword counts."""
    v = F.lower(F.regexp_replace(F.concat_ws(" ", name, F.coalesce(body, F.lit(""))), r"\(.*?\)", ""))
    out = F.lit("Standard cab")
    for said, pattern in reversed([("King Cab", "king|extended"), ("Double cab", "double"), ("Ute", "ute|tray|utility"), ("Long bed", "long[ -]?(bed|body)")]):
        out = F.when(v.rlike(pattern), said).otherwise(out)
    return out


def engine_codes(codes: Column, code: Column) -> Column:
    """The curated list, else the headline code alone, else none."""
    return F.coalesce(codes, F.array_compact(F.array(F.nullif(code, F.lit("")))))


def engine_line(code: Column, displacement_cc: Column, power_hp: Column) -> Column:
    """Code, litres and power; null without a code."""
    litres = F.when(displacement_cc > 0, F.concat(F.format_number(displacement_cc / 1000, 1), F.lit("L")))
    power = F.when(power_hp > 0, F.concat(F.regexp_replace(power_hp.cast("string"), r"\.0$", ""), F.lit(" hp")))
    return F.when(F.nullif(code, F.lit("")).isNotNull(), F.concat_ws(", ", code, litres, power))
