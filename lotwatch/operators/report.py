"""Frames of the digest, its lines as rows, and a page of bounded length of them."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.display import change, clock, money, page_name, pounds, shown_title, site_money

#: Lines of a section that a page shows; how many there are in all is said above them.
PAGE = 500


def new_listings(new: DataFrame, relists: DataFrame, listings: DataFrame) -> DataFrame:
    """New ones but for possible relists (shown apart), matches of the keyword first, else in order."""
    rows = new.join(relists.select("id"), "id", "left_anti").join(listings, "id")
    price = money(F.col("price.amount"), F.col("price.currency"), F.col("price.gbp"))
    return rows.select("id", shown_title(F.col("title"), F.col("title_translated")).alias("title"), price.alias("price"), F.col("king_cab.matched").alias("matched"), "ordinal").orderBy(F.desc("matched"), "ordinal")


def price_changes(changed: DataFrame, listings: DataFrame) -> DataFrame:
    rows = changed.join(listings.select("id", "title", "title_translated"), "id")
    text = F.concat_ws(" ", pounds(F.col("old_gbp")), F.lit("→"), pounds(F.col("new_gbp")), change(F.col("pct")))
    return rows.select("id", shown_title(F.col("title"), F.col("title_translated")).alias("title"), text.alias("change"))


def relist_lines(relists: DataFrame, listings: DataFrame) -> DataFrame:
    prior = listings.select(F.col("id").alias("prior_id"), F.col("title").alias("prior_title"))
    return relists.join(listings.select("id", "title"), "id").join(prior, "prior_id", "left").select("id", "title", "prior_id", "prior_title", F.array_join("reasons", "; ").alias("reasons"))


def status_changes(changed: DataFrame, listings: DataFrame) -> DataFrame:
    return changed.join(listings.select("id", "title"), "id").select("id", "title", "old_status", "new_status")


def digest_subject(name: str, counts: DataFrame, day: str) -> str:
    """The subject of a day's mail, by what the digest has (counts, one row): keyword matches lead, then new ones and price changes."""
    c = counts.first()
    if c["matched"]:
        return f"{name}: {c['matched']} KING CAB of {c['new']} new, {c['price changes']} price change(s) — {day}"
    if c["new"] or c["price changes"]:
        return f"{name}: {c['new']} new, {c['price changes']} price change(s) — {day}"
    return f"{name} digest — {day}"


def subject(counts: dict[str, int], day: str) -> str:
    said = [f"{n} {name}" for name, n in counts.items() if n]
    return f"Listings {day}: {', '.join(said) if said else 'no changes'}"


def counts(new: DataFrame, price_changed: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: matches of the keyword among new listings, new ones and price changes, for the subject."""
    matched = new.select("id").join(listings.select("id", F.col("king_cab.matched").alias("m")), "id", "left").agg(F.count_if("m").alias("matched"), F.count(F.lit(1)).alias("new"))
    return matched.join(F.broadcast(price_changed.agg(F.count(F.lit(1)).alias("price changes"))))  # a row each


def health_lines(log: DataFrame) -> DataFrame:
    """source and a line of each source: its listings, or why it was skipped, for how long, and from 7 days on that it must be decided on."""
    days = F.col("consecutive_failures")
    failed = F.concat_ws("", "source", F.lit(": skipped — "), "note", F.when(days > 1, F.format_string(" (%d days running)", days)), F.when(days >= 7, F.format_string("; blocked %d days: decision needed", days)))
    return log.select("source", F.when(F.col("ok"), F.format_string("%s: %d listing(s)", "source", "records")).otherwise(failed).alias("line"))


def summary_lines(totals: DataFrame, started_at: str = "") -> DataFrame:
    """One row: active listings, by country in order, the median price, and when the run began."""
    by = F.array_join(F.transform(F.array_sort(F.map_entries("by_country")), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    median = F.when(F.col("median_gbp").isNull(), "n/a").otherwise(pounds(F.col("median_gbp")))
    began = clock(F.lit(started_at))
    line = F.concat_ws(" · ", F.format_string("Active listings: %d", "active"), F.concat(F.lit("By country: "), F.when(by == "", "none").otherwise(by)), F.concat(F.lit("Median price: "), median), F.when(began != "", F.concat(F.lit("Run started: "), began, F.lit(" UTC"))))
    return totals.select(line.alias("line"))


def escaped(text: Column) -> Column:
    for c in "&<>\"'":
        text = F.replace(text, F.lit(c), F.lit(html.escape(c)))
    return text


def lines(sections: dict[str, DataFrame], most: int = PAGE) -> DataFrame:
    """k (the section's number), section, place and html of the first `most` rows of each section; no task keeps more than these."""

    def part(k: int, name: str, frame: DataFrame) -> DataFrame:
        text = F.concat_ws(" · ", *[F.col(c).cast("string") for c in frame.columns if c not in ("ordinal", "matched")])
        order = [F.desc(c) for c in ("matched",) if c in frame.columns] + [F.col("ordinal" if "ordinal" in frame.columns else frame.columns[0])]
        first = frame.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order)))
        return first.select(F.lit(k).alias("k"), F.lit(name).alias("section"), "place", F.concat(F.lit("<li>"), escaped(text), F.lit("</li>")).alias("html"))

    return reduce(DataFrame.unionByName, [part(k, n, f) for k, (n, f) in enumerate(sections.items())])


def render(sections: dict[str, DataFrame], day: str, most: int = PAGE) -> str:
    """HTML of the sections that have rows: how many, and the first `most` of each."""
    sizes = reduce(DataFrame.unionByName, [f.agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(s)) for s, f in sections.items()])
    total = {r["section"]: r["n"] for r in sizes.collect()}
    shown = lines(sections, most).orderBy("k", "place").collect()  # a page
    out = [f"<h1>Listings {html.escape(day)}</h1>"]
    for name in sections:
        rows = [r["html"] for r in shown if r["section"] == name]
        if rows:
            more = f"<p>and {total[name] - len(rows)} more</p>" if total[name] > len(rows) else ""
            out.append(f"<h2>{html.escape(name)} ({total[name]})</h2><ul>{''.join(rows)}</ul>{more}")
    return "\n".join(out if len(out) > 1 else [*out, "<p>Nothing new.</p>"])


def listing_pages(listings: DataFrame) -> DataFrame:
    """page, id and what a listing's own page shows: title, price, place, the listing before it (if it is still known), its history and the dates and amounts that a chart needs two of."""
    prior = listings.select(F.col("id").alias("_prior"), F.col("title").alias("prior_title"), F.col("url").alias("prior_url"))
    rows = listings.withColumn("_prior", F.when(F.col("relist.possible"), F.col("relist.prior_id"))).join(prior, "_prior", "left")
    priced = F.filter("history", lambda h: h["price"]["gbp"].isNotNull())
    last = F.size("history") - 1
    label = lambda h, i: F.concat_ws(" · ", h["date"].cast("string"), h["status"], site_money(h["price"]["amount"], h["price"]["currency"], h["price"]["gbp"]), F.when(i == 0, "first seen").when(i == last, "latest"))
    return rows.select(
        page_name(F.col("id")).alias("page"),
        "id",
        shown_title(F.col("title"), F.col("title_translated")).alias("title"),
        site_money(F.col("price.amount"), F.col("price.currency"), F.col("price.gbp")).alias("price"),
        F.concat_ws(", ", "region", "country").alias("place"),
        F.when(F.col("prior_title").isNotNull(), page_name(F.col("_prior"))).alias("prior_page"),
        "prior_title",
        F.transform("history", label).alias("history"),
        F.when(F.size(priced) >= 2, F.transform(priced, lambda h: F.struct(h["date"].alias("date"), h["price"]["gbp"].alias("gbp")))).alias("chart"),
    )
