"""Queries over the driver's tables, one or more for each kind of operator, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.functions import classify, display, normalize
from lotwatch import contracts
from lotwatch.operators import browse, fx, history, intervals, quantiles, relist, report, runlog, sets, validate
from lotwatch.operators.contracts import judged
from lotwatch.operators.files import cut
from lotwatch.operators.reconcile import reconcile
from lotwatch.plans.views import CURRENCIES, LISTINGS_SQL, OBS_SQL, arriving, flat_listings, listings, observations, parts_listed, priced, table
from lotwatch.schemas import LISTING
from lotwatch.sources import legacy, plan
from lotwatch.sources.html import elements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
L, O = f"WITH {LISTINGS_SQL} ", f"WITH {OBS_SQL} "
DAY = "2024-01-15"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Totals and conversion


@query(L + "SELECT count(*) AS active, CAST(round(median(gbp), 2) AS DOUBLE) AS median_gbp, count(DISTINCT country) AS countries FROM listings WHERE status = 'active'")
def summary_totals(spark, sf_dir):
    return runlog.totals(priced(listings(spark, sf_dir))).select("active", "median_gbp", F.size("by_country").cast("bigint").alias("countries"))


@query(L + "SELECT country, count(*) AS n FROM listings WHERE status = 'active' GROUP BY country")
def active_by_country(spark, sf_dir):
    return runlog.totals(priced(listings(spark, sf_dir))).select(F.explode("by_country").alias("country", "n"))


@query(L + "SELECT id, amount, currency, gbp, rate AS fx_rate FROM listings")
def fx_convert(spark, sf_dir):
    rows = listings(spark, sf_dir)
    p = normalize.price(F.col("amount"), F.col("currency"), F.col("rate"), F.col("first_seen"))
    return rows.select("id", p.alias("p")).select("id", "p.amount", "p.currency", "p.gbp", "p.fx_rate")


@query("""WITH e AS (SELECT event_id, event_type AS ccy, CAST(ts AS DATE) AS day, value FROM events),
 r AS (SELECT ccy, day, round(avg(value), 6) AS rate FROM e WHERE value > 95 GROUP BY ALL)
 SELECT event_id, e.ccy, CAST(e.day AS VARCHAR) AS day, rate FROM e ASOF LEFT JOIN r ON e.ccy = r.ccy AND e.day >= r.day""")
def fx_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ccy"), F.to_date("ts").alias("day"), "value")
    daily = e.filter("value > 95").groupBy("ccy", "day").agg(F.round(F.avg("value"), 6).alias("rate"))  # days without such an event have none
    return fx.as_of(e.drop("value"), daily, "ccy", "day", "rate").select("event_id", "ccy", F.col("day").cast("string").alias("day"), "rate")


@query(f"""WITH d AS (SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS rate FROM events GROUP BY 1),
 m AS (SELECT date, rate FROM d WHERE date <> DATE '{DAY}' UNION ALL SELECT DATE '{DAY}', CAST(1.5 AS DOUBLE))
 SELECT CAST(date AS VARCHAR) AS date, rate, date = (SELECT max(date) FROM m) AS is_latest FROM m""")
def fx_upsert_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("rate"))
    new = spark.createDataFrame([(DAY, 1.5)], "date string, rate double").withColumn("date", F.col("date").cast("date"))
    merged = fx.upsert(log, new)
    return merged.join(fx.latest(merged).select("date", F.lit(True).alias("is_latest")), "date", "left").select(F.col("date").cast("string").alias("date"), "rate", F.coalesce("is_latest", F.lit(False)).alias("is_latest"))


# Scalars and predicates


@query("""SELECT n_nationkey, v, CASE WHEN v IS NULL OR trim(v) = '' THEN 'XX' WHEN regexp_full_match(trim(v), '[A-Za-z]{2}') THEN upper(trim(v))
 WHEN lower(trim(v)) = 'japan' THEN 'JP' WHEN lower(trim(v)) = 'united states' THEN 'US' WHEN lower(trim(v)) = 'méxico' THEN 'MX' ELSE 'XX' END AS code
 FROM (SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'uk' WHEN 1 THEN ' Japan ' WHEN 2 THEN 'United States' WHEN 3 THEN NULL WHEN 4 THEN 'MÉXICO' WHEN 5 THEN '' ELSE n_name END AS v FROM nation)""")
def country_code_norm(spark, sf_dir):
    k = F.col("n_nationkey") % 7
    v = F.when(k == 0, "uk").when(k == 1, " Japan ").when(k == 2, "United States").when(k == 3, None).when(k == 4, "MÉXICO").when(k == 5, "").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", v.alias("v"), normalize.country_code(v).alias("code"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(t), '\brhd\b|right[ -]hand[ -]drive') THEN 'RHD' WHEN regexp_matches(lower(t), '\blhd\b|left[ -]hand[ -]drive') THEN 'LHD'
 WHEN c IN ('GB','JP','AU','NZ','ZA','IE','TH','MY','ID') THEN 'RHD' WHEN c IN ('US','CA','DE','FR','NL','BE','IT','ES','SE','CH','AT','MX','PL') THEN 'LHD' ELSE 'unknown' END AS side
 FROM (SELECT doc_id, upper(lang) AS c, CASE doc_id % 4 WHEN 0 THEN 'A RHD truck ' WHEN 1 THEN 'left-hand drive ' ELSE '' END || text AS t FROM documents)""")
def drive_side(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.concat(F.when(k == 0, "A RHD truck ").when(k == 1, "left-hand drive ").otherwise(""), "text")  # in front of a whole text
    return table(spark, sf_dir, "documents").select("doc_id", normalize.drive_side(F.upper("lang"), t).alias("side"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '\brhd\b|right[ -]hand[ -]drive') THEN 'RHD' WHEN regexp_matches(t, '\blhd\b|left[ -]hand[ -]drive') THEN 'LHD'
 WHEN c IN ('GB','JP','AU','NZ','ZA','IE','TH','MY','ID') THEN 'RHD' WHEN c IN ('US','CA','DE','FR','NL','BE','IT','ES','SE','CH','AT','MX','PL') THEN 'LHD' ELSE 'unknown' END AS side
 FROM (SELECT doc_id, upper(lang) AS c, lower(text || CASE doc_id % 4 WHEN 0 THEN ' a RHD truck' WHEN 1 THEN ' left-hand drive' ELSE '' END) AS t FROM documents)""")
def drive_side_text(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k == 0, " a RHD truck").when(k == 1, " left-hand drive").otherwise(""))  # past the end of a whole text
    return table(spark, sf_dir, "documents").select("doc_id", normalize.drive_side(F.upper("lang"), t).alias("side"))


@query(r"""SELECT o_orderkey, CAST(CASE WHEN y BETWEEN 1971 AND 1980 THEN y ELSE 0 END AS INTEGER) AS year FROM (
 SELECT o_orderkey, TRY_CAST(nullif(regexp_extract('truck ' || (1960 + o_orderkey % 30) || ' x ' || (1970 + o_orderkey % 12), '\b(19(?:7[0-9]|6[89]|80))\b', 1), '') AS INTEGER) AS y FROM orders)""")
def year_extract(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.concat(F.lit("truck "), (1960 + k % 30).cast("string"), F.lit(" x "), (1970 + k % 12).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(normalize.year_of(title), F.lit(0)).alias("year"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 14 + 44 BETWEEN 46 AND 55 THEN 1925 + o_orderkey % 14 + 44 ELSE 0 END AS INTEGER) AS year FROM orders")
def year_extract_era(spark, sf_dir):
    title = F.concat(F.lit("昭和 "), (F.col("o_orderkey") % 14 + 44).cast("string"), F.lit("年 トラック"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(normalize.year_of_era(title), F.lit(0)).alias("year"))


_PART = "SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, lower(p_brand) AS b, p_name, p_type FROM part"


@query(f"""SELECT p_partkey, array_to_string(list_filter(['a', 'e b', 'large', 'zz'], lambda w: contains(t, w)), '|') AS terms,
 len(list_filter(['a', 'e b', 'large', 'zz'], lambda w: contains(t, w))) > 0 AND NOT (NOT contains(b, '1') AND contains(b, '2')) AS matched,
 CASE WHEN contains(b, '1') THEN 'pass' WHEN contains(b, '2') THEN 'fail' ELSE 'unavailable' END AS body FROM ({_PART})""")
def keyword_classify(spark, sf_dir):
    k = classify.keywords(F.col("p_name"), F.col("p_type"), F.col("p_brand"), ["a", "e b", "large", "zz"], ["1"], ["2"])
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("k")).select("p_partkey", F.array_join("k.matched_terms", "|").alias("terms"), "k.matched", F.col("k.body_style_check").alias("body"))


@query("SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'licen') OR contains(lower(text), '@') OR contains(lower(text), 'toy') OR regexp_matches(text, '(?i)\\bads?\\b|\\badvert\\b'))")
def deny_list_filter(spark, sf_dir):
    bad = classify.any_of(F.col("text"), ["licen", "@", "toy"]) | F.col("text").rlike(classify.AD_WORD)
    return table(spark, sf_dir, "documents").filter(~bad).select("doc_id")


@query(r"""SELECT page_id, regexp_matches(t, '\b620\b') AS whole, regexp_matches(t, '(^|[^0-9A-Za-z])620([^0-9]|$)') AS alone, regexp_matches(t, '(?i)(^|[^0-9])(520|521|720)([^0-9]|$)|D2[12]') AS other
 FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN ' 620' WHEN 1 THEN ' S620x' WHEN 2 THEN ' 1620 720' WHEN 3 THEN ' d21' ELSE ' 2520' END AS t FROM pages)""")
def number_boundary_filter(spark, sf_dir):
    k = F.col("page_id") % 5
    t = F.concat("url", F.when(k == 0, " 620").when(k == 1, " S620x").when(k == 2, " 1620 720").when(k == 3, " d21").otherwise(" 2520"))
    return table(spark, sf_dir, "pages").select("page_id", classify.whole_number(t).alias("whole"), classify.number_alone(t).alias("alone"), classify.other_generation(t).alias("other"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_totalprice < 50000)")
def price_floor_filter(spark, sf_dir):
    options = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("FIXED_PRICE"))).otherwise(F.array(F.lit("FIXED_PRICE"), F.lit("AUCTION")))
    return table(spark, sf_dir, "orders").filter(~classify.below_floor(F.col("o_totalprice"), options, 50000)).select("o_orderkey")


@query(L + """, y AS (SELECT id, CASE WHEN year < 1970 THEN NULL ELSE year END AS year FROM listings)
 SELECT id, coalesce(year BETWEEN 1971 AND 1980, false) AS reject_unknown, coalesce(year BETWEEN 1971 AND 1980, true) AS accept_unknown FROM y""")
def era_gate_null_policies(spark, sf_dir):
    y = F.when(F.col("year") >= 1970, F.col("year"))
    return listings(spark, sf_dir).select("id", classify.in_era(y, False).alias("reject_unknown"), classify.in_era(y, True).alias("accept_unknown"))


@query(r"""SELECT page_id, regexp_replace(url, '^.*/', '') AS raw_slug, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS slug, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS host,
 CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS safe FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), u)).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "^.*/", "").alias("raw_slug"), normalize.slug_of(u).alias("slug"), normalize.host_of(u).alias("host"), normalize.safe_url(given).alias("safe"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_html_collapse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize.collapse(normalize.strip_tags(F.col("html"))).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href, text FROM (SELECT page_id, unnest(generate_series(1, len(h))) AS pos, unnest(h) AS href, unnest(t) AS text FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]* href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1) AS h, list_transform(regexp_extract_all(html, '<a[^>]* href=\"[^\"]*\"[^>]*>([^<]*)</a>', 1), lambda x: trim(x)) AS t FROM pages))")
def page_cards(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("html", "body")
    return elements(pages, "a", {"href": ".@href", "text": "."}, keep=("page_id",))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def explode_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(r"""SELECT n, CAST(CASE WHEN s = '' THEN NULL ELSE replace(s, ',', '') END AS DOUBLE) AS usd, CAST(man * 10000 AS DOUBLE) AS jpy, cents / CAST(100 AS DOUBLE) AS cad FROM (
 SELECT o_orderkey AS n, regexp_extract('asking $' || format('{:,}', o_orderkey % 20000) || ' now', '\$\s?([0-9][0-9,]*)', 1) AS s, o_orderkey % 900 AS man, o_orderkey AS cents FROM orders)""")
def money_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("asking $"), F.format_number(k % 20000, 0), F.lit(" now"))
    man = F.concat((k % 900).cast("string"), F.lit(" 万円"))
    return table(spark, sf_dir, "orders").select(k.alias("n"), normalize.dollars(text).alias("usd"), normalize.ten_thousands_of_yen(man).alias("jpy"), normalize.from_cents(k).alias("cad"))


@query(L + """SELECT id, coalesce(m['GBP'], 'x') AS base_sign, CASE WHEN amount IS NULL THEN 'no price shown' ELSE coalesce(m[currency], currency || ' ') || format('{:,.0f}', amount) ||
 CASE WHEN currency <> 'GBP' THEN ' (£' || format('{:,.0f}', gbp) || ')' ELSE '' END END AS shown FROM listings, (SELECT MAP {'GBP': '£', 'USD': '$', 'EUR': '€', 'JPY': '¥', 'THB': '฿'} AS m)""")
def money_text(spark, sf_dir):
    return listings(spark, sf_dir).select("id", F.lit("£").alias("base_sign"), display.money(F.col("amount"), F.col("currency"), F.col("gbp")).alias("shown"))


# Sets, order, validation


@query(O + "SELECT id, ordinal, source, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS n FROM obs) WHERE n = 1")
def dedupe_keep_first(spark, sf_dir):
    return sets.keep_first(observations(spark, sf_dir), "id", ["ordinal"]).select("id", "ordinal", "source", "amount")


@query("""SELECT id, source, turn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, ordinal) AS n FROM (
 SELECT user_id AS id, event_type AS source, 0 AS turn, event_id AS ordinal FROM events WHERE event_type = 'view'
 UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type, 2, event_id FROM events WHERE event_type NOT IN ('view', 'click'))) WHERE n = 1""")
def union_sources(spark, sf_dir):
    obs = observations(spark, sf_dir)
    first, second = F.col("source") == "view", F.col("source") == "click"
    rows = sets.in_turn([obs.filter(first), obs.filter(second), obs.filter(~(first | second))], "turn")
    return sets.keep_first(rows, "id", ["turn", "ordinal"]).select("id", "source", "turn")


@query(L + "SELECT source, count(*) FILTER (ok) AS records, count(*) FILTER (NOT ok) AS dropped FROM (SELECT source, status IN ('active', 'sold') AND (year BETWEEN 1971 AND 1980) AND amount < 200000 AS ok FROM listings) GROUP BY source")
def quarantine_counts(spark, sf_dir):
    checks = {"status": F.col("status").isin("active", "sold"), "year": F.col("year").between(1971, 1980), "amount": F.col("amount") < 200000}
    return validate.source_counts(listings(spark, sf_dir), checks)


@query(L + """, r AS (SELECT id, CASE WHEN source LIKE '1%' THEN 'ebay' ELSE source END AS source, upper(substr(country, 1, CASE WHEN year > 1975 THEN 2 ELSE 3 END)) AS country, status, year, currency, CASE WHEN gbp < 50000 THEN '' ELSE 'https://x.example/' END AS url FROM listings)
 SELECT id, concat_ws(',', CASE WHEN source <> 'ebay' THEN 'source' END, CASE WHEN length(country) <> 2 THEN 'country' END, CASE WHEN NOT year BETWEEN 1971 AND 1980 THEN 'year' END, CASE WHEN url = '' THEN 'url' END) AS broken
 FROM r WHERE source <> 'ebay' OR length(country) <> 2 OR NOT year BETWEEN 1971 AND 1980 OR url = ''""")
def rule_violations(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({
        "source": F.when(F.col("source").startswith("1"), "ebay").otherwise(F.col("source")),
        "country": F.upper(F.substring("country", F.lit(1), F.when(F.col("year") > 1975, 2).otherwise(3))),
        "url": F.when(F.col("gbp") < 50000, "").otherwise("https://x.example/"),
        "title": F.lit("t"), "drive_side": F.lit("RHD"), "description_snippet": F.lit(None).cast("string"), "images": F.array().cast("array<string>"), "king_cab": F.struct(F.lit("pass").alias("body_style_check")),
    })
    return validate.split(priced(rows))[1].select("id", F.array_join("violations", ",").alias("broken"))


@query("SELECT r_name AS market, substr(r_name, 1, 2) AS country, c_mktsegment AS query, CAST(200 AS INTEGER) AS \"limit\" FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def cross_plan(spark, sf_dir):
    markets = table(spark, sf_dir, "region").select(F.col("r_name").alias("market"), F.substring("r_name", 1, 2).alias("country"))
    return plan.market_plan(markets, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query")).distinct()).drop("turn")


@query("""SELECT source, raw, CASE WHEN all_failed THEN 'failed' WHEN raw = 0 THEN 'canary' WHEN some_failed THEN 'warned' ELSE 'ok' END AS verdict FROM (
 SELECT event_type AS source, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS raw, bool_and(value > 90) AS all_failed, bool_or(value > 90) AS some_failed FROM events GROUP BY 1)""")
def canary_checks(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("value") > 90).alias("failed"), F.floor("value").cast("bigint").alias("raw"))
    return validate.attempts(tries).select("source", "raw", "verdict")


# Reconciling


_TWO = f"""a AS (SELECT id, arg_max(amount, ordinal) AS amount, arg_max(status, ordinal) AS status, arg_min(source, ordinal) AS source FROM obs WHERE day = DATE '{DAY}' GROUP BY id),
 b AS (SELECT id, arg_max(amount, ordinal) AS amount, arg_max(status, ordinal) AS status, arg_min(source, ordinal) AS source FROM obs WHERE day = DATE '{DAY}' + 4 GROUP BY id),
 gone AS (SELECT id FROM a WHERE status = 'active' AND id NOT IN (SELECT id FROM b) AND source IN (SELECT source FROM obs WHERE day = DATE '{DAY}' + 4))"""
#: Each row of the second day after the row before it of the same id, the store's or an earlier one of the day.
_STEPS = f"""s AS (SELECT id, ordinal, amount, status, lag(amount) OVER w AS old, lag(status) OVER w AS old_status FROM (SELECT id, -1 AS ordinal, amount, status FROM a UNION ALL SELECT id, ordinal, amount, status FROM obs WHERE day = DATE '{DAY}' + 4) WINDOW w AS (PARTITION BY id ORDER BY ordinal))"""


def _second_day(spark, sf_dir):
    """The store after a first day's observations and the reconcile of those of the fourth day after; no query of it reads marks of relists."""
    obs, day = arriving(observations(spark, sf_dir)), F.lit(DAY).cast("date")
    one, two = obs.filter(F.col("day") == day).drop("day"), obs.filter(F.col("day") == F.date_add(day, 4)).drop("day")
    held = cut(reconcile(spark.createDataFrame([], LISTING), one, one.select("source").distinct(), DAY).merged)  # as a run's store is written
    return held, reconcile(held, two, two.select("source").distinct(), str(date.fromisoformat(DAY) + timedelta(4)))


@query(O + f""", {_TWO} SELECT CAST(id AS VARCHAR) AS id, coalesce(b.amount, a.amount) AS amount, coalesce(b.status, CASE WHEN id IN (SELECT id FROM gone) THEN 'withdrawn' END, a.status) AS status, coalesce(a.source, b.source) AS source,
 CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'left' ELSE 'updated' END AS change FROM a FULL JOIN b USING (id)""")
def merge_upsert(spark, sf_dir):
    change = F.when(F.col("first_seen") > DAY, "new").when(F.col("last_seen") == DAY, "left").otherwise("updated")
    return _second_day(spark, sf_dir)[1].merged.select("id", F.col("price.amount").alias("amount"), "status", "source", change.alias("change"))


@query(O + f", {_TWO} SELECT CAST(id AS VARCHAR) AS id FROM b WHERE id NOT IN (SELECT id FROM a)")
def new_ids(spark, sf_dir):
    return _second_day(spark, sf_dir)[1].new.select("id")


@query(O + f", {_TWO} SELECT CAST(id AS VARCHAR) AS id FROM gone")
def vanished_ids(spark, sf_dir):
    return _second_day(spark, sf_dir)[1].status_changed.filter("new_status = 'withdrawn'").select("id")


@query(O + f", {_TWO} SELECT CAST(a.id AS VARCHAR) AS id, CAST(4 AS INTEGER) AS days FROM a JOIN gone USING (id)")
def aged_out(spark, sf_dir):
    after = _second_day(spark, sf_dir)[1].merged.filter("status = 'withdrawn'")
    return after.select("id", F.date_diff(F.element_at("history", -1)["date"], "last_seen").alias("days"))


@query(O + f""", {_TWO}, {_STEPS} SELECT CAST(id AS VARCHAR) AS id, old AS old_gbp, amount AS new_gbp, CASE WHEN old <> 0 AND amount <> 0 THEN round((amount - old) / old * 100, 1) + 0.0 END AS pct FROM s WHERE old IS NOT NULL AND old <> amount""")
def reconciled_prices(spark, sf_dir):
    return _second_day(spark, sf_dir)[1].price_changed.withColumn("pct", F.col("pct") + F.lit(0.0))


@query(O + f""", {_TWO}, {_STEPS} SELECT CAST(id AS VARCHAR) AS id, old_status, status AS new_status FROM s WHERE old_status IS NOT NULL AND old_status <> status UNION ALL SELECT CAST(id AS VARCHAR), 'active', 'withdrawn' FROM gone""")
def reconciled_statuses(spark, sf_dir):
    return _second_day(spark, sf_dir)[1].status_changed


@query(O + """SELECT id, ordinal, old, amount AS new, CASE WHEN old <> 0 AND amount <> 0 THEN round((amount - old) / old * 100, 1) + 0.0 END AS pct FROM (
 SELECT *, lag(amount) OVER (PARTITION BY id ORDER BY day, ordinal) AS old FROM obs) WHERE old IS NOT NULL AND old <> amount""")
def price_changes(spark, sf_dir):
    m = history.moves(observations(spark, sf_dir), "id", ["day", "ordinal"], "amount")
    pct = F.when((F.col("old") != 0) & (F.col("new") != 0), normalize.to_tenth((F.col("new") - F.col("old")) / F.col("old") * 100) + F.lit(0.0))
    return m.select("id", "ordinal", "old", "new", pct.alias("pct"))


@query(O + "SELECT id, ordinal, old, status AS new FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY day, ordinal) AS old FROM obs) WHERE old <> status")
def status_changes(spark, sf_dir):
    return history.moves(observations(spark, sf_dir), "id", ["day", "ordinal"], "status").select("id", "ordinal", "old", "new")


@query(O + "SELECT id, CAST(day AS VARCHAR) AS day, ordinal, status FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY day, ordinal) AS was FROM obs) WHERE was IS DISTINCT FROM status")
def history_compact(spark, sf_dir):
    return history.compacted(observations(spark, sf_dir), "id", ["day", "ordinal"], ["status"]).select("id", F.col("day").cast("string").alias("day"), "ordinal", "status")


@query("""WITH r AS (SELECT event_type AS source, CAST(ts AS DATE) AS run, bool_or(value > 98) AS ok FROM events GROUP BY ALL),
 i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source ORDER BY run) AS island FROM r)
 SELECT source, CAST(run AS VARCHAR) AS run, ok, count(*) FILTER (NOT ok) OVER (PARTITION BY source, island ORDER BY run) AS streak FROM i""")
def failure_streaks(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("run")).agg(F.bool_or(F.col("value") > 98).alias("ok"))
    return runlog.streaks(runs).select("source", F.col("run").cast("string").alias("run"), "ok", "streak")


_NAMED = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS source, p_type AS title, 'C' || p_size AS country, p_retailprice AS amount, CASE WHEN p_size > 25 THEN 'sold' ELSE 'active' END AS status FROM part),
 pr AS (SELECT n.k, o.k AS old, n.country = o.country AS same, abs(n.amount - o.amount) / o.amount * 100 <= 15 AS near FROM p n JOIN p o ON n.source = o.source AND n.title = o.title AND o.k < n.k WHERE n.status = 'active' AND o.status = 'sold')
 SELECT 'ebay:' || k AS id, 'ebay:' || min(old) AS prior_id, CAST(1 AS DOUBLE) AS similarity FROM pr WHERE same OR near GROUP BY k""")
def relist_best(spark, sf_dir):
    rows = parts_listed(spark, sf_dir)
    return relist.relists(rows.filter("status = 'active'"), rows.limit(0), rows, least=1.0).select("id", "prior_id", "similarity")


@query()
def relist_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    one = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("source"), F.col("p_name").alias("title"), F.lit("XX").alias("country"), F.struct(F.col("p_retailprice").alias("amount")).alias("price"), F.col("p_partkey").alias("ordinal"), F.lit(None).cast("date").alias("first_seen"), F.when(F.col("p_partkey") % 2 == 0, "sold").otherwise("active").alias("status"))
    return relist.relists(one.filter("status = 'active'"), one.limit(0), one)


# Reports and browsing


@query(L + """SELECT id, title, CASE WHEN gbp < 50000 THEN '£' || format('{:,.0f}', gbp) ELSE 'no price shown' END AS price, matched FROM (SELECT id, 'lot ' || id AS title, gbp, year = 1978 AS matched, status FROM listings WHERE first_seen = DATE '1996-01-02') WHERE status <> 'sold'""")
def digest_new(spark, sf_dir):
    rows = listings(spark, sf_dir).filter(F.col("first_seen") == F.lit("1996-01-02").cast("date"))
    amount = F.when(F.col("gbp") < 50000, F.col("gbp"))
    rows = rows.select("id", "status", F.concat(F.lit("lot "), "id").alias("title"), F.lit("").alias("title_translated"), F.struct(amount.alias("amount"), F.lit("GBP").alias("currency"), amount.alias("gbp")).alias("price"), F.struct((F.col("year") == 1978).alias("matched")).alias("king_cab"))
    new = rows.select("id", F.xxhash64("id").alias("ordinal"))
    return report.new_listings(new, rows.filter("status = 'sold'"), rows).drop("ordinal")


@query(O + f""", {_TWO}, {_STEPS}, c AS (SELECT id, old, amount, CASE WHEN old <> 0 AND amount <> 0 THEN round((amount - old) / old * 100, 1) END AS pct FROM s WHERE old IS NOT NULL AND old <> amount)
 SELECT CAST(id AS VARCHAR) AS id, 'obs ' || id AS title, '£' || format('{{:,.0f}}', old) || ' → £' || format('{{:,.0f}}', amount) || ' ' || CASE WHEN pct < 0 THEN '▼' ELSE '▲' END || coalesce(' ' || format('{{:,.0f}}', abs(pct)) || '%', '') AS change FROM c""")
def digest_price(spark, sf_dir):
    after = _second_day(spark, sf_dir)[1]
    return report.price_changes(after.price_changed, after.merged)


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS source, p_type AS title, 'C' || p_size AS country, p_retailprice AS amount, CASE WHEN p_size > 25 THEN 'sold' ELSE 'active' END AS status FROM part),
 f AS (SELECT n.k, min(o.k) AS old FROM p n JOIN p o ON n.source = o.source AND n.title = o.title AND o.k < n.k WHERE n.status = 'active' AND o.status = 'sold' AND (n.country = o.country OR abs(n.amount - o.amount) / o.amount * 100 <= 15) GROUP BY n.k)
 SELECT 'ebay:' || f.k AS id, n.title, 'ebay:' || f.old AS prior_id, CASE WHEN o.amount < 1500 THEN o.title END AS prior_title FROM f JOIN p n USING (k) JOIN p o ON o.k = f.old""")
def digest_relist(spark, sf_dir):
    rows = parts_listed(spark, sf_dir)
    found = relist.relists(rows.filter("status = 'active'"), rows.limit(0), rows, least=1.0)
    kept = rows.filter("status = 'active' OR price.amount < 1500")  # a prior one may be gone from the store
    return report.relist_lines(found, kept).drop("reasons")


@query(L + """SELECT id, section, CAST(row_number() OVER (PARTITION BY section ORDER BY nullif(gbp, 0) ASC NULLS LAST, first_seen DESC, id) AS INTEGER) AS place FROM (
 SELECT *, CASE WHEN status = 'active' THEN 'active' ELSE 'ended' END AS section FROM listings WHERE coalesce(year BETWEEN 1971 AND 9999, false) AND coalesce(gbp <= 100000, false) AND source = '1-URGENT')""")
def browse_filter_sort(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("last_seen", F.col("first_seen"))
    return browse.browse(rows, "price-asc", source="1-URGENT", year_min=1971, price_max=100000).select("id", "section", "place")


@query(L + "SELECT DISTINCT unnest(['country', 'source', 'currency', 'status']) AS facet, unnest([country, source, currency, status]) AS value FROM listings")
def facet_values(spark, sf_dir):
    return browse.facets(listings(spark, sf_dir), ["country", "source", "currency", "status"])


@query("""WITH v AS (SELECT p_partkey, CAST(p_name AS VARCHAR) AS p_name, CAST(p_brand AS VARCHAR) AS p_brand, CAST(p_type AS VARCHAR) AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE p_partkey IN (1, 2)),
 u AS (UNPIVOT v ON p_name, p_brand, p_type, p_size INTO NAME field VALUE value)
 SELECT a.field, a.value AS a, b.value AS b, a.value <> b.value AS differs FROM u a JOIN u b USING (field) WHERE a.p_partkey = 1 AND b.p_partkey = 2""")
def variant_compare(spark, sf_dir):
    return browse.compare(table(spark, sf_dir, "part"), "p_partkey", 1, 2, ["p_name", "p_brand", "p_type", "p_size"])


@query(L + "SELECT source, count(*) FILTER (gbp < 500) AS shown, count(*) AS total, coalesce(bool_or(gbp < 500), false) AS visible FROM listings GROUP BY source")
def section_visibility(spark, sf_dir):
    return browse.sections(listings(spark, sf_dir), "source", F.coalesce(F.col("gbp") < 500, F.lit(False)))


@query(O + """SELECT id, ordinal, row_number() OVER (PARTITION BY id ORDER BY day, ordinal) = 1 AS is_first, row_number() OVER (PARTITION BY id ORDER BY day DESC, ordinal DESC) = 1 AS is_last FROM obs""")
def first_last_obs(spark, sf_dir):
    return browse.history_points(observations(spark, sf_dir), "id", ["day", "ordinal"]).select("id", "ordinal", "is_first", "is_last")


@query(O + "SELECT id, min(amount) AS low, max(amount) AS high, CAST(min(day) AS VARCHAR) AS since, CAST(max(day) AS VARCHAR) AS until, count(*) AS n FROM obs GROUP BY id HAVING count(amount) >= 2")
def history_minmax(spark, sf_dir):
    return browse.priced_points(observations(spark, sf_dir), "id", "day", "amount").withColumns({"since": F.col("since").cast("string"), "until": F.col("until").cast("string")})


@query(O + """, w AS (SELECT id, ordinal AS x, amount AS y, min(amount) OVER p AS lo, max(amount) OVER p AS hi, min(ordinal) OVER p AS x0, max(ordinal) OVER p AS x1, count(*) OVER p AS n FROM obs WINDOW p AS (PARTITION BY id))
 SELECT id, x, round(coalesce((x - x0) / CAST(nullif(x1 - x0, 0) AS DOUBLE) * 600, 0), 4) AS px, round(200 - (y - (lo - pad)) / ((hi + pad) - (lo - pad)) * 200, 4) AS py FROM (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.15 ELSE 1 END AS pad FROM w WHERE n >= 2)""")
def chart_points(spark, sf_dir):
    obs = observations(spark, sf_dir).select("id", F.col("ordinal").alias("x"), F.col("amount").alias("y"))
    return browse.scaled(obs, "id", "x", "y").select("id", "x", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(L + "SELECT 'old_site:' || substr(id, 5) AS id, CASE country WHEN 'UNITED STATES' THEN 'US' WHEN 'UNITED KINGDOM' THEN 'GB' WHEN 'GERMANY' THEN 'DE' WHEN 'JAPAN' THEN 'JP' WHEN 'CANADA' THEN 'CA' ELSE 'XX' END AS country, CAST(first_seen AS VARCHAR) AS first_seen, CAST(CASE WHEN status = 'active' THEN 1 ELSE 2 END AS INTEGER) AS entries, status FROM listings")
def legacy_backfill(spark, sf_dir):
    flat = flat_listings(listings(spark, sf_dir))
    held = legacy.converted(flat.filter("status = 'withdrawn'"))  # what a first import brought
    return legacy.imported(held, flat).select("id", "country", F.col("first_seen").cast("string").alias("first_seen"), F.size("history").alias("entries"), "status")


@query("SELECT c_nationkey, string_agg(c_mktsegment || ': ' || n, '; ' ORDER BY c_mktsegment) AS line FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def title_digest_text(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return browse.listed(n, "c_nationkey", "c_mktsegment", F.concat("c_mktsegment", F.lit(": "), F.col("n").cast("string")))


@query(L + "SELECT currency, count(*) AS n, CAST(round(sum(gbp), 0) AS DOUBLE) AS gbp FROM listings GROUP BY currency HAVING currency IN ('GBP', 'USD', 'EUR', 'JPY', 'THB')")
def currency_totals(spark, sf_dir):
    return listings(spark, sf_dir).filter(F.col("currency").isin(CURRENCIES)).groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gbp"), 0).alias("gbp"))


@query(L + "SELECT id, coalesce(CASE source WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' END, source) AS shown FROM listings")
def display_dimension_join(spark, sf_dir):
    labels = spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High")], "source string, label string")
    return browse.with_label(listings(spark, sf_dir), "source", labels, "shown").select("id", "shown")


# Snapshots, contracts, medians


_SNAPSHOTS = """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id AS id, max(CASE WHEN value > 50 THEN 'active' ELSE 'sold' END) AS status FROM events GROUP BY 1, 2),
 d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM s)),
 p AS (SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(status) OVER w = status THEN 0 ELSE 1 END AS starts FROM s JOIN d USING (day) WINDOW w AS (PARTITION BY id ORDER BY n)),
 r AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY n) AS run FROM p),
 i AS (SELECT id, min(status) AS status, min(day) AS valid_from, max(day) AS last_day, arg_max(coalesce(CAST(next AS VARCHAR), ''), n) AS valid_to FROM r GROUP BY id, run)"""


def _snapshots(spark, sf_dir):
    """Observations as full-state snapshots: what a day holds of an id is its state, and an id that it lacks is gone."""
    return intervals.intervals(observations(spark, sf_dir).withColumnRenamed("day", "snapshot_date"), ["status"])


@query(_SNAPSHOTS + " SELECT id, status, CAST(valid_from AS VARCHAR) AS valid_from, CAST(last_day AS VARCHAR) AS last_day, nullif(valid_to, '') AS valid_to FROM i")
def snapshot_intervals(spark, sf_dir):
    text = {c: F.col(c).cast("string") for c in ("valid_from", "last_day", "valid_to")}
    return _snapshots(spark, sf_dir).withColumns(text)


@query(_SNAPSHOTS + """, c AS (SELECT *, CAST(valid_from AS VARCHAR) AS since, lag(status) OVER w AS was, lag(valid_to) OVER w AS ended, lead(CAST(valid_from AS VARCHAR)) OVER w AS next FROM i WINDOW w AS (PARTITION BY id ORDER BY valid_from))
 SELECT since AS day, id, CASE WHEN was IS NULL THEN 'new' WHEN ended = since THEN 'changed' ELSE 'back' END AS kind, was AS before, status AS after FROM c
 UNION ALL SELECT valid_to, id, 'gone', status, NULL FROM c WHERE valid_to <> '' AND next IS DISTINCT FROM valid_to""")
def snapshot_changes(spark, sf_dir):
    found = intervals.changes(_snapshots(spark, sf_dir), ["status"])
    return found.select(F.col("day").cast("string").alias("day"), "id", "kind", F.col("before.status").alias("before"), F.col("after.status").alias("after"))


@query(L + "SELECT count(gbp) AS n, CAST(median(gbp) AS DOUBLE) AS median_gbp FROM listings")
def exact_median(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return rows.agg(F.count("gbp").alias("n")).withColumn("median_gbp", F.lit(quantiles.exact_median(rows, "gbp")).cast("double"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE k WHEN 1 THEN 'id:type' END, CASE k WHEN 2 THEN 'old_gbp:type' END, CASE k WHEN 3 THEN 'pct:required' END, CASE k WHEN 4 THEN ':unknown' END], lambda x: x IS NOT NULL), ',') AS violations
 FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def contract_breaches(spark, sf_dir):
    """Orders as changes of price, of which some break the contract: a number for an id, a text for a price, a missing and an unknown field."""
    k, amount = F.col("o_orderkey") % 6, F.col("o_totalprice")
    known = F.to_json(F.struct(F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("id"), amount.alias("old_gbp"), (amount / 2).alias("new_gbp"), F.when(k == 5, F.lit(None)).otherwise(-50.0).alias("pct")), {"ignoreNullFields": "false"})
    body = (
        F.when(k == 1, F.regexp_replace(known, '"id":"ord:([0-9]+)"', '"id":$1'))
        .when(k == 2, F.regexp_replace(known, '"old_gbp":([^,]+)', '"old_gbp":"$1"'))
        .when(k == 3, F.regexp_replace(known, ',"pct":[^}]+', ""))
        .when(k == 4, F.regexp_replace(known, "}$", ',"more":1}'))
        .otherwise(known)
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return judged(rows, contracts.PRICE_CHANGE, "body").select("o_orderkey", F.array_join("violations", ",").alias("violations"))
