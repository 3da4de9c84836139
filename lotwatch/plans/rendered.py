"""Queries that render parts as pages of each source, read them by its parser, and SQL for the rows that must come out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.functions import classify, display, normalize
from lotwatch.operators import specs
from lotwatch.plans.views import table
from lotwatch.sources import payloads, registry, udtfs

DAY = date(2026, 1, 1)
RATES = [("USD", 1.25), ("JPY", 187.3), ("CAD", 1.6), ("THB", 50.0)]
#: What a rendered part is: small ones bear another number, sizes give years in and out of the era, some titles name a part or another generation.
PART = """p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_size AS size, p_retailprice AS amount, 1940 + p_size AS year, CASE WHEN p_size >= 20 THEN '620' ELSE '510' END AS number,
 CASE WHEN p_name LIKE '%a%' THEN p_name ELSE 'grille' END AS word, p_size >= 45 AS ended FROM part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few bytes become pages that take long to read, so rows are dealt out: a small file would be one task.
    p = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("k"), size.alias("size"), F.col("p_retailprice").alias("amount"), (1940 + size).cast("int").alias("year"), F.when(size >= 20, "620").otherwise("510").alias("number"),
        F.when(F.col("p_name").contains("a"), F.col("p_name")).otherwise("grille").alias("word"), (size >= 45).alias("ended"),
    )


def said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def read(spark: SparkSession, rows: DataFrame, body: Column, source: str, kind: str | None = None) -> DataFrame:
    """What a source's parser makes of a page for each part: id, title, year, amount, gbp, status."""
    rates = spark.createDataFrame([(c, r, DAY) for c, r in RATES], "currency string, rate double, date date")
    pages = rows.select(body.alias("body"), F.lit("US").alias("country"), F.lit(kind).cast("string").alias("kind"))
    out = registry.SOURCES[source](pages, rates)
    return out.select("id", "title", F.coalesce("year", F.lit(0)).alias("year"), "price.amount", "price.gbp", "status")


def json_of(**fields: Column | str | None) -> Column:
    return F.to_json(F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in fields.items()]))


def sql(source: str, title: str, where: str, rate: float, year: str = "CASE WHEN year BETWEEN 1971 AND 1980 THEN year END", status: str = "'active'", amount: str = "amount", key: str = "k") -> str:
    return f"WITH {PART}, q AS (SELECT *, {title} AS title, {amount} AS price FROM p) SELECT '{source}:' || {key} AS id, title, CAST(coalesce({year}, 0) AS INTEGER) AS year, CAST(price AS DOUBLE) AS amount, round(price / {rate}, 2) AS gbp, {status} AS status FROM q WHERE {where}"


TITLE = "year || ' Datsun ' || number || ' ' || word"
#: The deny list's words that parts' names may hold, as DuckDB has no list of them.
NO_PART = " AND ".join(f"NOT contains(lower(title), '{w}')" for w in classify.PART_WORDS)


def title() -> Column:
    return said(F.col("year"), " Datsun ", F.col("number"), " ", F.col("word"))


def source_ebay(spark, sf_dir):
    item = F.struct(F.col("k").alias("itemId"), title().alias("title"), F.struct(F.col("amount").cast("string").alias("value"), F.lit("USD").alias("currency")).alias("price"), F.lit("https://m.example/1").alias("itemWebUrl"), F.array(F.lit("FIXED_PRICE")).alias("buyingOptions"))
    return read(spark, parts(spark, sf_dir), json_of(itemSummaries=F.array(item)), "ebay")


def source_bringatrailer(spark, sf_dir):
    item = F.struct(title().alias("title"), said("https://a.example/listing/", F.col("k"), "/").alias("url"), F.col("amount").alias("current_bid"), (~F.col("ended")).alias("active"))
    return read(spark, parts(spark, sf_dir), said("<script>var auctionsCompletedInitialData = ", json_of(items=F.array(item)), ";</script>"), "bringatrailer")


def source_carsandbids(spark, sf_dir):
    bid = F.struct(F.col("amount").alias("amount"))
    item = F.struct(title().alias("title"), F.col("k").alias("slug"), bid.alias("current_bid"), F.col("ended").alias("ended"), F.col("year").alias("year"))
    return read(spark, parts(spark, sf_dir), json_of(auctions=F.array(item)), "carsandbids")


def source_hemmings(spark, sf_dir):
    body = said('<ul><li><a href="/listing/', F.col("k"), '">', title(), "</a><b>$ ", F.format_number(F.floor("amount"), 0), "</b></li></ul>")
    return read(spark, parts(spark, sf_dir), body, "hemmings")


def source_goonet_exchange(spark, sf_dir):
    body = said('<ul class="list-listview"><li><a href="/usedcars/NISSAN/DATSUN_TRUCK/', F.col("k"), '/"><h3 class="title">', title(), '</h3></a><ul class="details"><li>', F.col("year"), '.03</li></ul><p class="price">¥', F.format_number(F.floor("amount"), 0), "</p></li></ul>")
    return read(spark, parts(spark, sf_dir), body, "goonet_exchange")


def source_carsensor(spark, sf_dir):
    body = said('<div class="cassette"><a href="/usedcar/detail/AU', F.col("k"), '/index.html">x</a><h3 class="cassetteMain__title">', title(), '</h3><p class="basePrice__price">', F.col("size"), '.5 万円</p><p class="specList">年式 ', F.col("year"), " (S50)</p></div>")
    return read(spark, parts(spark, sf_dir), body, "carsensor")


def source_yahoo_auctions(spark, sf_dir):
    body = said('<ul><li class="Product"><a class="Product__titleLink" data-auction-id="x', F.col("k"), '" data-auction-title="', title(), '" data-auction-price="', F.floor(F.col("amount") * 107), '">x</a></li></ul>')
    return read(spark, parts(spark, sf_dir), body, "yahoo_auctions", "open")


def state(data: Column) -> Column:
    return said('<script id="__NEXT_DATA__" type="application/json">', data, "</script>")


def nested(inner: Column, *names: str) -> Column:
    for n in reversed(names):
        inner = F.struct(inner.alias(n))
    return F.to_json(inner)


def source_kaidee(spark, sf_dir):
    ad = F.struct(F.col("k").alias("id"), title().alias("title"), F.col("amount").alias("price"))
    return read(spark, parts(spark, sf_dir), state(nested(F.array(ad), "props", "pageProps", "ads")), "kaidee")


def source_classiccars(spark, sf_dir):
    offer = F.struct(said("/listings/", F.col("k")).alias("url"), F.col("amount").cast("string").alias("price"), F.lit("USD").alias("priceCurrency"))
    car = F.struct(F.array(F.lit("Product"), F.lit("Car")).alias("@type"), title().alias("name"), F.col("k").alias("sku"), offer.alias("offers"), F.col("year").cast("string").alias("modelDate"))
    return read(spark, parts(spark, sf_dir), said('<script type="application/ld+json">', F.to_json(car), "</script>"), "classiccars")


def source_kijiji(spark, sf_dir):
    ad = F.struct(F.col("k").alias("id"), title().alias("title"), said("https://k.example/v-", F.when(F.col("ended"), "toys").otherwise("cars-trucks"), "/", F.col("k")).alias("url"), F.struct(F.round(F.col("amount") * 100).alias("amount")).alias("price"))
    return read(spark, parts(spark, sf_dir), state(nested(F.create_map(said("StandardListing:", F.col("k")), ad), "props", "pageProps", "__APOLLO_STATE__")), "kijiji")


def source_barnfinds(spark, sf_dir):
    body = said("<rss><item><title>", title(), "</title><link>https://b.example/", F.col("k"), "/</link><description>", F.when(F.col("ended"), "Seen for ").otherwise("nothing like "), "$", F.format_number(F.floor("amount"), 0), "</description></item></rss>")
    return read(spark, parts(spark, sf_dir), body, "barnfinds")


def source_flex(spark, sf_dir):
    body = said('<div class="usdbox"><a href="https://f.example/detail/x-used-', F.col("k"), '.html">x</a><div class="useditem__ttl"><h3>', title(), "</h3></div>", F.when(F.col("size") % 2 == 0, said(F.col("year"), "年 ")).otherwise(""), F.col("size"), "万円", F.when(F.col("ended"), " SOLD OUT").otherwise(""), "</div>")
    return read(spark, parts(spark, sf_dir), body, "flex")


def source_kuruma_ex(spark, sf_dir):
    body = said('<div class="car-item"><a href="/usedcar/detail/ccAB', F.col("k"), '">x</a>', title(), " 支払総額 ", F.col("size"), "万円 年式 ", F.col("year"), "年</div>")
    return read(spark, parts(spark, sf_dir), body, "kuruma_ex")


def scalar_texts(spark, sf_dir):
    """Small texts of parts and orders: translation marks, labels, money, bodies, engines."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", normalize.needs_translation(F.when(k % 2 == 0, said("lot ", k, " トラック")).otherwise(said("lot ", k))).alias("translate"),
        normalize.before_labels(said("lot ", k, "応談", k, "年式"), "支払総額|本体価格|応談|年式").alias("head"), normalize.percent_encoded(said("a b/", F.col("o_orderpriority"))).alias("encoded"),
        display.site_money(F.col("o_totalprice"), F.lit("USD"), F.col("o_totalprice") / 1.25).alias("money"), display.clock(said(F.to_date("o_orderdate"), "T04:", k % 50 + 10, ":00")).alias("clock"),
        normalize.slug_of_title(F.col("o_orderpriority")).alias("slug"), normalize.absolute(F.when(k % 3 == 0, "//i.example/1").when(k % 3 == 1, "/d/1").otherwise("https://x.example"), "https://b.example").alias("absolute"),
    )


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    engine = F.struct(F.when(F.col("ended"), None).otherwise(F.col("number")).alias("code"), F.when(F.col("size") > 30, F.array(F.lit("L18"), F.lit("L20B"))).alias("codes"), (F.col("size") * 40).cast("int").alias("displacement_cc"), F.col("size").cast("double").alias("power_hp"))
    body = F.when(F.col("size") < 10, "King (x)").when(F.col("size") < 20, "double (king)").when(F.col("size") < 30, "long bed").otherwise("long wheelbase")
    v = F.struct(F.col("k").alias("id"), F.lit("v").alias("name"), F.struct(F.col("year").alias("from"), (F.col("year") + 3).alias("to")).alias("years"), body.alias("body"), engine.alias("engine"), F.array(F.struct(F.col("word").alias("name"), F.lit("#000000").alias("hex"))).alias("colors"))
    text = p.select(json_of(version="1", markets=F.array(F.struct(F.lit("US").alias("market"), F.lit("United States").alias("name"), F.array(v).alias("variants")))).alias("b"))
    return specs.variants(text.select(F.from_json("b", specs.SPECS).alias("s")).select("s.*"))


def spec_filter(spark, sf_dir):
    return spec_rows(spark, sf_dir).filter(specs.matches(region="US", year=1977, engine="L18", colour="grille")).select("id", "body_type", F.array_join("engines", ",").alias("engines"))


def spec_shown(spark, sf_dir):
    return specs.shown(spec_rows(spark, sf_dir)).select("id", "years", "body", "engine", "power", "length", "colours").join(spec_rows(spark, sf_dir).select("id", "body_type", "engine_line"), "id")


def lateral_elements(spark, sf_dir):
    """Two elements of a page for each part, by SQL with LATERAL."""
    udtfs.register(spark)
    body = said('<ul><li class="lot x" data-k="', F.col("k"), '"><b>', F.col("word"), "</b> ", F.col("number"), '</li><li class="lot" data-k="s', F.col("k"), '">size <i>', F.col("size"), "</i></li><li>no lot</li></ul>")
    parts(spark, sf_dir).select("k", body.alias("body")).createOrReplaceTempView("lotwatch_pages")
    return spark.sql("""SELECT p.k, e.pos, e.lot, e.text, e.bold FROM lotwatch_pages p, LATERAL page_elements(p.body, 'li.lot', '{"lot": ".@data-k", "text": ".", "bold": "b"}') e""")


def lateral_feed(spark, sf_dir):
    """Items of a feed for each part, RSS for one half and Atom for the other, by SQL with LATERAL."""
    udtfs.register(spark)
    rss = said("<rss><channel><item><title>A &amp; ", F.col("word"), "</title><link>https://b.example/", F.col("k"), "/</link><description><![CDATA[<p>size <b>", F.col("size"), '</b></p><img src="https://i.example/', F.col("k"), '">]]></description></item></channel></rss>')
    atom = said('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A &#38; ', F.col("word"), '</title><link href="https://b.example/', F.col("k"), '/"/><summary type="html">&lt;p&gt;size&nbsp;', F.col("size"), "&lt;/p&gt;</summary></entry></feed>")
    parts(spark, sf_dir).select("k", F.when(F.col("ended"), atom).otherwise(rss).alias("body")).createOrReplaceTempView("lotwatch_feeds")
    return spark.sql("SELECT p.k, e.pos, e.title, e.link, replace(e.description, chr(160), ' ') AS description, e.image FROM lotwatch_feeds p, LATERAL feed_items(p.body) e")


_SPEC = f"""{PART}, v AS (SELECT *, CASE WHEN ended THEN NULL ELSE number END AS code, CASE WHEN size < 10 THEN 'King (x)' WHEN size < 20 THEN 'double (king)' WHEN size < 30 THEN 'long bed' ELSE 'long wheelbase' END AS body,
 CASE WHEN size < 10 THEN 'King Cab' WHEN size < 20 THEN 'Double cab' WHEN size < 30 THEN 'Long bed' ELSE 'Standard cab' END AS body_type, CASE WHEN size > 30 THEN 'L18,L20B' WHEN NOT ended THEN number ELSE '' END AS engines, format('{{:.1f}}L', size * 40 / 1000.0) AS litres FROM p)"""
ERA = "year BETWEEN 1971 AND 1980"
QUERIES = {f.__name__: f for f in (lateral_elements, lateral_feed, source_ebay, source_bringatrailer, source_carsandbids, source_hemmings, source_goonet_exchange, source_carsensor, source_yahoo_auctions, source_kaidee, source_classiccars, source_kijiji, source_barnfinds, source_flex, source_kuruma_ex, scalar_texts, spec_filter, spec_shown)}
ORACLES = {
    "lateral_elements": f"WITH {PART} SELECT k, CAST(0 AS INTEGER) AS pos, k AS lot, word || ' ' || number AS text, word AS bold FROM p UNION ALL SELECT k, CAST(1 AS INTEGER), 's' || k, 'size ' || size, NULL FROM p",
    "lateral_feed": f"WITH {PART} SELECT k, CAST(0 AS INTEGER) AS pos, 'A & ' || word AS title, 'https://b.example/' || k || '/' AS link, 'size ' || size AS description, CASE WHEN NOT ended THEN 'https://i.example/' || k END AS image FROM p",
    "source_ebay": sql("ebay", TITLE, f"number = '620' AND amount >= 500 AND {NO_PART} AND NOT regexp_matches(title, '{classify.AD_WORD}')", 1.25),
    "source_bringatrailer": sql("bringatrailer", TITLE, "number = '620'", 1.25, status="CASE WHEN ended THEN 'sold' ELSE 'active' END"),
    "source_carsandbids": sql("carsandbids", TITLE, "number = '620'", 1.25, year="year", status="CASE WHEN ended THEN 'sold' ELSE 'active' END"),
    "source_hemmings": sql("hemmings", TITLE, "number = '620'", 1.25, amount="floor(amount)"),
    "source_goonet_exchange": sql("goonet_exchange", TITLE, ERA, 187.3, amount="floor(amount)"),
    "source_carsensor": sql("carsensor", TITLE, ERA, 187.3, amount="CAST((size + 0.5) * 10000 AS DOUBLE)", key="'AU' || k"),
    "source_yahoo_auctions": sql("yahoo_auctions", TITLE, "number = '620' AND price >= 100000", 187.3, amount="floor(amount * 107)", key="'x' || k"),
    "source_kaidee": sql("kaidee", TITLE, "number = '620' OR regexp_matches(title, '(?i)truck|pickup')", 50.0),
    "source_classiccars": sql("classiccars", TITLE, "true", 1.25),
    "source_kijiji": sql("kijiji", TITLE, "number = '620' AND NOT ended", 1.6, amount="round(round(amount * 100) / 100, 2)"),
    "source_barnfinds": sql("barnfinds", TITLE, "true", 1.25, amount="CASE WHEN ended THEN floor(amount) END"),
    "source_flex": sql("flex", TITLE, f"number = '620' AND (size % 2 = 1 OR {ERA})", 187.3, year="CASE WHEN size % 2 = 0 THEN year END", amount="CAST(size * 10000 AS DOUBLE)", status="CASE WHEN ended THEN 'sold' ELSE 'active' END"),
    "source_kuruma_ex": sql("kuruma_ex", "'x ' || year || ' Datsun ' || number || ' ' || word", ERA, 187.3, amount="CAST(size * 10000 AS DOUBLE)", key="'ccAB' || k"),
    "scalar_texts": """SELECT o_orderkey, o_orderkey % 2 = 0 AS translate, 'lot ' || o_orderkey AS head, 'a%20b%2F' || replace(o_orderpriority, ' ', '%20') AS encoded,
 '$' || rtrim(rtrim(format('{:,.3f}', o_totalprice), '0'), '.') || ' · £' || format('{:,.0f}', floor(o_totalprice / 1.25 + 0.5)) AS money, '04:' || (o_orderkey % 50 + 10) AS clock, replace(lower(o_orderpriority), ' ', '-') AS slug,
 CASE o_orderkey % 3 WHEN 0 THEN 'https://i.example/1' WHEN 1 THEN 'https://b.example/d/1' ELSE 'https://x.example' END AS absolute FROM orders""",
    "spec_filter": f"WITH {_SPEC} SELECT k AS id, body_type, engines FROM v WHERE 1977 BETWEEN year AND year + 3 AND size > 30 AND word = 'grille'",
    "spec_shown": f"""WITH {_SPEC} SELECT k AS id, year || '–' || (year + 3) AS years, body, coalesce(code || ', ' || litres, 'not verified') AS engine, size || ' hp' AS power, '—' AS length, '1 documented' AS colours, body_type,
 code || ', ' || litres || ', ' || size || ' hp' AS engine_line FROM v""",
}
