"""Parsers of all sources on pages made by hand, their plans, and a day's run over them."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import daily, fx, report
from lotwatch.schemas import FX, LISTING
from lotwatch.sources import html, payloads, plan, registry, store
from lotwatch.sources import pages as landed_pages

RATES = "currency string, rate double, date date"


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([(c, r, date(2026, 1, 1)) for c, r in (("USD", 1.25), ("JPY", 200.0), ("CAD", 1.7), ("THB", 45.0))], RATES)


def page(spark, *bodies):
    return spark.createDataFrame([(b, "US", t, k) for t, (k, b) in enumerate(b if isinstance(b, tuple) else (None, b) for b in bodies)], "body string, country string, turn int, kind string")


def state(data):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


API = lambda *items: json.dumps({"itemSummaries": items})
ITEM = lambda **k: {"itemId": "1", "title": "1978 Datsun truck 620 truck", "price": {"value": "5000", "currency": "USD"}, "itemWebUrl": "https://m.example/1", "buyingOptions": ["FIXED_PRICE"], "categories": [{"categoryName": "Pickup"}]} | k


def test_api(spark, rates):
    body = API(ITEM(), ITEM(itemId="2", title="620 grille"), ITEM(itemId="3", price={"value": "20", "currency": "USD"}), ITEM(itemId="4", title="1620 truck"), ITEM(itemId="5", categories=[{"categoryName": "Art"}]))
    got = payloads.api_items(page(spark, body, API(ITEM(title="1977 Datsun truck 620 again"))), rates).collect()
    assert [(r["id"], r["price"]["gbp"], r["year"], r["country"]) for r in got] == [("ebay:1", 4000.0, 1978, "US")]


def test_auctions(spark, rates):
    items = [{"title": "1974 Datsun truck 620", "url": "https://a.example/x/slug-1/", "current_bid": 9000, "year": 1974, "active": False}, {"title": "1974 Datsun 510", "url": "https://a.example/y"}, {"title": "1979 Datsun truck 620", "active": True, "year": 2020, "country_code": "uk"}]
    got = payloads.auctions(page(spark, "<script>var auctionsCompletedInitialData = " + json.dumps({"items": items}) + ";</script>"), rates).orderBy("ordinal").collect()
    assert [(r["id"], r["status"], r["country"], r["year"], r["price"]["currency"]) for r in got] == [("bringatrailer:slug-1", "sold", "US", 1974, "USD"), ("bringatrailer:1979-datsun-truck-620", "active", "UK", 1979, "USD")]
    with pytest.raises(Exception, match="no auctionsCompletedInitialData"):
        payloads.auctions(page(spark, "<html>"), rates).collect()


def test_community_auctions(spark, rates):
    one = {"title": "1978 Datsun truck 620 King Cab", "sub_title": "5-speed", "slug": "abc", "current_bid": {"amount": 5000}, "location": {"country": "Nowhere", "state": "CA"}, "main_photo": {"url": "https://i.example/1"}, "year": 1978}
    two = {"title": "Datsun truck 620", "id": 17, "current_bid": 7000, "ended": True, "year": 1985}
    body = json.dumps({"auctions": [], "results": [one, two, {"title": "Datsun 510"}]})
    want = [("carsandbids:abc", 5000.0, 1978, "active", "US", "CA", ["https://i.example/1"]), ("carsandbids:17", 7000.0, 1985, "sold", "US", None, [])]
    for text in (body, f"<script>window.__INITIAL_STATE__ = {body};</script>"):
        got = payloads.community_auctions(page(spark, text), rates).orderBy("ordinal").collect()
        assert [(r["id"], r["price"]["amount"], r["year"], r["status"], r["country"], r["region"], r["images"]) for r in got] == want
    assert got[0]["king_cab"]["matched"] and got[0]["drive_side"] == "LHD"
    for bad, said in (("403 Forbidden", "HTTP 403"), ("<html>", "neither JSON")):
        with pytest.raises(Exception, match=said):
            payloads.community_auctions(page(spark, bad), rates).collect()


def test_linked_titles(spark, rates):
    body = """<nav><a href="/cars-for-sale/all">All 620</a></nav><ul><li><a href="/listing/1975-datsun-truck-620-9"><b>1975</b> Datsun truck 620</a> <span>$8,995</span><img src="https://i.example/h"></li>
    <li><a href="https://x.example/listing/1975-datsun-truck-620-9/">1975 Datsun truck 620</a> $1</li><li><a href="/listing/z">1975 Datsun 510</a></li></ul>"""
    got = payloads.linked_titles(page(spark, body), rates).collect()
    assert [(r["id"], r["url"], r["title"], r["price"]["amount"], r["images"]) for r in got] == [("hemmings:1975-datsun-truck-620-9", "https://www.hemmings.com/listing/1975-datsun-truck-620-9", "1975 Datsun truck 620", 8995.0, ["https://i.example/h"])]


def test_keyed_state(spark, rates):
    ad = lambda i, **k: {"id": str(i), "title": "Datsun truck 620", "url": f"https://k.example/v-cars-trucks/{i}", "price": {"amount": 850000}, "location": {"name": "BC"}, "imageUrls": ["https://i.example/1"]} | k
    ads = {"StandardListing:1": ad(1), "StandardListing:2": ad(2, url="https://k.example/v-toys/2"), "StandardListing:3": ad(3, title="Camion", description="un 620 de 1974", url="https://k.example/v-autos-camions/3", price=None), "Other:4": {}}
    got = payloads.keyed_state(page(spark, state({"props": {"pageProps": {"__APOLLO_STATE__": ads}}})), rates).orderBy("ordinal").collect()
    assert [(r["id"], r["price"]["amount"], r["images"], r["year"]) for r in got] == [("kijiji:1", 8500.0, ["https://i.example/1"], None), ("kijiji:3", None, ["https://i.example/1"], 1974)]
    for bad, said in (("<html>", "no state"), (state({"props": {"pageProps": {"__APOLLO_STATE__": {"Other:1": {}}}}}), "no listing")):
        with pytest.raises(Exception, match=said):
            payloads.keyed_state(page(spark, bad), rates).collect()


def test_linked_data(spark, rates):
    ld = lambda **k: '<script type="application/ld+json">' + json.dumps({"@type": "Car", "name": "1979 pickup", "sku": "77", "offers": {"url": "/listings/view/1/1979-datsun-truck-620-for-sale-in-cadillac-michigan-49601", "price": "100", "priceCurrency": "USD"}} | k) + "</script>"
    body = ld() + ld(sku="77", name="again") + '<script type="application/ld+json">{broken</script>' + ld(**{"@type": ["Product", "car"], "sku": "78", "modelDate": "1975", "offers": {"price": "call"}}) + ld(**{"@type": "Organization", "sku": "79"})
    got = payloads.linked_data(page(spark, body), rates).orderBy("ordinal").collect()
    assert [(r["source_listing_id"], r["title"], r["year"], r["region"], r["price"]["amount"]) for r in got] == [("77", "1979 pickup", 1979, "Cadillac Michigan", 100.0), ("78", "1979 pickup", 1975, None, None)]
    assert got[0]["url"] == "https://classiccars.com/listings/view/1/1979-datsun-truck-620-for-sale-in-cadillac-michigan-49601"
    assert payloads.linked_data(page(spark, "no datsun today"), rates).count() == 0
    with pytest.raises(Exception, match="not the search"):
        payloads.linked_data(page(spark, "<html>"), rates).collect()


def test_feed(spark, rates):
    rss = '<rss><channel><item><title>King Cab &#215; 1</title><link>https://b.example/find-1/</link><description><![CDATA[<p>Asking  price of $8,500 or so</p><img src="https://i.example/2">]]></description></item></channel></rss>'
    got = payloads.feed(page(spark, rss), rates).collect()
    assert [(r["id"], r["price"]["amount"], r["title"], r["images"]) for r in got] == [("barnfinds:find-1", 8500.0, "King Cab x 1", ["https://i.example/2"])]


def test_japanese_dealers(spark, rates):
    box = lambda i, title, text, sold="": f'<div class="usdbox x"><div class="usd_phbox"><img data-src="https://i.example/{i}.jpg"></div><a href="https://f.example/detail/トラ-used-{i}.html">詳細</a><div class="useditem__ttl"><h3>{title}</h3><p>rare</p></div>{text}{sold}</div>'
    body = box(1, "ダットサントラック", "1977年 <b>398.0</b>万円") + box(2, "ダットサントラック", "2001年 100万円") + box(3, "620 ピックアップ", "応談", "SOLD OUT") + box(1, "620", "") + box(4, "サニー", "1977年")
    got = payloads.used_boxes(page(spark, body), rates).orderBy("ordinal").collect()
    assert [(r["source_listing_id"], r["price"]["amount"], r["year"], r["status"]) for r in got] == [("1", 3980000.0, 1977, "active"), ("3", None, None, "sold")]
    assert got[0]["url"] == "https://f.example/detail/%E3%83%88%E3%83%A9-used-1.html" and got[0]["images"] == ["https://i.example/1.jpg"] and got[0]["description_snippet"] == "rare"

    item = lambda i, text: f'<div class="car-item"><a href="/usedcar/detail/cc{i}"><img src="//i.example/{i}"></a> {text}</div>'
    body = item("AB1", "日産 ダットサン  トラック MT 支払総額 130.5万円 年式 1978年") + item("AB2", "日産 トラック 応談 年式 1999年") + item("AB3", "日産 応談") + item("AB1", "again 年式 1978年")
    got = payloads.car_items(page(spark, body), rates).collect()
    assert [(r["source_listing_id"], r["title"], r["price"]["gbp"], r["url"], r["images"]) for r in got] == [("ccAB1", "日産 ダットサン トラック MT", 6525.0, "https://kuruma-ex.jp/usedcar/detail/ccAB1", ["https://i.example/AB1"])]

    cas = lambda i, year, price: f'<div class="cassette a"><a href="/usedcar/detail/{i}/index.html"></a><h3 class="cassetteMain__title">ダットサン <i>620</i></h3><p class="totalPrice__content">応談</p><p class="basePrice__content">{price}</p><dl class="specList">年式 {year} (S53)</dl><img data-src="//i.example/c"><p class="cassetteSub__area">東京</p></div>'
    got = payloads.cassettes(page(spark, cas("AU1", 1978, "1 20 .5 万円") + cas("AU2", 2001, "5万円") + cas("AU1", 1979, "7万円")), rates).collect()
    assert [(r["source_listing_id"], r["title"], r["year"], r["price"]["amount"], r["region"]) for r in got] == [("AU1", "ダットサン 620", 1978, 1205000.0, "東京")]
    assert payloads.cassettes(page(spark, cas("AU1", 2001, "") + cas("AU1", 1978, "")), rates).count() == 0  # the first card of an id counts, and fails the gate

    row = lambda i, first, more="": f'<li><a href="/usedcars/NISSAN/DATSUN_TRUCK/{i}/"><h3 class="title">DATSUN  TRUCK</h3></a><ul class="details"><li>{first}</li><li>{more}</li></ul><p class="price">¥ 1,250,000</p><div class="photo"><img src="https://i.example/g"></div><p class="location">Osaka</p></li>'
    body = f'<ul class="list-listview">{row(1, "1978.03", "Left")}{row(2, "1983")}{row(3, "1975")}{row(3, "1975")}</ul>'
    got = payloads.list_view(page(spark, body), rates).orderBy("ordinal").collect()
    assert [(r["source_listing_id"], r["drive_side"], r["price"]["amount"], r["region"]) for r in got] == [("1", "LHD", 1250000.0, "Osaka"), ("3", "RHD", 1250000.0, "Osaka"), ("3", "RHD", 1250000.0, "Osaka")]
    for parse, need in ((payloads.used_boxes, "usdbox"), (payloads.car_items, "car-item"), (payloads.cassettes, "cassette"), (payloads.list_view, "list-listview")):
        with pytest.raises(Exception, match=need):
            parse(page(spark, "<html></html>"), rates).collect()


def test_auction_searches(spark, rates):
    li = lambda i, title, price=None: f'<li class="Product"><a class="Product__titleLink" data-auction-id="{i}" data-auction-title="{title}" {f"data-auction-price={price}" if price else ""} data-auction-img="https://i.example/{i}">t</a></li>'
    opened = li("a", "ダットサン 620 実働", 900000) + li("b", "620用テールランプ", 900000) + li("c", "ダットサン 620 スロットカー", 6666) + li("d", "ダットサン 620") + '<li class="Product">ad</li>'
    scoped = li("a", "ダットサン 620 実働", 1) + li("e", "ダットサントラック 昭和52年 新品ホイール", 50) + li("f", "ダットサントラック D21 昭和52年") + li("g", "ダットサントラック")
    item = lambda i, path, price: {"auctionId": i, "title": "ダットサン 620", "price": price, "imageUrl": "https://i.example/s", "categoryPath": [{"name": x} for x in path]}
    closed = state({"props": {"pageProps": {"initialState": {"search": {"items": {"listing": {"items": [item("x", ["自動車", "中古車・新車"], 500000), item("y", ["パーツ"], 1), item("a", ["中古車"], 3)]}}}}}}})
    got = payloads.all_auctions(page(spark, ("open", opened), ("vehicle", scoped), ("closed", closed)), rates).orderBy("ordinal").collect()
    assert [(r["source_listing_id"], r["status"], r["price"]["amount"], r["year"]) for r in got] == [("a", "active", 900000.0, None), ("d", "active", None, None), ("e", "active", 50.0, 1977), ("x", "sold", 500000.0, None)]
    with pytest.raises(ValueError, match="canary"):
        payloads.all_auctions(page(spark, ("open", "<html>"), ("closed", state({"props": {}}))), rates)


def test_page_ads(spark, rates):
    ad = lambda i, title, price: {"id": i, "title": title, "price": price, "image": "https://i.example/k", "location": "เชียงใหม่"}
    body = state({"props": {"pageProps": {"ads": [ad(1, "Datsun truck 620 ปี 2520", 150000), ad(2, "datsun big m กระบะ", 1), ad(3, "ดัทสัน ช้างเหยียบ 1978", 0), ad(None, "datsun truck", 1), ad(4, "datsun sunny", 1)]}}})
    got = payloads.page_ads(page(spark, body, body), rates).orderBy("ordinal").collect()
    assert [(r["id"], r["price"]["amount"], r["year"], r["drive_side"]) for r in got] == [("kaidee:1", 150000.0, None, "RHD"), ("kaidee:3", None, 1978, "RHD")]
    with pytest.raises(Exception, match="no ad"):
        payloads.page_ads(page(spark, state({"props": {"pageProps": {"ads": []}}})), rates).collect()


def test_elements(spark):
    df = spark.createDataFrame([("u", "<div class='a b'><p>x <b>y</b><br>z<p class=q>w</div></p><div class=a><script>no</script></div>")], "url string, body string")
    got = html.elements(df, "div.a", {"all": ".", "first": "p", "q": "p.q", "every": "p*", "none": "i", "mark": ".@class~b"}).orderBy("pos").collect()
    assert [(r["pos"], r["all"], r["first"], r["q"], r["none"], r["mark"]) for r in got] == [(0, "x y z w", "x y z w", "w", None, "a b"), (1, "", None, None, None, None)]
    assert html.elements(df.select("url", F.lit(None).cast("string").alias("body")), "p", {"t": "."}).count() == 0


def test_plans(spark):
    markets = spark.createDataFrame([("EBAY_US", "US"), ("EBAY_GB", "GB")], "market string, country string").coalesce(1)
    queries = spark.createDataFrame([("datsun truck 620",), ("620 truck",)], "query string").coalesce(1)
    got = plan.market_plan(markets, queries).orderBy("turn").collect()
    assert [(r["turn"], r["market"], r["query"], r["limit"]) for r in got] == [(0, "EBAY_US", "datsun truck 620", 200), (1, "EBAY_US", "620 truck", 200), (2, "EBAY_GB", "datsun truck 620", 200), (3, "EBAY_GB", "620 truck", 200)]
    got = plan.search_plan(spark, [("open", "https://s.example/?p={}", ["ダ 620"]), ("closed", "https://c.example/{}", ["a/b"])]).orderBy("turn").collect()
    assert [(r["turn"], r["kind"], r["url"]) for r in got] == [(0, "open", "https://s.example/?p=%E3%83%80%20620"), (1, "closed", "https://c.example/a%2Fb")]


def test_landed(spark, tmp_path):
    (tmp_path / "ebay").mkdir()
    (tmp_path / "ebay" / "00-us.json").write_text(API(ITEM()))
    (tmp_path / "ebay" / "01-gb.json").write_text("HTTP 503")
    rows, note = registry.answered(registry.landed(spark, str(tmp_path), "ebay"), "ebay")
    assert [(r["turn"], r["kind"]) for r in rows.collect()] == [(0, "us")] and note == "1 of 2 requests failed"
    with pytest.raises(ValueError, match="all 1 requests failed"):
        registry.answered(page(spark, "<html>blocked"), "kaidee")


def test_partial_failures_and_canary(spark, rates):
    """One empty page of several is a note; a source without a single item is a failure that ages nothing."""
    ads = state({"props": {"pageProps": {"ads": [{"id": 5, "title": "Datsun truck 620", "price": 90000}]}}})
    none = state({"props": {"pageProps": {"ads": []}}})
    only = {k: registry.SOURCES[k] for k in ("ebay", "kaidee")}
    pages = {"ebay": page(spark, API(), API(), "HTTP 500"), "kaidee": page(spark, none, ads)}
    rows, log = registry.collect(spark, pages.get, rates, only)
    got = {r["source"]: (r["ok"], r["records"], r["note"]) for r in log.collect()}
    assert got == {"ebay": (False, 0, "canary: no item in 2 answers"), "kaidee": (True, 1, "1 of 2 requests failed")} and [r["id"] for r in rows.collect()] == ["kaidee:5"]
    pages = {"ebay": page(spark, API(ITEM(title="nothing that passes a gate")), API()), "kaidee": page(spark, none, none)}
    _, log = registry.collect(spark, pages.get, rates, only)
    got = {r["source"]: (r["ok"], r["records"], r["note"]) for r in log.collect()}
    assert got == {"ebay": (True, 0, ""), "kaidee": (False, 0, "all 2 requests failed")}


def test_pages_as_a_data_source(spark, rates, tmp_path):
    """A partition for each landed page; failures are rows of their own; the reader takes the limit; collect reads it."""
    for name, text in {"ebay/00-us.json": API(ITEM(), ITEM(itemId="2")), "ebay/01-gb-trucks.json": "HTTP 503 busy", "ebay/02-de.json": " ", "kaidee/00.html": "<html>blocked", "kaidee/01-x.html": b"\xff\xfe\xff"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)
    got = {(r["source"], r["turn"]): r for r in landed_pages.pages(spark, str(tmp_path), "ebay").collect()}
    assert {k: (r["kind"], r["country"], r["query"], r["error"]) for k, r in got.items()} == {("ebay", 0): ("us", "US", None, None), ("ebay", 1): ("gb", "GB", "trucks", "HTTP 503"), ("ebay", 2): ("de", "DE", None, "empty answer")}
    assert len(json.loads(landed_pages.pages(spark, str(tmp_path), "ebay", limit=1).filter("turn = 0").first()["body"])["itemSummaries"]) == 1
    every = spark.read.format("landed_pages").option("path", str(tmp_path)).load()
    assert every.rdd.getNumPartitions() == 5 and every.filter("error is not null").count() == 3
    only = {k: registry.SOURCES[k] for k in ("ebay", "kaidee", "flex")}
    rows, log = registry.collect(spark, lambda s: landed_pages.pages(spark, str(tmp_path), s), rates, only)
    assert {r["id"] for r in rows.collect()} == {"ebay:1", "ebay:2"}
    assert {r["source"]: (r["ok"], r["note"]) for r in log.collect()} == {"ebay": (True, "2 of 3 requests failed"), "kaidee": (False, "all 2 requests failed"), "flex": (False, "all 0 requests failed")}


def test_collect_isolates_sources(spark, rates):
    assert len(registry.SOURCES) == 13
    pages = {"ebay": page(spark, API(ITEM(), ITEM(itemId="2", itemWebUrl="javascript:1"))), "kaidee": page(spark, "<html>blocked")}
    rows, log = registry.collect(spark, lambda name: pages.get(name) if name in pages else page(spark, "nothing"), rates)
    assert [r["id"] for r in rows.collect()] == ["ebay:1"]
    got = {r["source"]: (r["ok"], r["records"], r["note"]) for r in log.collect()}
    assert got["ebay"] == (True, 1, "1 invalid record(s) dropped") and got["kaidee"] == (False, 0, "all 1 requests failed")
    assert list(got) == list(registry.SOURCES) and got["hemmings"] == (True, 0, "") and not got["flex"][0]


def test_daily_runs(spark, tmp_path):
    """Three days: a first run, a price change with a failing source and no rates, and another run on the same day."""
    root = str(tmp_path)
    day = lambda d, usd: spark.createDataFrame([(d, datetime(2026, 1, 1), "GBP", dict.fromkeys(fx.SYMBOLS, 2.0) | {"USD": usd, "JPY": 200.0, "CAD": 1.7, "THB": 45.0})], FX)
    ads = state({"props": {"pageProps": {"ads": [{"id": 5, "title": "Datsun truck 620 กระบะ ダ", "price": 90000}]}}})
    only = {k: registry.SOURCES[k] for k in ("ebay", "kaidee")}
    one = daily.run_daily(spark, root, "2026-01-01", lambda n: page(spark, API(ITEM()) if n == "ebay" else ads), day(date(2026, 1, 1), 1.25), only, translate=lambda t: F.concat(t, F.lit(" (en)")))
    assert {r["id"]: r["title_translated"] for r in one.store.collect()} == {"ebay:1": None, "kaidee:5": "Datsun truck 620 กระบะ ダ (en)"} and one.changes.new.count() == 2
    (tmp_path / "listings" / "version=2026-01-02" / "_temporary").mkdir(parents=True)  # a run that died
    bad = spark.createDataFrame([(date(2026, 1, 2), datetime(2026, 1, 2), "GBP", {"USD": 1.0, "JPY": 1.0})], FX)
    two = daily.run_daily(spark, root, "2026-01-02", lambda n: page(spark, API(ITEM(price={"value": "6000", "currency": "USD"})) if n == "ebay" else "blocked"), bad, only)
    assert [(r["id"], r["old_gbp"], r["new_gbp"], r["pct"]) for r in two.changes.price_changed.collect()] == [("ebay:1", 4000.0, 4800.0, 20.0)]
    assert {r["source"]: r["consecutive_failures"] for r in two.log.collect()} == {"ebay": 0, "kaidee": 1}
    again = daily.run_daily(spark, root, "2026-01-02", lambda n: page(spark, API(ITEM(price={"value": "6000", "currency": "USD"})) if n == "ebay" else "blocked"), None, only, run="2026-01-02b")
    assert again.changes.price_changed.count() == again.changes.new.count() == 0
    assert {r["source"]: r["consecutive_failures"] for r in again.log.collect()} == {"ebay": 0, "kaidee": 2}
    kept = store.read_or_empty(spark, f"{root}/listings/version=2026-01-02b", LISTING)
    assert sorted(map(str, kept.collect())) == sorted(map(str, store.read_or_empty(spark, f"{root}/listings/version=2026-01-02", LISTING).collect()))
    total = again.totals.first()
    assert (total["active"], total["by_country"]) == (2, {"TH": 1, "US": 1})
    line = daily.summary(two.log, two.totals, {"new": two.changes.new, "price_changed": two.changes.price_changed}, "2026-01-01").first()
    assert line["line"] == "run complete: fx 2026-01-01, sources ok 1/2, active 2, new 0, price changes 1"
    assert sorted(r["line"] for r in daily.catches(one.changes.new, one.store).collect())[0] == "new: ebay:1 | 1978 Datsun truck 620 truck | 5000.0 USD | https://m.example/1"
    assert {r["source"]: r["line"] for r in report.health_lines(again.log).collect()} == {"ebay": "ebay: 1 listing(s)", "kaidee": "kaidee: skipped — all 1 requests failed (2 days running)"}
    assert "By country: TH: 1, US: 1" in report.summary_lines(two.totals, "2026-01-02T04:17:00+00:00").first()["line"]
    assert report.counts(one.changes.new, one.changes.price_changed, one.store).first().asDict() == {"matched": 0, "new": 2, "price changes": 0}
    page_ = report.render({"New": report.new_listings(one.changes.new, one.changes.possible_relists, one.store)}, "d", most=1)
    assert "New (2)" in page_ and "and 1 more" in page_ and page_.count("<li>") == 1
    counted = report.counts(one.changes.new, one.changes.price_changed, one.store)
    assert report.digest_subject("Lots", counted, "d") == "Lots: 2 new, 0 price change(s) — d"
    assert report.digest_subject("Lots", counted.withColumn("matched", F.lit(1)), "d") == "Lots: 1 KING CAB of 2 new, 0 price change(s) — d"
    assert report.digest_subject("Lots", counted.withColumns({"new": F.lit(0), "price changes": F.lit(0)}), "d") == "Lots digest — d"
    shown = {r["id"]: r for r in report.listing_pages(two.store).collect()}
    assert shown["ebay:1"]["page"] == "ebay--1" and shown["ebay:1"]["history"] == ["2026-01-01 · active · $5,000 · £4,000 · first seen", "2026-01-02 · active · $6,000 · £4,800 · latest"]
    assert [(str(c["date"]), c["gbp"]) for c in shown["ebay:1"]["chart"]] == [("2026-01-01", 4000.0), ("2026-01-02", 4800.0)] and shown["kaidee:5"]["chart"] is None and shown["kaidee:5"]["prior_page"] is None
    with pytest.raises(ValueError, match="no rates"):
        daily.run_daily(spark, root + "/none", "2026-01-01", lambda n: page(spark, "x"), None, only)
    parsed = fx.parsed(spark.createDataFrame([('{"date": "2026-01-01", "base": "GBP", "rates": {"USD": 1.2}}', datetime(2026, 1, 1))], "body string, fetched_at timestamp"))
    assert parsed.first()["rates"] == {"USD": 1.2} and parsed.columns == ["date", "fetched_at", "base", "rates"]


def test_parts_are_dealt_out(spark):
    """Pages made of one small file are read by more than one task."""
    from lotwatch.plans import rendered

    assert rendered.parts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
