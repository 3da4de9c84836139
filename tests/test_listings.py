"""Scalars, rules, parsers, reconcile, relists, reports and the stream, on rows made by hand."""

import json
import random
import re
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lotwatch.functions import classify, display, normalize
from lotwatch.operators import browse, fx, relist, report, runlog, specs, validate
from lotwatch.operators.reconcile import reconcile
from lotwatch.schemas import INCOMING, LISTING
from lotwatch.sources import legacy, store
from lotwatch.streaming.reconciling import merge_batch, stream

RATES = "currency string, rate double, date date"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def incoming(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        amount = r.get("amount", 12500.0)
        price = {"amount": amount, "currency": "GBP", "gbp": amount, "fx_rate": 1.0, "fx_date": date(2026, 1, 1)}
        full = {"source": r["id"].split(":")[0], "source_listing_id": r["id"], "url": "https://x.example/1", "title": r.get("title", "1978 pickup king cab"), "title_translated": r.get("tt"), "country": "US", "drive_side": "LHD", "price": price, "images": r.get("images", []), "status": r.get("status", "active"), "king_cab": {"matched": True, "matched_terms": ["king cab"], "body_style_check": "unavailable"}}
        out.append((i, full | {"id": r["id"]}))
    schema = f"{INCOMING}, ordinal bigint"
    names = [c.split()[0] for c in "id source source_listing_id url title title_translated description_snippet region year country drive_side king_cab price images status".split()]
    return spark.createDataFrame([tuple(f.get(n) for n in names) + (i,) for i, f in out], schema)


def sources(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source string")


def empty(spark):
    return spark.createDataFrame([], LISTING)


@pytest.mark.parametrize(("value", "code"), [("uk", "UK"), (" japan ", "JP"), ("Elsewhere", "XX"), ("", "XX"), (None, "XX"), ("ไทย", "TH")])
def test_country(spark, value, code):
    assert one(spark, normalize.country_code(F.lit(value).cast("string"))) == code


@pytest.mark.parametrize(("title", "year"), [("a 1978 truck", 1978), ("1970 then 1978", None), ("1978年式", None), ("昭和52年 truck", 1977), ("19788", None), (None, None)])
def test_year(spark, title, year):
    assert one(spark, normalize.year_of_era(F.lit(title).cast("string"))) == year


def test_classify(spark):
    check = lambda t: one(spark, classify.looks_like_part(F.lit(t)))
    wanted = lambda t: one(spark, classify.wanted(F.lit(t)))
    assert check("Grille for Datsun") and check("start of something") and check("vintage AD 1977")
    assert not check("1978 Datsun truck 620 pickup")
    k = one(spark, classify.keywords(F.lit("King"), F.lit("cab for sale"), F.lit("Crew Cab")))
    assert k["matched_terms"] == ["king cab"] and not k["matched"] and k["body_style_check"] == "fail"
    assert wanted("datsun กระบะ ปี 2520") and not wanted("datsun 720 truck") and not wanted("datsun big m truck") and not wanted("Datsun Navara pickup") and not wanted("datsun 1500 จูเนียร์")
    title = lambda t: one(spark, classify.auction_title(F.lit(t)))
    assert title("ダットサン 620 実働") and not title("620用テールランプ") and not title("620 521 truck") and not title("S620x")
    scoped = lambda t, y: one(spark, classify.scoped_title(F.lit(t), F.lit(y).cast("int")))
    assert scoped("620 新品ホイール", None) and scoped("ダットサントラック", 1977) and not scoped("ダットサントラック", None) and not scoped("ダットサントラック D21", 1977)
    assert one(spark, classify.over_floor(F.lit(None).cast("double"))) and not one(spark, classify.over_floor(F.lit(6666.0)))
    assert one(spark, classify.in_vehicle_tree(F.array(F.lit("自動車"), F.lit("中古車・新車")))) and not one(spark, classify.in_vehicle_tree(F.lit(None).cast("array<string>")))


def test_urls_and_texts(spark):
    assert one(spark, normalize.percent_encoded(F.lit("ダットサン 620*~"))) == "%E3%83%80%E3%83%83%E3%83%88%E3%82%B5%E3%83%B3%20620%2A~"
    assert one(spark, normalize.percent_encoded(F.lit("https://x.jp/detail/トラ-used-1.html?a=b&c=%20"), normalize.SAFE)) == "https://x.jp/detail/%E3%83%88%E3%83%A9-used-1.html?a=b&c=%20"
    assert [one(spark, normalize.absolute(F.lit(u), "https://b.jp")) for u in ("//i.jp/1", "/d/1", "http://x")] == ["https://i.jp/1", "https://b.jp/d/1", "http://x"]
    assert one(spark, normalize.before_labels(F.lit("日産 トラック 支払総額 130万円 年式"), "支払総額|年式")) == "日産 トラック "
    assert one(spark, normalize.slug_of_title(F.lit("1974 Datsun truck 620"))) == "1974-datsun-truck-620"
    shown = lambda a, c, g: one(spark, display.site_money(F.lit(a).cast("double"), F.lit(c), F.lit(g).cast("double")))
    assert shown(1234567.5, "USD", 99.5) == "$1,234,567.5 · £100" and shown(1200.0, "GBP", 1200.0) == "£1,200" and shown(5.0, "XYZ", None) == "XYZ 5" and shown(None, "USD", None) == "no price shown"
    assert one(spark, display.clock(F.lit("2026-01-02T04:17:09+00:00"))) == "04:17" and one(spark, display.clock(F.lit(""))) == ""
    assert [one(spark, display.body_type(F.lit(n), F.lit(b))) for n, b in (("King Cab (long)", None), ("x", "tray back"), ("a (king)", "long bed"), ("UK", "long wheelbase"))] == ["King Cab", "Ute", "Long bed", "Standard cab"]


def test_rates(spark):
    day = spark.createDataFrame([(date(2026, 1, 1), "GBP", {"USD": 1.25, "EUR": 1.1, "XXX": 1.0})], "date date, base string, rates map<string,double>")
    assert sorted(fx.checked(day, ["USD", "EUR"]).first()["rates"]) == ["EUR", "USD"]
    with pytest.raises(Exception, match="rates are missing: JPY"):
        fx.checked(day, ["USD", "JPY"]).collect()
    log = fx.upsert(day, day.withColumn("base", F.lit("new")))
    assert [r["base"] for r in log.collect()] == ["new"] and fx.latest(log).first()["base"] == "new"


def test_reconcile_days(spark):
    a = incoming(spark, {"id": "ebay:1"}, {"id": "ebay:2"}, {"id": "kaidee:1"})
    first = reconcile(empty(spark), a, sources(spark, "ebay", "kaidee"), "2026-01-01")
    assert first.new.count() == 3 and first.price_changed.count() == 0
    b = incoming(spark, {"id": "ebay:1", "amount": 13000.0, "tt": "x"})
    second = reconcile(first.store, b, sources(spark, "ebay"), "2026-01-02")
    assert [tuple(r) for r in second.price_changed.collect()] == [("ebay:1", 12500.0, 13000.0, 4.0)]
    kept = {r["id"]: r for r in second.store.collect()}
    assert len(kept["ebay:1"]["history"]) == 2 and kept["ebay:1"]["title_translated"] == "x" and kept["ebay:1"]["first_seen"] == date(2026, 1, 1)
    again = reconcile(second.store, b, sources(spark, "ebay"), "2026-01-02")
    assert again.new.count() == again.price_changed.count() == again.status_changed.count() == 0
    assert sorted(map(str, again.store.collect())) == sorted(map(str, second.store.collect()))
    later = reconcile(second.store, b, sources(spark, "ebay"), "2026-01-05")
    assert [tuple(r) for r in later.status_changed.collect()] == [("ebay:2", "active", "withdrawn")]  # t wasn't seen
    gone = {r["id"]: r for r in later.store.collect()}["ebay:2"]
    assert gone["status"] == "withdrawn" and gone["history"][-1]["price"] is None
    back = reconcile(later.store, incoming(spark, {"id": "ebay:2"}), sources(spark, "ebay"), "2026-01-06")
    assert [tuple(r) for r in back.status_changed.collect()] == [("ebay:2", "withdrawn", "active")]


def test_reconcile_repeated_id(spark):
    rows = incoming(spark, {"id": "ebay:1"}, {"id": "ebay:1", "amount": 10000.0})
    out = reconcile(empty(spark), rows, sources(spark, "ebay"), "2026-01-01")
    assert out.new.count() == 1 and out.price_changed.count() == 1 and out.store.count() == 1


def test_relist(spark):
    sold = reconcile(empty(spark), incoming(spark, {"id": "ebay:1", "status": "sold"}), sources(spark, "ebay"), "2026-01-01").store
    out = reconcile(sold, incoming(spark, {"id": "ebay:9", "amount": 12900.0}, {"id": "ebay:8", "title": "something else"}), sources(spark, "ebay"), "2026-01-09")
    found = out.possible_relists.collect()
    assert [(r["id"], r["prior_id"]) for r in found] == [("ebay:9", "ebay:1")]
    assert found[0]["reasons"] == ["title similarity 1.00", "same country (US)", "price within 3%"]
    shown = report.new_listings(out.new, out.possible_relists, out.store)
    assert [r["id"] for r in shown.collect()] == ["ebay:8"]
    page = report.render({"New": shown, "Gone": report.status_changes(out.status_changed, out.store)}, "2026-01-09")
    assert "New (1)" in page and "Gone" not in page
    assert report.subject({"new": 1, "sold": 0}, "d") == "Listings d: 1 new"


def test_validate_and_runlog(spark):
    rows = incoming(spark, {"id": "ebay:1"}, {"id": "BAD"}, {"id": "kaidee:1", "status": "odd"})
    good, bad = validate.split(rows)
    assert [r["id"] for r in good.collect()] == ["ebay:1"] and bad.count() == 2
    counts = validate.source_counts(rows)
    assert {r["source"] for r in validate.seen_sources(counts).collect()} == {"ebay"}
    log = spark.createDataFrame([("s", True), ("t", False)], "source string, ok boolean")
    before = spark.createDataFrame([("t", 6)], "source string, consecutive_failures bigint")
    after = runlog.with_streaks(log, before)
    assert {r["source"]: r["consecutive_failures"] for r in after.collect()} == {"s": 0, "t": 7}
    assert runlog.health(after.withColumn("note", F.lit(""))).first()["level"] == "escalate"
    held = reconcile(empty(spark), rows, sources(spark, "ebay"), "2026-01-01").store
    t = runlog.totals(held).first()
    assert (t["active"], t["median_gbp"], t["by_country"]) == (2, 12500.0, {"US": 2})


def test_legacy(spark):
    def row(i, **given):
        base = {"source": "bring-a-trailer", "source_url": "https://x.example/1", "title": "1978 King Cab", "price_original": 100.0, "currency": "USD", "price_gbp": 80.0, "fx_rate_used": 1.25, "fx_date": date(2026, 1, 1), "country": "Japan", "drive_side": "RHD", "year": 1978, "king_cab_signals": [], "first_seen": date(2026, 1, 1), "last_seen": date(2026, 1, 5), "price_history": [(date(2026, 1, 1), 100.0, 80.0)], "status": "sold"}
        full = base | {"id": i} | given
        return tuple(full.get(c.split()[0]) for c in re.split(r", (?![^<]*>)", legacy.FLAT))

    flat = spark.createDataFrame([row("bring-a-trailer-77"), row("other-9", price_history=None, currency=None, drive_side=None, fx_date=None, country="Elsewhere"), row("bring-a-trailer-1", status="active", price_history=[])], legacy.FLAT)
    out = legacy.imported(empty(spark), flat)
    got = {r["source_listing_id"]: r for r in out.collect()}
    assert set(got) == {"77", "other-9", "1"} and got["77"]["id"] == "bring-a-trailer:77" and got["77"]["country"] == "JP"
    assert [h["status"] for h in got["77"]["history"]] == ["active", "sold"] and got["77"]["king_cab"]["matched"]
    assert [(h["status"], h["price"]) for h in got["other-9"]["history"]] == [("sold", None)]
    assert (got["other-9"]["price"]["currency"], got["other-9"]["drive_side"], got["other-9"]["price"]["fx_date"], got["other-9"]["country"]) == ("USD", "unknown", date(2026, 1, 1), "XX")
    assert [(h["status"], h["price"]["amount"]) for h in got["1"]["history"]] == [("active", 100.0)]
    assert legacy.imported(out, flat).count() == 3


def test_browse(spark):
    rows = spark.createDataFrame([("a", "active", 10.0, 1978, date(2026, 1, 1), date(2026, 1, 1)), ("b", "active", 0.0, None, date(2026, 1, 2), date(2026, 1, 2)), ("c", "sold", 5.0, 1975, date(2026, 1, 1), date(2026, 1, 3))], "id string, status string, gbp double, year int, first_seen date, last_seen date")
    place = lambda **k: sorted((r["section"], r["place"], r["id"]) for r in browse.browse(rows, **k).collect())
    assert place(sort="price-desc") == [("active", 1, "a"), ("active", 2, "b"), ("ended", 1, "c")]
    assert place() == [("active", 1, "b"), ("active", 2, "a"), ("ended", 1, "c")]
    assert place(first=1) == [("active", 1, "b"), ("ended", 1, "c")]
    many = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "sold").otherwise("active").alias("status"), (F.col("id") % 17).cast("double").alias("gbp"), F.lit(1978).alias("year"), F.lit(date(2026, 1, 1)).alias("first_seen"), F.lit(date(2026, 1, 1)).alias("last_seen"))
    want = sorted((("ended" if i % 3 == 0 else "active"), i % 17 == 0, i % 17, str(i)) for i in range(1000))
    got = sorted(browse.browse(many, "price-asc").collect(), key=lambda r: (r["section"], r["place"]))
    assert [r["id"] for r in got] == [w[3] for w in want] and [r["place"] for r in got if r["section"] == "ended"] == list(range(1, 335))
    assert place(price_max=0) == [] and place(year_min=1976) == [("active", 1, "a")]


def test_stream(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    days = [incoming(spark, {"id": "ebay:1"}, {"id": "ebay:2"}), incoming(spark, {"id": "ebay:1", "amount": 9000.0})]
    for n, d in enumerate(days):
        d.drop("ordinal").coalesce(1).write.mode("append").parquet(landing)
        # What a batch that died midway leaves: a folder without the mark of its end.
        (tmp_path / "root" / "listings" / f"version={n}" / "_temporary").mkdir(parents=True)
        stream(spark, landing, root, lambda n: f"2026-01-{1 + 4 * n:02d}").awaitTermination()
        assert store.is_complete(spark, f"{root}/listings/version={n}")
    last = {r["id"]: r for r in store.read_or_empty(spark, f"{root}/listings/version=1", LISTING).collect()}
    assert last["ebay:1"]["price"]["amount"] == 9000.0 and last["ebay:2"]["status"] == "withdrawn"
    assert spark.read.parquet(f"{root}/price_changes").count() == 1
    with pytest.raises(ValueError, match="is there already"):
        store.write_store(spark.createDataFrame([], LISTING), root, "1")
    # A batch that is run again changes nothing.
    merge_batch(root, lambda n: "2026-01-05")(days[1].drop("ordinal"), 1)
    assert {r["id"]: r for r in store.read_or_empty(spark, f"{root}/listings/version=1", LISTING).collect()} == last
    assert [r["id"] for r in store.newest_first(store.read_or_empty(spark, f"{root}/listings/version=1", LISTING)).collect()] == ["ebay:2", "ebay:1"]


def test_relists_meet_all_pairs(spark):
    """Meeting by country and by steps of price and length loses no pair."""
    rng = random.Random(3)
    rows = [{"id": f"ebay:{i}", "title": " ".join(rng.choice(["king", "cab", "old"]) for _ in range(rng.randint(1, 4))), "amount": round(10 ** rng.uniform(2, 5), 2), "status": "sold" if i % 2 else "active"} for i in range(120)]
    frame = incoming(spark, *rows).withColumn("country", F.when(F.col("ordinal") % 5 == 0, "XX").when(F.col("ordinal") % 5 == 1, "US").otherwise(F.concat(F.lit("C"), (F.col("ordinal") % 9).cast("string"))))
    country = {r["id"]: r["country"] for r in frame.collect()}
    want = {}
    for i, n in enumerate(rows):
        best = None
        for j, o in enumerate(rows):
            ratio = SequenceMatcher(None, o["title"], n["title"]).ratio()
            same = country[o["id"]] != "XX" and country[o["id"]] == country[n["id"]]
            if n["status"] == "active" and o["status"] == "sold" and j < i and ratio >= 0.75 and (same or abs(n["amount"] - o["amount"]) / o["amount"] * 100 <= 15) and (best is None or ratio > best[0]):
                best = (ratio, o["id"])
        if best:
            want[n["id"]] = best[1]
    got = relist.relists(frame.filter("status = 'active'"), empty(spark), frame).collect()
    assert {r["id"]: r["prior_id"] for r in got} == want and len(want) > 10 and len(got) == len(want)


def test_merge_looks_for_no_relists(spark, monkeypatch):
    """Relists are a search of their own: changes and the merged store come without it, and the store's marks with it."""
    monkeypatch.setattr("lotwatch.operators.reconcile.relists", lambda *a: pytest.fail("relists were looked for"))
    rows = incoming(spark, {"id": "ebay:1", "title": "a", "status": "sold"}, {"id": "ebay:2", "title": "a"})
    out = reconcile(empty(spark), rows, rows.select("source"), "2026-01-01")
    assert out.new.count() == 2 and out.merged.filter("not relist.possible").count() == 2
    assert out.merged.columns == empty(spark).columns


def test_percent_rounds_by_binary_value(spark):
    """SQL rounds (257.64 - 80) / 80 * 100, which is 222.04999999999998, to 222.1."""
    assert one(spark, normalize.to_tenth((F.col("new") - F.col("old")) / F.col("old") * 100), old=80.0, new=257.64) == 222.1


def test_specs(spark):
    v = {"id": "us-1", "name": "King Cab (1977)", "years": {"from": 1977, "to": 1979}, "body": None, "engine": {"code": "L20B", "codes": None, "displacement_cc": 1952, "power_hp": 97.0}, "dimensions_mm": {"length": 4690}, "weight_kg": 1180.0, "colors": [{"name": "Blue", "hex": None}]}
    w = {"id": "jp-1", "name": "Standard", "years": {"from": 1972, "to": 1973}, "engine": {"code": None, "codes": ["J15", "J13"]}}
    body = json.dumps({"version": "1", "markets": [{"market": "US", "name": "United States", "variants": [v]}, {"market": "JP", "name": "Japan", "variants": [w]}]})
    rows = specs.variants(spark.createDataFrame([(body,)], "b string").select(F.from_json("b", specs.SPECS).alias("s")).select("s.*"))
    pick = lambda **k: [r["id"] for r in rows.filter(specs.matches(**k)).collect()]
    assert pick() == ["us-1", "jp-1"] and pick(year=1978) == ["us-1"] and pick(engine="J13") == ["jp-1"] and pick(region="JP", colour="Blue") == [] and pick(body="King Cab") == ["us-1"]
    got = {r["id"]: r for r in specs.shown(rows).collect()}
    assert [got["us-1"][k] for k in ("years", "body", "engine", "power", "length", "weight", "colours")] == ["1977–1979", "—", "L20B, 2.0L", "97 hp", "4690 mm", "1180 kg", "1 documented"]
    assert [got["jp-1"][k] for k in ("engine", "power", "colours", "confidence")] == ["not verified", "—", "—", "—"]
    assert {(r["facet"], r["value"]) for r in specs.facets(rows).collect()} == {("body", "King Cab"), ("body", "Standard cab"), ("engine", "L20B"), ("engine", "J13"), ("engine", "J15"), ("colour", "Blue")}
    assert rows.filter("id = 'us-1'").first()["engine_line"] == "L20B, 2.0L, 97 hp"
    side = {r["field"]: r for r in browse.compare(specs.shown(rows), "id", "us-1", "jp-1", list(specs.ROWS)).collect()}
    assert side["years"]["differs"] and not side["power"]["differs"] and len(side) == 13


def test_rates_as_of(spark):
    rates = spark.createDataFrame([("USD", date(2026, 1, 2), 1.2), ("USD", date(2026, 1, 5), 1.3), ("USD", date(2026, 1, 5), None), ("EUR", date(2026, 1, 9), 1.1)], "ccy string, day date, rate double")
    df = spark.createDataFrame([(i, c, date(2026, 1, d)) for i, (c, d) in enumerate([("USD", 1), ("USD", 2), ("USD", 4), ("USD", 5), ("USD", 30), ("EUR", 8), ("EUR", 9), ("XXX", 9)])], "i int, ccy string, day date")
    assert [r["rate"] for r in fx.as_of(df, rates, "ccy", "day", "rate").orderBy("i").collect()] == [None, 1.2, 1.2, 1.3, 1.3, None, 1.1, None]
    assert fx.as_of(df.limit(0), rates, "ccy", "day", "rate").count() == 0


def test_relists_broadcast_no_exploded_side_and_compare_titles_once(spark):
    """Rows that prices spread over steps are never broadcast, and likeness runs on distinct pairs of titles only, once."""
    rows = [(f"e:{i}", "s", ("blue ring", "blue rings", "old plate")[i % 3], "XX", (900.0 + i,), i, None, "sold" if i % 2 else "active") for i in range(60)]
    schema = "id string, source string, title string, country string, price struct<amount:double>, ordinal long, first_seen date, status string"
    one = spark.createDataFrame(rows, schema)
    out = relist.relists(one.filter("status = 'active'"), one.limit(0), one)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin [source" in x for x in plan.splitlines())
    assert plan.count("ArrowEvalPython [likeness") == 1
    found = {r["id"]: r for r in out.collect()}
    assert set(found) == {f"e:{i}" for i in range(4, 60, 2)} and all(r["similarity"] >= relist.SIMILAR for r in found.values())
