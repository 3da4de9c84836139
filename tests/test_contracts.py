"""Contracts on golden and broken documents, and medians by counts."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lotwatch import contracts
from lotwatch.operators import quantiles
from lotwatch.operators.contracts import judged, require_documents, spark_type

PRICE = {"amount": 100, "currency": "USD", "gbp": 80.5, "fx_rate": 1.25, "fx_date": "2026-01-01"}
LISTING = {
    "id": "ebay:1", "source": "ebay", "url": "https://x.example/1", "title": "t", "title_translated": None, "description_snippet": None, "year": 1978, "country": "US", "drive_side": "LHD", "king_cab": {"matched": True, "matched_terms": ["king cab"], "body_style_check": "pass"},
    "price": PRICE, "images": ["https://x.example/1.jpg"], "status": "active", "first_seen": "2026-01-01", "last_seen": "2026-01-02", "history": [{"date": "2026-01-01", "status": "active", "price": PRICE}, {"date": "2026-01-05", "status": "withdrawn"}], "relist": {"possible": False, "prior_id": None, "reasons": []},
}
DAY = {"date": "2026-01-01", "base": "GBP", "rates": {"USD": 1.2, "EUR": 1.1, "JPY": 200, "AUD": 1.9, "ZAR": 23.1}}
RUN = {"date": "2026-01-01", "started_at": "2026-01-01T04:17:00+00:00", "sources": [{"source": "ebay", "ok": True, "records": 3, "note": ""}], "totals": {"active": 3, "by_country": {"US": 3}, "median_gbp": None}}
CHANGES = {"date": "2026-01-01", "new": ["ebay:1"], "price_changed": [{"id": "a", "old_gbp": 1.5, "new_gbp": None, "pct": None}], "status_changed": [{"id": "a", "old_status": "active", "new_status": "sold"}], "possible_relists": [{"id": "a", "prior_id": "b", "reasons": ["r"]}]}
SPECS = {"version": "1", "markets": [{"market": "US", "name": "n", "variants": [{"id": "v", "name": "w", "years": {"from": 1972, "to": 1973}, "engine": {"code": "L16", "more": [1]}, "colors": [{"name": "red", "hex": "#aa0000"}], "citations": [{"ref": "r"}]}]}]}


def changed(document, path, value):
    out = json.loads(json.dumps(document))
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


BREACHES = {
    "LISTING": (LISTING, [
        (("id",), "EBAY 1", ["id:pattern"]), (("source",), "nowhere", ["source:enum"]), (("url",), "", ["url:format"]), (("title",), None, ["title:type"]), (("year",), 1990, ["year:maximum"]), (("year",), "1978", ["year:type"]), (("year",), 1978.5, ["year:type"]),
        (("description_snippet",), "x" * 501, ["description_snippet:maxLength"]), (("price", "currency"), "usd", ["price.currency:pattern"]), (("price", "extra"), 1, ["price:unknown"]), (("price", "gbp"), KeyError, ["price.gbp:required"]), (("price",), [], ["price:type"]),
        (("images",), ["https://x.example", "no link"], ["images[]:format"]), (("history", 1, "date"), "2026-02-30", ["history[].date:format"]), (("history", 0, "price", "fx_date"), KeyError, ["history[].price.fx_date:required"]), (("history", 0, "more"), 1, ["history[]:unknown"]),
        (("king_cab", "matched"), "yes", ["king_cab.matched:type"]), (("first_seen",), "1.1.2026", ["first_seen:format"]), (("status",), KeyError, ["status:required"]), (("surprise",), None, [":unknown"]), (("relist",), KeyError, []), (("year",), None, []), (("price", "amount"), None, []),
    ]),
    "RATES": ({"latest": DAY, "history": [DAY]}, [(("latest", "base"), "EUR", ["latest.base:const"]), (("history", 0, "rates", "USD"), KeyError, ["history[].rates.USD:required"]), (("latest", "rates", "THB"), "45", ["latest.rates.*:type"]), (("latest", "fetched_at"), "today", ["latest.fetched_at:format"]), (("latest", "rates", "THB"), 45, [])]),
    "CHANGES": (CHANGES, [(("new",), [1], ["new[]:type"]), (("price_changed", 0, "pct"), KeyError, ["price_changed[].pct:required"]), (("status_changed", 0, "new_status"), "gone", ["status_changed[].new_status:enum"]), (("possible_relists", 0, "similarity"), 0.8, ["possible_relists[]:unknown"])]),
    "RUN_LOG": (RUN, [(("sources", 0, "records"), -1, ["sources[].records:minimum"]), (("totals", "by_country", "US"), 1.5, ["totals.by_country.*:type"]), (("started_at",), "2026-01-01", ["started_at:format"]), (("sources", 0, "ok"), KeyError, ["sources[].ok:required"])]),
    "SPECS": (SPECS, [(("markets", 0, "market"), "XX", ["markets[].market:enum"]), (("markets", 0, "variants", 0, "citations"), [], ["markets[].variants[].citations:minItems"]), (("markets", 0, "variants", 0, "colors", 0, "hex"), "red", ["markets[].variants[].colors[].hex:pattern"]), (("markets", 0, "variants", 0, "years", "to"), KeyError, ["markets[].variants[].years.to:required"])]),
}


@pytest.mark.parametrize("name", BREACHES)
def test_contract(spark, name):
    golden, cases = BREACHES[name]
    contract = getattr(contracts, name)
    rows = [(0, json.dumps(golden))] + [(i + 1, json.dumps(changed(golden, path, value))) for i, (path, value, _) in enumerate(cases)] + [(98, "no json"), (99, None)]
    frame = spark.createDataFrame(rows, "i int, body string")
    got = {r["i"]: r["violations"] for r in judged(frame, contract, "body").collect()}
    assert got == {0: [], **{i + 1: want for i, (_, _, want) in enumerate(cases)}, 98: ["document"], 99: ["document"]}
    typed = frame.filter("i = 0").select(F.from_json("body", spark_type(contract)).alias("d")).first()["d"].asDict(recursive=True)
    assert set(typed) == set(contract["properties"])


def test_documents_of_rows(spark):
    rows = spark.createDataFrame([("a", 1.0, None, None, 7)], "id string, old_gbp double, new_gbp double, pct double, more int")
    assert require_documents(rows, contracts.PRICE_CHANGE, "changes").count() == 1
    with pytest.raises(Exception, match="changes breaks id:type"):
        require_documents(rows.withColumn("id", F.lit(None).cast("string")), contracts.PRICE_CHANGE, "changes").collect()


def test_median(spark):
    rng = random.Random(1)
    cases = [[], [None], [5.0], [1.0, 2.0], [0.0, 0.0, 7.5, None], [3.0] * 50 + [9.0], [rng.choice([1.0, 2.0, 1e300, -1e300]) for _ in range(101)], [rng.lognormvariate(0, 5) for _ in range(400)], [float(i) for i in range(-50, 50)], [1e-320, 2e-320, 5e-324, 1.0], [-1.7e308, 1.7e308, 1.0, 1.0 + 2**-52]]
    for values in cases:
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        held = [v for v in values if v is not None]
        assert quantiles.exact_median(frame, "x", ranges=4) == (pytest.approx(statistics.median(held), rel=1e-15) if held else None), values
