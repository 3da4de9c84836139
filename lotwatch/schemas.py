"""Schemas of listings, exchange rates, changes and run logs."""

from __future__ import annotations

PRICE = "struct<amount:double,currency:string,gbp:double,fx_rate:double,fx_date:date>"
KEYWORDS = "struct<matched:boolean,matched_terms:array<string>,body_style_check:string>"
HISTORY = f"array<struct<date:date,status:string,price:{PRICE}>>"
RELIST = "struct<possible:boolean,prior_id:string,reasons:array<string>>"

#: What a source's parser returns.
INCOMING = (
    "id string, source string, source_listing_id string, url string, title string, title_translated string, description_snippet string, "
    f"region string, year int, country string, drive_side string, king_cab {KEYWORDS}, price {PRICE}, images array<string>, status string"
)
#: What the store holds.
LISTING = f"{INCOMING}, first_seen date, last_seen date, history {HISTORY}, relist {RELIST}"
FX = "date date, fetched_at timestamp, base string, rates map<string,double>"
RUN_LOG = "source string, ok boolean, records bigint, note string, consecutive_failures bigint"
