"""The contracts of what is kept and exchanged: listings, rates, changes, run log and specs.

Names, enumerations, patterns and limits are fixed values: other tools read these documents.
"""

from __future__ import annotations

from lotwatch.operators.validate import BODIES, SIDES, SOURCES, STATUSES


def obj(required: list[str], **properties: dict) -> dict:
    """A closed object."""
    return {"type": "object", "required": required, "properties": properties, "additionalProperties": False}


def maybe(kind: str, **more) -> dict:
    return {"type": [kind, "null"], **more}


def listed(items: dict) -> dict:
    return {"type": "array", "items": items}


TEXT, DAY, COUNT = {"type": "string"}, {"type": "string", "format": "date"}, {"type": "integer", "minimum": 0}
LINK, STATUS = {"type": "string", "format": "uri"}, {"type": "string", "enum": STATUSES}
PRICE = obj(["amount", "currency", "gbp", "fx_rate", "fx_date"], amount=maybe("number"), currency={"type": "string", "pattern": "^[A-Z]{3}$"}, gbp=maybe("number"), fx_rate=maybe("number"), fx_date=DAY)
LISTING = obj(
    ["id", "source", "url", "title", "price", "country", "drive_side", "king_cab", "status", "first_seen", "last_seen", "history"],
    id={"type": "string", "pattern": "^[a-z_]+:.+$"}, source={"type": "string", "enum": SOURCES}, source_listing_id=TEXT, url=LINK, title=TEXT, title_translated=maybe("string"), description_snippet=maybe("string", maxLength=500),
    year=maybe("integer", minimum=1971, maximum=1980), country={"type": "string", "pattern": "^[A-Z]{2}$"}, region=maybe("string"), drive_side={"type": "string", "enum": SIDES},
    king_cab=obj(["matched", "matched_terms", "body_style_check"], matched={"type": "boolean"}, matched_terms=listed(TEXT), body_style_check={"type": "string", "enum": BODIES}),
    price=PRICE, images=listed(LINK), status=STATUS, first_seen=DAY, last_seen=DAY, history=listed(obj(["date", "status"], date=DAY, status=STATUS, price=PRICE)),
    relist=obj(["possible"], possible={"type": "boolean"}, prior_id=maybe("string"), reasons=listed(TEXT)),
)
RATES_OF_DAY = obj(["date", "base", "rates"], date=DAY, fetched_at={"type": "string", "format": "date-time"}, base={"type": "string", "const": "GBP"}, rates={"type": "object", "required": ["USD", "EUR", "JPY", "AUD", "ZAR"], "additionalProperties": {"type": "number"}})
RATES = obj(["latest", "history"], latest=RATES_OF_DAY, history=listed(RATES_OF_DAY))
PRICE_CHANGE = obj(["id", "old_gbp", "new_gbp", "pct"], id=TEXT, old_gbp=maybe("number"), new_gbp=maybe("number"), pct=maybe("number"))
STATUS_CHANGE = obj(["id", "old_status", "new_status"], id=TEXT, old_status=STATUS, new_status=STATUS)
POSSIBLE_RELIST = obj(["id", "prior_id", "reasons"], id=TEXT, prior_id=TEXT, reasons=listed(TEXT))
CHANGES = obj(["date", "new", "price_changed", "status_changed", "possible_relists"], date=DAY, new=listed(TEXT), price_changed=listed(PRICE_CHANGE), status_changed=listed(STATUS_CHANGE), possible_relists=listed(POSSIBLE_RELIST))
SOURCE_RESULT = obj(["source", "ok", "records"], source=TEXT, ok={"type": "boolean"}, records=COUNT, note=TEXT, consecutive_failures=COUNT)
TOTALS = obj(["active", "by_country", "median_gbp"], active=COUNT, by_country={"type": "object", "additionalProperties": {"type": "integer"}}, median_gbp=maybe("number"))
RUN_LOG = obj(["date", "started_at", "sources", "totals"], date=DAY, started_at={"type": "string", "format": "date-time"}, sources=listed(SOURCE_RESULT), totals=TOTALS)


WHOLE = maybe("integer")
ENGINE = {"type": "object", "properties": {"code": maybe("string"), "displacement_cc": WHOLE, "power_hp": maybe("number"), "power_note": TEXT}, "additionalProperties": True}
SIZES = obj([], length=WHOLE, width=WHOLE, height=WHOLE, wheelbase=WHOLE, bed_length=WHOLE)
COLOUR = obj(["name"], name=TEXT, code=TEXT, hex=maybe("string", pattern="^#[0-9a-fA-F]{6}$"))
VARIANT = obj(
    ["id", "name", "years", "citations"],
    id=TEXT, name=TEXT, years={"type": "object", "required": ["from", "to"], "properties": {"from": {"type": "integer"}, "to": {"type": "integer"}}}, body=TEXT, engine=ENGINE, dimensions_mm=SIZES, weight_kg=WHOLE, transmission=maybe("string"), notes=TEXT,
    confidence={"type": "string", "enum": ["high", "medium", "low"]}, unresolved=listed(TEXT), colors=listed(COLOUR), citations=listed(obj(["ref"], ref=TEXT, note=TEXT)) | {"minItems": 1},
)
MARKET = obj(["market", "name", "variants"], market={"type": "string", "enum": ["US", "UK", "AU", "JP", "TH", "ZA", "EU"]}, name=TEXT, notes=TEXT, unresolved=listed(TEXT), variants=listed(VARIANT))
SPECS = obj(["version", "markets"], version=TEXT, updated=DAY, markets=listed(MARKET))
