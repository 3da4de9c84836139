"""Parsers of landed payloads (body, and turn, kind, country where a plan gives them) into INCOMING rows: JSON natively, feeds by pattern, HTML by its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions import classify, normalize
from lotwatch.operators.files import cut
from lotwatch.operators.sets import keep_first
from lotwatch.sources.html import elements

API_ITEMS = (
    "struct<itemSummaries:array<struct<itemId:string,legacyItemId:string,title:string,shortDescription:string,price:struct<value:string,currency:string>,itemWebUrl:string,"
    "image:struct<imageUrl:string>,itemLocation:struct<country:string,stateOrProvince:string>,categories:array<struct<categoryName:string>>,buyingOptions:array<string>>>>"
)
PAGE_DATA = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
LD_JSON = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
#: Elements of a page at most, for numbering rows in the order of pages and of places in them.
PLACES = 1 << 24


def numbered(payloads: DataFrame) -> DataFrame:
    """payloads with turn (the page's number, unique in a source; 0 where there is one page) and kind."""
    rows = payloads if "turn" in payloads.columns else payloads.withColumn("turn", F.lit(0))
    return rows if "kind" in rows.columns else rows.withColumn("kind", F.lit(None).cast("string"))


def listing(df: DataFrame, source: str, rates: DataFrame, **given: Column) -> DataFrame:
    """INCOMING rows, with their ordinal, from columns by name; prices convert at rates(currency, rate, date).

    df: turn and pos number the rows.  description is kept as a snippet;
    keyword_text and side_text say what else to look through for the keyword
    and for the driver's side; side overrides the latter.
    """
    null = F.lit(None).cast("string")
    rows = df.withColumns({"_native": given["native"], "_currency": given["currency"]}).join(rates.select(F.col("currency").alias("_currency"), "rate", "date"), "_currency", "left")
    description = F.nullif(given.get("description", null), F.lit(""))
    text = F.concat_ws(" ", given["title"], given.get("side_text", description))
    side = normalize.drive_side(given["country"], text)
    return rows.select(
        F.concat(F.lit(source + ":"), "_native").alias("id"),
        F.lit(source).alias("source"),
        F.col("_native").alias("source_listing_id"),
        normalize.safe_url(given["url"]).alias("url"),
        given["title"].alias("title"),
        null.alias("title_translated"),
        F.substring(description, 1, 500).alias("description_snippet"),
        given.get("region", null).alias("region"),
        given.get("year", normalize.year_of(given["title"])).cast("int").alias("year"),
        given["country"].alias("country"),
        (F.coalesce(given["side"], side) if "side" in given else side).alias("drive_side"),
        classify.keywords(given["title"], given.get("keyword_text", description), given.get("body", null)).alias("king_cab"),
        normalize.price(given["amount"], F.col("_currency"), F.col("rate"), F.col("date")).alias("price"),
        F.filter(F.array(given.get("image", null)), lambda x: F.coalesce(x != "", F.lit(False))).alias("images"),
        given.get("status", F.lit("active")).alias("status"),
        (F.col("turn").cast("long") * PLACES + F.col("pos")).alias("ordinal"),
    )


def first_of(rows: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key, in the order of pages and of places in them."""
    return keep_first(rows, key, ["ordinal"] if "ordinal" in rows.columns else ["turn", "pos"])


def exploded(payloads: DataFrame, items: Column) -> DataFrame:
    return numbered(payloads).select(*[c for c in ("turn", "kind", "country") if c in payloads.columns or c != "country"], F.posexplode(items).alias("pos", "i"))


def demanded(found: Column, ok: Column, message: str) -> Column:
    """found, or an error where it isn't what a page must hold."""
    return F.when(ok, found).otherwise(F.raise_error(F.lit(message)))


def api_found(body: Column) -> Column:
    """The items of an API's answer, before any gate; null where it is no such answer."""
    return F.coalesce(F.size(F.from_json(body, API_ITEMS)["itemSummaries"]), F.when(body.rlike(r"^\s*\{"), 0))


def api_items(payloads: DataFrame, rates: DataFrame, source: str = "ebay") -> DataFrame:
    """payloads(body, country): an API's item lists. Title gate, parts, floor, identity, first of an id; the item's country else the market's."""
    items = exploded(payloads, F.from_json("body", API_ITEMS)["itemSummaries"])
    amount = F.col("i.price.value").try_cast("double")
    categories = F.coalesce(F.transform("i.categories", lambda c: c["categoryName"]), F.array().cast("array<string>"))
    options = F.coalesce("i.buyingOptions", F.array().cast("array<string>"))
    native = normalize.first_filled(F.col("i.legacyItemId"), F.col("i.itemId"))
    rows = items.filter(classify.whole_number(F.col("i.title")) & ~classify.looks_like_part(F.col("i.title"), categories) & ~classify.below_floor(amount, options) & native.isNotNull())
    return first_of(listing(
        rows, source, rates, native=native, title=F.col("i.title"), url=F.col("i.itemWebUrl"), description=F.col("i.shortDescription"),
        country=normalize.country_code(normalize.first_filled(F.col("i.itemLocation.country"), F.col("country"))),
        region=F.col("i.itemLocation.stateOrProvince"), amount=amount, currency=F.col("i.price.currency"), image=F.col("i.image.imageUrl"),
    ))


def embedded(payloads: DataFrame, variable: str, schema: str) -> DataFrame:
    """payloads(body) with `data`: the JSON that a page assigns to a variable; an error where a page has none."""
    text = F.regexp_extract("body", rf"(?s){variable}\s*=\s*(\{{.*?\}});", 1)
    return payloads.withColumn("data", F.from_json(demanded(text, text != "", f"no {variable} in the page"), schema))


def auctions(payloads: DataFrame, rates: DataFrame, source: str = "bringatrailer") -> DataFrame:
    """Completed and running auctions from a page's data: title gate; the year as given if in range, else from the title; every row stays."""
    schema = "struct<items:array<struct<title:string,url:string,current_bid:double,currency:string,country_code:string,year:int,thumbnail_url:string,active:boolean,excerpt:string>>>"
    rows = embedded(payloads, "auctionsCompletedInitialData", schema)
    rows = exploded(rows, F.col("data.items")).filter(classify.whole_number(F.col("i.title")))
    given, url = F.when(F.col("i.year").between(1971, 1980), F.col("i.year")), normalize.safe_url(F.coalesce("i.url", F.lit("")))
    return listing(
        rows, source, rates, native=F.when(url != "", normalize.slug_of(url)).otherwise(normalize.slug_of_title(F.col("i.title"))), title=F.col("i.title"), url=url, description=F.col("i.excerpt"),
        country=normalize.country_code(F.coalesce(normalize.first_filled(F.col("i.country_code")), F.lit("US"))), year=F.coalesce(given, normalize.year_of(F.col("i.title"))),
        amount=F.nullif(F.col("i.current_bid"), F.lit(0.0)), currency=F.coalesce(normalize.first_filled(F.col("i.currency")), F.lit("USD")), image=F.col("i.thumbnail_url"),
        status=F.when(F.col("i.active"), "active").otherwise("sold"),
    )


def community_auctions(payloads: DataFrame, rates: DataFrame, source: str = "carsandbids") -> DataFrame:
    """An auction site's JSON, or a page with its state: bids and places that may be objects or plain values; always sold in the US."""
    blocked = "(?i)^\\s*(403|429|503)\\b"
    body = F.col("body")
    state = F.regexp_extract(body, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\});?\s*</script>", 1)
    text = F.when(body.rlike(blocked), F.raise_error(F.concat(F.lit("HTTP "), F.regexp_extract(body, blocked, 1), F.lit(" (blocked)")))).when(body.rlike(r"^\s*\{"), body).otherwise(demanded(state, state != "", "neither JSON nor a state in the page"))
    data = F.parse_json(text)
    lists = [F.try_variant_get(data, f"$.{k}", "array<variant>") for k in ("auctions", "results")]
    rows = exploded(payloads, F.when(F.size(lists[0]) > 0, lists[0]).otherwise(lists[1]))
    get = lambda path, kind="string": F.try_variant_get("i", path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("i", path, "variant"))
    rows = rows.filter(classify.whole_number(get("$.title")))
    subtitle = normalize.first_filled(get("$.sub_title"), get("$.subtitle"))
    slug = normalize.first_filled(get("$.slug"), get("$.id"))
    place = normalize.country_code(get("$.location.country"))
    amount = F.coalesce(get("$.current_bid.amount", "double"), F.when(~F.coalesce(kind("$.current_bid").startswith("OBJECT"), F.lit(False)), get("$.current_bid", "double")))
    ended = F.coalesce(get("$.ended", "boolean"), F.lit(False))
    return listing(
        rows, source, rates, native=slug, title=get("$.title"), url=F.concat(F.lit("https://carsandbids.com/auctions/"), slug), description=subtitle,
        year=F.coalesce(F.nullif(get("$.year", "int"), F.lit(0)), normalize.year_of(get("$.title"))), country=F.when(place == "XX", "US").otherwise(place), region=get("$.location.state"),
        side=normalize.drive_side(F.lit("US"), F.concat_ws(" ", get("$.title"), subtitle)), amount=F.nullif(amount, F.lit(0.0)), currency=F.lit("USD"), image=get("$.main_photo.url"), status=F.when(ended, "sold").otherwise("active"),
    )


def linked_titles(payloads: DataFrame, rates: DataFrame, source: str = "hemmings") -> DataFrame:
    """Links to vehicles whose text is the title; the price from the block around; the first of a slug."""
    around = "^li|article|div "
    rows = elements(numbered(payloads), "a", {"href": ".@href", "title": ".", "block": around + ".", "image": around + "img@src"})
    rows = rows.filter(F.col("href").rlike("/listing/|/cars-for-sale/") & classify.whole_number(F.col("title")) & F.lower("title").contains("datsun"))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit("https://www.hemmings.com"), "href"))
    return first_of(listing(
        rows, source, rates, native=normalize.slug_of(url), title=F.col("title"), url=url, country=F.lit("US"), amount=normalize.dollars(F.col("block")), currency=F.lit("USD"),
        image=F.when(F.col("image").startswith("http"), F.col("image")),
    ))


def keyed_state(payloads: DataFrame, rates: DataFrame, prefix: str = "StandardListing:", country: str = "CA", source: str = "kijiji") -> DataFrame:
    """Listings from a page's state, a map whose keys carry the type; prices in cents; vehicles by their url; an error without a state or a listing."""
    item = "struct<id:string,title:string,description:string,url:string,price:struct<amount:double>,location:struct<name:string>,imageUrls:array<string>>"
    schema = f"struct<props:struct<pageProps:struct<__APOLLO_STATE__:map<string,{item}>>>>"
    text = F.regexp_extract("body", PAGE_DATA, 1)
    data = F.from_json(demanded(text, text != "", "no state in the page (moved or blocked?)"), schema)["props"]["pageProps"]["__APOLLO_STATE__"]
    held = F.map_values(F.map_filter(data, lambda k, v: k.startswith(prefix)))
    rows = exploded(payloads, demanded(held, F.coalesce(F.size(held), F.lit(0)) > 0, "no listing in the page's state"))
    title, text = F.coalesce("i.title", F.lit("")), F.coalesce("i.description", F.lit(""))
    rows = rows.filter((F.coalesce("i.id", F.lit("")) != "") & F.col("i.url").rlike("/v-cars-trucks/|/v-classic-cars/|/v-autos-camions/") & (classify.number_alone(title) | classify.number_alone(text)))
    return listing(
        rows, source, rates, native=F.col("i.id"), title=title, url=F.col("i.url"), description=F.col("i.description"), country=F.lit(country), region=F.col("i.location.name"), year=normalize.year_of(F.concat_ws(" ", title, text)),
        amount=normalize.from_cents(F.col("i.price.amount")), currency=F.lit("CAD"), image=F.try_element_at("i.imageUrls", F.lit(1)),
    )


def linked_data(payloads: DataFrame, rates: DataFrame, source: str = "classiccars", base: str = "https://classiccars.com") -> DataFrame:
    """Cars from ld+json scripts: broken JSON is skipped; the type may be a string or a list; the first of a sku.

    A page without a car that doesn't name the brand either isn't the search's: an error.
    """
    scripts = F.regexp_extract_all("body", F.lit(LD_JSON), F.lit(1))
    is_car = lambda s: F.coalesce(F.lower(F.coalesce(F.try_variant_get(F.try_parse_json(s), "$['@type']", "string"), F.to_json(F.try_variant_get(F.try_parse_json(s), "$['@type']", "array<string>")))).rlike('^car$|"car"'), F.lit(False))
    cars = F.filter(scripts, is_car)
    rows = exploded(payloads, demanded(cars, (F.size(cars) > 0) | F.lower("body").contains("datsun"), "not the search's page (blocked or moved?)"))
    rows = rows.withColumn("i", F.try_parse_json("i"))
    get = lambda path: F.try_variant_get("i", path, "string")
    rows = rows.withColumn("sku", get("$.sku")).filter(F.coalesce("sku", F.lit("")) != "")
    dated, url = get("$.modelDate"), F.coalesce(get("$.offers.url"), F.lit(""))
    year = F.when(dated.rlike("^[0-9]+$"), dated.try_cast("int"))
    region = normalize.region_of(url, "-for-sale-in-([a-z-]+)-([0-9]{5})?$")
    return listing(
        first_of(rows, "sku"), source, rates, native=F.col("sku"), title=F.coalesce(get("$.name"), F.lit("")), url=normalize.absolute(url, base), description=get("$.description"), country=F.lit("US"), region=F.nullif(region, F.lit("")),
        year=F.coalesce(F.when(year.between(1971, 1980), year), normalize.year_of(get("$.name"))), amount=F.nullif(get("$.offers.price").try_cast("double"), F.lit(0.0)),
        currency=F.coalesce(normalize.first_filled(get("$.offers.priceCurrency")), F.lit("USD")), image=get("$.image.url"),
    )


def feed(payloads: DataFrame, rates: DataFrame, source: str = "barnfinds") -> DataFrame:
    """Items of an RSS feed; a price only after words that announce one."""
    body = demanded(F.col("body"), F.col("body").contains("<rss"), "not a feed")
    items = exploded(payloads, F.regexp_extract_all(body, F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).withColumnRenamed("i", "x")
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    title = F.replace(F.replace(part("title"), F.lit("&#215;"), F.lit("x")), F.lit("&amp;"), F.lit("&"))
    text = normalize.collapse(normalize.strip_tags(part("description")))
    rows = items.select("turn", "pos", title.alias("t"), part("link").alias("u"), text.alias("d"), F.regexp_extract(part("description"), '<img[^>]*src="([^"]+)"', 1).alias("img")).filter("u <> ''")
    return listing(
        rows, source, rates, native=normalize.slug_of(F.col("u")), title=F.col("t"), url=F.col("u"), description=F.col("d"), country=F.lit("US"),
        amount=normalize.number_after(F.col("d"), r"(?i)(?:asking|price|bid|for)[^$]{0,20}\$\s?([0-9][0-9,]*)"), currency=F.lit("USD"), image=F.col("img"),
    )


def used_boxes(payloads: DataFrame, rates: DataFrame, source: str = "flex") -> DataFrame:
    """A dealer's stock: the number, or the model's name in the title; a known year must be the era's; sold cards stay, as sold."""
    link = r"/detail/[^\"]*-used-(\d+)\.html"
    fields = {"href": f"a@href~{link}", "title": ".useditem__ttl h3", "blurb": ".useditem__ttl p", "image": ".usd_phbox img@src|data-src", "text": "."}
    rows = elements(numbered(payloads), "div.usdbox", fields, need="div.usdbox").filter("href is not null")
    rows = rows.withColumns({"native": F.regexp_extract("href", link, 1), "title": F.coalesce("title", F.lit("")), "blurb": F.coalesce("blurb", F.lit("")), "y": normalize.number_after(F.col("text"), "((?:19|20)[0-9]{2})年").cast("int")})
    rows = rows.filter((classify.number_alone(F.concat_ws(" ", "title", "blurb")) | F.col("title").contains(classify.MODEL_NAME)) & classify.in_era(F.col("y"), True))
    return listing(
        first_of(rows, "native"), source, rates, native=F.col("native"), title=F.col("title"), url=normalize.percent_encoded(F.col("href"), normalize.SAFE), description=F.col("blurb"), country=F.lit("JP"), year=F.col("y"),
        amount=normalize.ten_thousands_of_yen(F.col("text")), currency=F.lit("JPY"), image=F.col("image"), status=F.when(F.col("text").contains("SOLD OUT"), "sold").otherwise("active"),
    )


def car_items(payloads: DataFrame, rates: DataFrame, source: str = "kuruma_ex", base: str = "https://kuruma-ex.jp") -> DataFrame:
    """Cards whose text leads with the title, up to the first label; the year must be known and the era's."""
    link = r"/usedcar/detail/(cc[A-Z]{2}\d+)"
    rows = elements(numbered(payloads), "div.car-item", {"href": f"a@href~{link}", "text": ".", "image": "img@data-src|src"}, need="div.car-item").filter("href is not null")
    rows = rows.withColumns({"native": F.regexp_extract("href", link, 1), "y": normalize.number_after(F.col("text"), "年式\\s*((?:19|20)[0-9]{2})年").cast("int")}).filter(classify.in_era(F.col("y"), False))
    title = F.substring(normalize.collapse(normalize.before_labels(F.col("text"), "支払総額|本体価格|応談|年式")), 1, 120)
    return listing(
        first_of(rows, "native"), source, rates, native=F.col("native"), title=title, url=normalize.absolute(F.col("href"), base), keyword_text=F.substring("text", 1, 300), side_text=F.col("text"), country=F.lit("JP"), year=F.col("y"),
        amount=normalize.ten_thousands_of_yen(F.col("text")), currency=F.lit("JPY"), image=normalize.absolute(F.col("image"), base),
    )


def cassettes(payloads: DataFrame, rates: DataFrame, source: str = "carsensor", base: str = "https://www.carsensor.net") -> DataFrame:
    """Cards with three places for a price, of which the first that has one counts; of an id the first card counts, before the era gate."""
    link = r"/usedcar/detail/([A-Z]{2}\d+)/"
    fields = {"href": f"a@href~{link}", "title": "h3.cassetteMain__title", "total": ".totalPrice__content", "base": ".basePrice__content", "price": ".basePrice__price", "spec": ".specList", "image": "img@data-src|src", "area": ".cassetteSub__area"}
    rows = elements(numbered(payloads), "div.cassette", fields, need="div.cassette,div.cassetteMain").filter("href is not null")
    rows = first_of(rows.withColumn("native", F.regexp_extract("href", link, 1)), "native")
    rows = rows.withColumn("y", normalize.number_after(F.col("spec"), "年式\\s*((?:19|20)[0-9]{2})").cast("int")).filter(classify.in_era(F.col("y"), False))
    amount = F.coalesce(*[normalize.ten_thousands_of_yen(F.regexp_replace(c, r"(?U)\s+", "")) for c in ("total", "base", "price")])
    return listing(
        rows, source, rates, native=F.col("native"), title=normalize.collapse(F.coalesce("title", F.lit(""))), url=F.concat(F.lit(f"{base}/usedcar/detail/"), "native", F.lit("/index.html")), country=F.lit("JP"), region=F.col("area"), year=F.col("y"),
        amount=amount, currency=F.lit("JPY"), image=normalize.absolute(F.col("image"), base),
    )


def list_view(payloads: DataFrame, rates: DataFrame, source: str = "goonet_exchange", base: str = "https://www.goo-net-exchange.com") -> DataFrame:
    """Direct entries of a list; the year leads the first detail; details may name the driver's side; every row stays."""
    link = r"/usedcars/NISSAN/DATSUN_TRUCK/(\d+)/?$"
    fields = {"href": f"a@href~{link}", "title": "h3.title", "first": "ul.details li", "details": "ul.details li*", "price": "p.price", "image": "div.photo img@data-src|src", "place": "p.location"}
    rows = elements(numbered(payloads), "ul.list-listview > li", fields, need="ul.list-listview").filter("href is not null")
    rows = rows.withColumns({"native": F.regexp_extract("href", link, 1), "y": normalize.number_after(F.col("first"), "^((?:19|20)[0-9]{2})").cast("int")}).filter(classify.in_era(F.col("y"), False))
    side = F.when(F.col("details").rlike(r"(?i)\bright\b"), "RHD").when(F.col("details").rlike(r"(?i)\bleft\b"), "LHD").otherwise("RHD")
    return listing(
        rows, source, rates, native=F.col("native"), title=normalize.collapse(F.coalesce("title", F.lit(""))), url=F.concat(F.lit(f"{base}/usedcars/NISSAN/DATSUN_TRUCK/"), "native", F.lit("/")), country=F.lit("JP"), region=F.col("place"), year=F.col("y"),
        side=side, amount=normalize.yen(F.col("price")), currency=F.lit("JPY"), image=F.col("image"),
    )


def _auction(rows: DataFrame, source: str, rates: DataFrame, status: str) -> DataFrame:
    """rows(native, title, amount, image, turn, pos) of a Japanese auction site."""
    title = F.col("title")
    return listing(
        rows, source, rates, native=F.col("native"), title=title, url=F.concat(F.lit("https://auctions.yahoo.co.jp/jp/auction/"), "native"), country=F.lit("JP"), year=normalize.year_of_era(title),
        amount=F.col("amount"), currency=F.lit("JPY"), image=F.col("image"), status=F.lit(status),
    )


def open_auctions(payloads: DataFrame, rates: DataFrame, source: str = "yahoo_auctions") -> tuple[DataFrame, DataFrame]:
    """Rows of running auctions, and the items of each page before any gate (turn, raw).

    Pages of kind `vehicle` come from the category of whole vehicles: no floor
    and no list of parts, and the model's name with a year of the era counts.
    """
    link = "a.Product__titleLink"
    fields = {"native": f"{link}@data-auction-id", "named": f"{link}@data-auction-title", "text": link, "asked": f"{link}@data-auction-price", "image": f"{link}@data-auction-img"}
    items = cut(elements(numbered(payloads), "li.Product", fields))  # counted and read
    amount = F.when(F.col("asked").rlike("^[0-9]+$"), F.col("asked").try_cast("double"))
    rows = items.withColumns({"title": F.coalesce(F.nullif("named", F.lit("")), F.col("text")), "amount": amount}).filter("native <> ''")
    scoped = F.coalesce(F.col("kind") == "vehicle", F.lit(False))
    passed = F.when(scoped, classify.scoped_title(F.col("title"), normalize.year_of_era(F.col("title")))).otherwise(classify.auction_title(F.col("title")) & classify.over_floor(F.col("amount")))
    return _auction(rows.filter(passed), source, rates, "active"), items.groupBy("turn").agg(F.count(F.lit(1)).alias("raw"))


def closed_auctions(payloads: DataFrame, rates: DataFrame, source: str = "yahoo_auctions") -> tuple[DataFrame, DataFrame]:
    """Rows of ended auctions in the tree of whole vehicles, as sold, and the items of each page before any gate (turn, raw)."""
    item = "struct<auctionId:string,title:string,price:double,imageUrl:string,categoryPath:array<struct<name:string>>>"
    schema = f"struct<props:struct<pageProps:struct<initialState:struct<search:struct<items:struct<listing:struct<items:array<{item}>>>>>>>>"
    text = F.regexp_extract("body", PAGE_DATA, 1)
    data = F.from_json(demanded(text, text != "", "no state in the page (moved?)"), schema)
    items = exploded(payloads, data["props"]["pageProps"]["initialState"]["search"]["items"]["listing"]["items"])
    path = F.transform("i.categoryPath", lambda c: F.coalesce(c["name"], F.lit("")))
    rows = items.filter((F.coalesce("i.auctionId", F.lit("")) != "") & classify.auction_title(F.coalesce("i.title", F.lit(""))) & classify.in_vehicle_tree(path))
    rows = rows.select("turn", "pos", F.col("i.auctionId").alias("native"), F.col("i.title").alias("title"), F.col("i.price").alias("amount"), F.col("i.imageUrl").alias("image"))
    return _auction(rows, source, rates, "sold"), items.groupBy("turn").agg(F.count(F.lit(1)).alias("raw"))


def all_auctions(payloads: DataFrame, rates: DataFrame, source: str = "yahoo_auctions") -> DataFrame:
    """Running and ended auctions of a plan's pages, kind open, vehicle or closed; the first of an id, in the plan's order.

    No item on any page means a blocked search or a moved layout, not an empty market: an error.
    """
    pages = numbered(payloads)
    running, one = open_auctions(pages.filter("coalesce(kind, 'open') <> 'closed'"), rates, source)
    ended, two = closed_auctions(pages.filter("kind = 'closed'"), rates, source)
    if one.unionByName(two).agg(F.sum("raw").alias("raw")).first()["raw"] in (None, 0):
        raise ValueError("canary: no item on any page")
    return first_of(running.unionByName(ended))


ADS = "struct<props:struct<pageProps:struct<ads:array<struct<id:string,title:string,price:double,image:string,location:string>>>>>"


def ads_of(body: Column) -> Column:
    """The ads in a page's state; null where there is no state or no list of ads in it."""
    return F.from_json(F.nullif(F.regexp_extract(body, PAGE_DATA, 1), F.lit("")), ADS)["props"]["pageProps"]["ads"]


def page_ads(payloads: DataFrame, rates: DataFrame, source: str = "kaidee", base: str = "https://rod.kaidee.com") -> DataFrame:
    """Ads from pages' states that name the brand and a truck and no other generation; years are informative; the first of an id.

    A page without an ad is a failed query, which registry.answered tells from the others; pages that come here without one are an error.
    """
    ads = ads_of(F.col("body"))
    rows = exploded(payloads, demanded(ads, F.coalesce(F.size(ads), F.lit(0)) > 0, "no ad in the page (moved or blocked?)"))
    rows = rows.filter((F.coalesce("i.id", F.lit("")) != "") & classify.wanted(F.coalesce("i.title", F.lit(""))))
    return first_of(listing(
        rows, source, rates, native=F.col("i.id"), title=F.col("i.title"), url=F.concat(F.lit(f"{base}/product-"), "i.id"), country=F.lit("TH"), region=F.col("i.location"), amount=F.nullif(F.col("i.price"), F.lit(0.0)),
        currency=F.lit("THB"), image=F.col("i.image"),
    ))
