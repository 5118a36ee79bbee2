"""Records of catalogs, posts and articles, read as claims and fields, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import title_case
from .units import normalize_unit, parse_package_weight

# Categories of catalog records by words of a category text, tried in this order.
CATALOG_CATEGORIES = {
    "chips": "chips", "crisps": "chips", "snack": "snacks", "snacks": "snacks", "cereal": "cereal", "cereals": "cereal", "cookie": "cookies", "cookies": "cookies", "biscuit": "cookies", "cracker": "crackers",
    "crackers": "crackers", "yogurt": "yogurt", "yoghurt": "yogurt", "ice cream": "ice_cream", "ice-cream": "ice_cream", "candy": "candy", "chocolate": "candy", "confectionery": "candy", "beverage": "beverages",
    "beverages": "beverages", "drink": "beverages", "drinks": "beverages", "juice": "beverages", "soda": "beverages", "frozen": "frozen_meals", "frozen meal": "frozen_meals", "canned": "canned_goods", "bread": "bread",
    "pasta": "pasta", "noodle": "pasta", "condiment": "condiments", "sauce": "condiments", "ketchup": "condiments", "mustard": "condiments", "dairy": "dairy", "milk": "dairy", "cheese": "dairy", "butter": "dairy",
    "cream": "dairy", "meat": "meat", "beef": "meat", "chicken": "meat", "pork": "meat", "produce": "produce", "fruit": "produce", "vegetable": "produce",
}
# The same for categories of food releases.
FOOD_CATEGORIES = {
    "snack": "snacks", "chip": "chips", "cereal": "cereal", "cookie": "cookies", "cracker": "crackers", "candy": "candy", "confection": "candy", "chocolate": "candy", "beverage": "beverages", "drink": "beverages",
    "water": "beverages", "soda": "beverages", "juice": "beverages", "coffee": "beverages", "tea": "beverages", "dairy": "dairy", "milk": "dairy", "cheese": "dairy", "yogurt": "dairy", "ice cream": "ice cream",
    "frozen": "frozen meals", "canned": "canned goods", "soup": "canned goods", "bread": "bread", "bakery": "bread", "pasta": "pasta", "noodle": "pasta", "condiment": "condiments", "sauce": "condiments",
    "dressing": "condiments", "meat": "meat", "poultry": "meat", "seafood": "meat", "produce": "produce", "fruit": "produce", "vegetable": "produce",
}
# Names of retailers in posts, tried in this order.
RETAILER_NAMES = [
    "walmart", "target", "costco", "sam's club", "sams club", "kroger", "safeway", "albertsons", "publix", "heb", "h-e-b", "aldi", "lidl", "trader joe's", "trader joes", "whole foods", "amazon", "wegmans",
    "food lion", "stop & shop", "stop and shop", "giant", "meijer", "winco", "dollar general", "dollar tree", "family dollar", "cvs", "walgreens", "rite aid", "7-eleven", "7 eleven",
]
# What a moderator says of a post that isn't on the subject.
OFF_TOPIC = (
    r"(?i)not\s+(an?\s+)?(example|instance|case)\s+of\s+shrinkflation|not\s+shrinkflation|doesn.t\s+(qualify|count)\s+as\s+shrinkflation|this\s+is(n.t|\s+not)\s+shrinkflation"
    r"|removed.*not\s+shrinkflation|rule\s+\d+.*not\s+shrinkflation"
)
# Outlets that can be read freely, and those that can't; the latter win.
FREE_OUTLETS = [
    "bbc", "bbc news", "reuters", "ap", "associated press", "apnews", "npr", "the guardian", "guardian", "cnn", "cnn business", "usa today", "yahoo finance", "yahoo", "nbc news", "nbc", "cbs news", "cbs", "abc news",
    "abc", "fox business", "the conversation", "marketwatch", "axios", "the verge", "ars technica", "vox", "consumer reports", "the grocer", "today", "good morning america", "money.com", "investopedia", "the hill", "business insider",
]
PAYWALLED_OUTLETS = ["wsj", "the wall street journal", "wall street journal", "the new york times", "nyt", "ft", "financial times", "bloomberg", "the washington post", "washington post", "the economist", "economist"]
# Beginnings of codes that were made up for lack of a real one, on pages and for monitoring.
MADE_UP_ON_PAGES = ["REDDIT", "CLAIM", "OFF", "GDELT"]
MADE_UP_VARIANTS = ["CLAIM-", "REDDIT-", "TEMP-", "UNKNOWN"]
IMAGE = r"(?i)\.(jpe?g|png|webp|gif)(\?|$)"
# Subjects of an article by words of its title.
ARTICLE_TAGS = ["policy", "investigation", "consumer", "analysis", "data", "viral", "industry", "economy"]
# Beginnings of headings that name no product.
NO_PRODUCT = ["how ", "why ", "what ", "the ", "this ", "tips ", "things "]
HEADING = r"^\s*(.+?)\s*(?:—|–|-|:)\s*(.+?)\s*$"


def text_or_null(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def positive(value: Column) -> Column:
    """A number above zero, else null."""
    number = value.cast("string").try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def unit_interval(value: Column) -> Column:
    """A number kept within 0 and 1; 0 for what is none."""
    number = F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def full_date(value: Column) -> Column:
    """YYYY-MM-DD as it is, YYYY-MM as the month's first day, else null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))


def category_by(text: Column, words: dict[str, str], default: str = "other") -> Column:
    """The category of the first word, in the table's order, that stands anywhere in the text."""
    lower = F.lower(text)
    return reduce(lambda out, kv: out.when(lower.contains(kv[0]), kv[1]), words.items(), F.when(F.lit(False), "")).otherwise(default)


def _claim(confidences: list[Column], cap: float, **fields: Column) -> Column:
    kinds = {"new_size": "double", "new_price": "double", "is_shrinkflation": "boolean"}
    names = ["brand", "product_name", "category", "new_size", "new_size_unit", "new_price", "retailer", "upc", "observed_date", "change_description"]
    brand, name, _ = confidences
    overall = F.least(F.lit(cap), reduce(lambda a, b: a + b, confidences) / 3)
    confidence = F.struct(brand.alias("brand"), name.alias("product_name"), F.lit(0.0).alias("size_change"), overall.alias("overall"))
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names], F.lit(False).alias("is_shrinkflation"), confidence.alias("confidence"))


def _has(value: Column, points: float) -> Column:
    return F.when(value.isNotNull(), points).otherwise(0.0)


def _titled(brand: Column) -> Column:
    return F.when(brand.isNotNull(), title_case(brand))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a lambda's variable, where a column would be repeated at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _record(payload: Column, schema: str, fields: Callable[[Column], dict[str, Column]], claim: Callable[[Column], Column], needs: tuple[str, str]) -> Column:
    """The claim of a JSON record from its cleaned fields, null where both needed ones are missing."""
    cleaned = lambda p: F.struct(*[c.alias(n) for n, c in fields(p).items()])
    return _let(_let(F.from_json(payload, schema), cleaned), lambda x: F.when(x[needs[0]].isNotNull() | x[needs[1]].isNotNull(), claim(x)))


def _catalog_entry(x: Column, brand_points: float, name_points: float, cap: float, **fields: Column) -> Column:
    """A claim with a size: what the records of shops and of open facts share."""
    category = F.when(x["categories"].isNotNull(), category_by(x["categories"], CATALOG_CATEGORIES))
    points = [_has(x["brand"], brand_points), _has(x["name"], name_points), _has(F.when(x["size"]["value"] > 0, x["size"]["value"]), 0.9)]
    return _claim(points, cap, brand=_titled(x["brand"]), product_name=x["name"], category=category, new_size=x["size"]["value"], new_size_unit=x["size"]["unit"], upc=x["code"], change_description=F.lit("catalog_entry"), **fields)


def _price(*given: Column) -> Column:
    """The first price that is given and isn't 0, if it is positive."""
    return positive(F.coalesce(*[F.when(F.coalesce(x.try_cast("double"), F.lit(1.0)) != 0, text_or_null(x)) for x in given]))


def open_facts_claim(payload: Column) -> Column:
    """Claim of a product record with code, product_name, brands, quantity and categories; null without name and brand."""

    def fields(p: Column) -> dict[str, Column]:
        number, unit = positive(p["product_quantity"]), text_or_null(p["product_quantity_unit"])
        numbered = F.struct(number.alias("value"), F.when(unit.isNotNull(), normalize_unit(unit)).alias("unit"))
        size = F.when(number.isNotNull(), numbered).otherwise(parse_package_weight(text_or_null(p["quantity"])))
        return {"code": text_or_null(p["code"]), "name": text_or_null(p["product_name"]), "brand": text_or_null(p["brands"]), "categories": text_or_null(p["categories"]), "size": size}

    schema = "code string, product_name string, brands string, quantity string, product_quantity string, product_quantity_unit string, categories string"
    return _record(payload, schema, fields, lambda x: _catalog_entry(x, 0.9, 0.9, 0.9), ("name", "brand"))


def kroger_claim(payload: Column) -> Column:
    """Claim of a store's product record with description, brand, size, items and categories; null without description and brand."""

    def fields(p: Column) -> dict[str, Column]:
        price = F.get(p["items"], F.lit(0))["price"]
        return {"code": F.coalesce(text_or_null(p["upc"]), text_or_null(p["productId"])), "name": text_or_null(p["description"]), "brand": text_or_null(p["brand"]), "categories": F.nullif(text_or_null(p["categories"]), F.lit("[]")),
                "size": parse_package_weight(F.coalesce(text_or_null(p["size"]), text_or_null(p["itemInformation"]["size"]))), "price": _price(price["regular"], price["promo"])}

    schema = "description string, brand string, upc string, productId string, size string, itemInformation struct<size: string>, items array<struct<price: struct<regular: string, promo: string>>>, categories string"
    return _record(payload, schema, fields, lambda x: _catalog_entry(x, 0.95, 0.95, 0.95, new_price=x["price"], retailer=F.lit("Kroger")), ("name", "brand"))


def open_prices_claim(payload: Column) -> Column:
    """Claim of a price observation with product_code, product, price, date and location; null without code and name."""

    def fields(p: Column) -> dict[str, Column]:
        day = F.substring(F.trim(F.coalesce(F.nullif(p["date"], F.lit("")), p["created"])), 1, 10)
        store = text_or_null(F.coalesce(F.nullif(p["location"]["osm_name"], F.lit("")), p["location"]["name"]))
        return {"code": F.coalesce(text_or_null(p["product_code"]), text_or_null(p["barcode"])), "name": text_or_null(p["product"]["product_name"]), "brand": text_or_null(p["product"]["brands"]), "price": positive(p["price"]), "day": F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day), "store": store}

    def claim(x: Column) -> Column:
        points = [_has(x["brand"], 0.8), _has(x["name"], 0.8), _has(x["price"], 0.8)]
        return _claim(points, 0.8, brand=_titled(x["brand"]), product_name=x["name"], new_price=x["price"], retailer=x["store"], upc=x["code"], observed_date=x["day"], change_description=F.lit("price_observation"))

    schema = "product_code string, barcode string, product struct<product_name: string, brands: string>, price string, date string, created string, location struct<osm_name: string, name: string>"
    return _record(payload, schema, fields, claim, ("name", "code"))


def walmart_claim(payload: Column) -> Column:
    """Claim of a store's product record with name, brandName, size, prices and categoryPath; null without name and brand."""

    def fields(p: Column) -> dict[str, Column]:
        name = text_or_null(p["name"])
        return {"code": F.coalesce(text_or_null(p["upc"]), text_or_null(p["itemId"])), "name": name, "brand": text_or_null(p["brandName"]), "categories": text_or_null(p["categoryPath"]), "size": F.coalesce(parse_package_weight(text_or_null(p["size"])), parse_package_weight(name)), "price": _price(p["salePrice"], p["msrp"])}

    schema = "name string, brandName string, upc string, itemId string, salePrice string, msrp string, size string, categoryPath string"
    return _record(payload, schema, fields, lambda x: _catalog_entry(x, 0.95, 0.95, 0.95, new_price=x["price"], retailer=F.lit("Walmart")), ("name", "brand"))


#: Parsers of catalog records by the source they come from.
CATALOG_PARSERS = {"openfoodfacts": open_facts_claim, "kroger_api": kroger_claim, "openprices": open_prices_claim, "walmart": walmart_claim}


def catalog_claim(source_type: Column, payload: Column) -> Column:
    """The claim that the source's own parser reads; null for other sources and unreadable records."""
    return reduce(lambda out, kv: out.when(source_type == kv[0], kv[1](payload)), CATALOG_PARSERS.items(), F.when(F.lit(False), open_facts_claim(payload)))


RESPONSE = "brand string, product_name string, category string, old_size string, old_size_unit string, new_size string, new_size_unit string, old_price string, new_price string, retailer string, upc string, observed_date string, change_description string, is_shrinkflation string, confidence struct<brand: string, product_name: string, size_change: string, overall: string>"


def coerced_claim(response: Column) -> Column:
    """A claim of the right types from an extractor's JSON; what can't be read is a failed extraction without fields."""
    p = F.from_json(response, RESPONSE)
    texts = {c: text_or_null(p[c]) for c in ("brand", "product_name", "category", "old_size_unit", "new_size_unit", "retailer", "upc")}
    numbers = {c: positive(p[c]) for c in ("old_size", "new_size", "old_price", "new_price")}
    shrinks = F.lower(F.trim(F.coalesce(p["is_shrinkflation"], F.lit("")))).isin("true", "1", "yes")
    fields = {**texts, **numbers, "observed_date": full_date(p["observed_date"]), "change_description": F.coalesce(text_or_null(p["change_description"]), F.lit("extraction_failed")), "is_shrinkflation": shrinks}
    order = ["brand", "product_name", "category", "old_size", "old_size_unit", "new_size", "new_size_unit", "old_price", "new_price", "retailer", "upc", "observed_date", "change_description", "is_shrinkflation"]
    confidence = F.struct(*[unit_interval(p["confidence"][c]).alias(c) for c in ("brand", "product_name", "size_change", "overall")])
    return F.struct(*[fields[c].alias(c) for c in order], confidence.alias("confidence"))


def image_url(payload: Column) -> Column:
    """Where a payload's image is: social card, linked image, preview, first of a gallery, thumbnail; else null."""
    p = F.from_json(payload, "socialimage string, url string, preview struct<images: array<struct<source: struct<url: string>>>>, media_metadata map<string, struct<s: struct<u: string>>>, thumbnail string")
    clean = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    gallery = F.filter(F.map_values(p["media_metadata"]), lambda x: x["s"]["u"].isNotNull())
    return F.coalesce(
        F.when(p["socialimage"].startswith("http"), p["socialimage"]),
        F.when(p["url"].rlike(IMAGE), p["url"]),
        clean(F.get(p["preview"]["images"], F.lit(0))["source"]["url"]),
        clean(F.get(gallery, F.lit(0))["s"]["u"]),
        F.when(p["thumbnail"].startswith("http") & p["thumbnail"].rlike(r"(?i)\.(jpe?g|png|webp|gif)"), p["thumbnail"]),
    )


def retailer_in(text: Column) -> Column:
    """The first retailer named in a text, in title case."""
    names = "|".join(n.replace(".", r"\.") for n in RETAILER_NAMES)
    found = F.regexp_extract(text, rf"(?i)\b({names})\b", 1)
    return F.when(found != "", title_case(found))


def removed_as_off_topic(title: Column, text: Column, removed_by: Column, moderator_comments: Column) -> Column:
    """Whether a post was removed and a moderator's comment says that it is off the subject."""
    removed = F.lower(F.coalesce(title, F.lit(""))).contains("[removed") | F.coalesce(removed_by.isin("moderator", "automod"), F.lit(False)) | (F.coalesce(text, F.lit("")) == "[removed]")
    return removed & F.coalesce(F.exists(moderator_comments, lambda x: F.coalesce(x.rlike(OFF_TOPIC), F.lit(False))), F.lit(False))


def is_free_outlet(outlet: Column) -> Column:
    """Whether a free outlet's name stands in the text and no paywalled one's does."""
    name = F.trim(F.lower(F.coalesce(outlet, F.lit(""))))
    any_of = lambda names: reduce(lambda a, b: a | b, [name.contains(n) for n in names])
    return any_of(FREE_OUTLETS) & ~any_of(PAYWALLED_OUTLETS)


def ean13(code: Column) -> Column:
    """The 13 digits of a code of 12 or 13; null for others."""
    text = F.trim(code)
    return F.when(text.rlike(r"^\d{13}$"), text).when(text.rlike(r"^\d{12}$"), F.concat(F.lit("0"), text))


def is_made_up(code: Column, beginnings: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.upper(code).startswith(b) for b in beginnings]), F.lit(False))


def product_codes(code: Column) -> Column:
    """Forms of a real code for look-ups: its digits, a code of 13 without its leading 0, one of 12 with it; none for made-up or short ones."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    other = F.when((F.length(digits) == 13) & digits.startswith("0"), F.substring(digits, 2, 12)).when(F.length(digits) == 12, F.concat(F.lit("0"), digits))
    return F.when((F.length(digits) < 8) | is_made_up(code, MADE_UP_ON_PAGES), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(digits, other)))


def quarter_key(day: Column) -> Column:
    """2026-Q1"""
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_label(day: Column) -> Column:
    """Q1 '26"""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" '"), F.date_format(day, "yy"))


def month_label(day: Column) -> Column:
    """Jan '26"""
    return F.date_format(day, "MMM ''yy")


def signal_label(kind: Column) -> Column:
    """"size_decrease" as "Size decrease"; "Unverified" for none."""
    words = F.replace(kind, F.lit("_"), F.lit(" "))
    return F.when(F.coalesce(kind, F.lit("")) == "", "Unverified").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)))


def heading_parts(heading: Column) -> Column:
    """struct<brand, product> of a heading such as "Brand — Product"; null for headings that name no product."""
    head = F.trim(heading)
    brand, product = F.trim(F.regexp_extract(head, HEADING, 1)), F.trim(F.regexp_extract(head, HEADING, 2))
    other = reduce(lambda a, b: a | b, [F.lower(head).startswith(x) for x in NO_PRODUCT])
    fits = F.length(brand).between(2, 60) & F.length(product).between(2, 120) & ~other
    return F.when(fits, F.struct(brand.alias("brand"), product.alias("product")))


def article_fields(title: Column, hint: Column) -> Column:
    """struct<headline, outlet, article_type, tags> of an article's title and hint."""
    short, lower = F.substring(F.coalesce(title, F.lit("")), 1, 200), F.lower(F.coalesce(hint, F.lit("")))
    outlet = F.when(short.contains("—"), F.trim(F.element_at(F.split(short, "—"), -1))).when(short.contains(" - "), F.trim(F.element_at(F.split(short, " - "), -1)))
    headline = F.when(outlet.isNotNull(), F.trim(F.get(F.split(F.get(F.split(short, " — "), F.lit(0)), " - "), F.lit(0)))).otherwise(short)
    kind = F.when(lower.contains("skimpflation"), "skimpflation").when(lower.contains("downsiz"), "downsizing").otherwise("shrinkflation")
    tags = F.array_compact(F.array(*[F.when(F.lower(short).contains(t), t.capitalize()) for t in ARTICLE_TAGS]))
    return F.struct(headline.alias("headline"), outlet.alias("outlet"), kind.alias("article_type"), F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("News"))).alias("tags"))


def submission_error(brand: Column, product: Column, description: Column, url: Column) -> Column:
    """Why a reader's submission is refused; null if it isn't."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    bad_url = ~blank(url) & ~F.trim(url).rlike(r"(?i)^https?://[^\s/?#]+")
    return (
        F.when(blank(brand), "Brand is required").when(blank(product), "Product is required")
        .when(F.length(F.trim(F.coalesce(description, F.lit("")))) < 10, "Description must be at least 10 characters")
        .when(bad_url, "Evidence URL must be a valid http(s) URL")
    )


def submission(brand: Column, product: Column, description: Column, old_size: Column, new_size: Column, unit: Column, address: Column) -> Column:
    """The fields of a submission, trimmed and cut to their lengths, and a short hash of where it came from."""
    cut = lambda x, n: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, n)
    number = lambda x: F.trim(x).try_cast("double")
    first = F.coalesce(F.nullif(F.trim(F.get(F.split(F.coalesce(address, F.lit("")), ","), F.lit(0))), F.lit("")), F.lit("0.0.0.0"))
    return F.struct(
        cut(brand, 200).alias("brand"), cut(product, 200).alias("product_name"), cut(description, 4000).alias("description"), number(old_size).alias("old_size"), number(new_size).alias("new_size"),
        F.nullif(cut(unit, 16), F.lit("")).alias("size_unit"), F.substring(F.sha2(first, 256), 1, 24).alias("sender"),
    )


def page_address(base: str, kind: str, key: Column) -> Column:
    """Address of a page: base/kind/key, the key percent-encoded."""
    return F.concat(F.lit(f"{base}/{kind}/"), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")))
