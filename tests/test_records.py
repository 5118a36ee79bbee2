import json

import pytest
from pyspark.sql import functions as F

from packwatch.functions import records as R


def all_of(spark, values, column, schema="t string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)
    return [r.x.asDict(True) if hasattr(r.x, "asDict") else r.x for r in frame.select("k", column.alias("x")).orderBy("k").collect()]


def claim(brand, name, category, size, unit, price, shop, upc, day, what, parts):
    c_brand, c_name, overall = parts
    return {"brand": brand, "product_name": name, "category": category, "new_size": size, "new_size_unit": unit, "new_price": price, "retailer": shop, "upc": upc, "observed_date": day, "change_description": what, "is_shrinkflation": False,
            "confidence": {"brand": c_brand, "product_name": c_name, "size_change": 0.0, "overall": pytest.approx(overall)}}


CASES = [
    ("openfoodfacts", {"code": "12", "product_name": " Chips ", "brands": "lay's", "quantity": "10 oz", "categories": "Salty snack"}, claim("Lay'S", "Chips", "snacks", 10.0, "oz", None, None, "12", None, "catalog_entry", (0.9, 0.9, 0.9))),
    ("openfoodfacts", {"code": 7, "product_name": "Milk", "product_quantity": 500, "product_quantity_unit": "GRM", "quantity": "1 l"}, claim(None, "Milk", None, 500.0, "g", None, None, "7", None, "catalog_entry", (0.0, 0.9, 0.6))),
    ("openfoodfacts", {"brands": "B", "product_quantity": "0", "quantity": "none", "categories": "tools"}, claim("B", None, "other", None, None, None, None, None, None, "catalog_entry", (0.9, 0.0, 0.3))),
    ("openfoodfacts", {"code": "1"}, None),
    ("kroger_api", {"description": "Bread", "brand": "KROGER", "upc": "", "productId": "9", "itemInformation": {"size": "1 lb 4 oz"}, "items": [{"price": {"regular": 0, "promo": 2.5}}], "categories": ["Bakery", "Bread"]}, claim("Kroger", "Bread", "bread", 20.0, "oz", 2.5, "Kroger", "9", None, "catalog_entry", (0.95, 0.95, 2.8 / 3))),
    ("kroger_api", {"description": "X", "items": [], "categories": []}, claim(None, "X", None, None, None, None, "Kroger", None, None, "catalog_entry", (0.0, 0.95, 0.95 / 3))),
    ("kroger_api", {"size": "1 oz"}, None),
    ("openprices", {"barcode": "5", "product": {"product_name": "Tea", "brands": "acme"}, "price": "3.5", "date": "", "created": "2024-05-06T01:00", "location": {"name": "Shop"}}, claim("Acme", "Tea", None, None, None, 3.5, "Shop", "5", "2024-05-06", "price_observation", (0.8, 0.8, 0.8))),
    ("openprices", {"product_code": "5", "price": -1, "date": "May"}, claim(None, None, None, None, None, None, None, "5", None, "price_observation", (0.0, 0.0, 0.0))),
    ("openprices", {"price": 1}, None),
    ("walmart", {"name": "Cola 12 fl oz", "itemId": 44, "salePrice": 0, "msrp": "1.25", "categoryPath": "Food/Soda"}, claim(None, "Cola 12 fl oz", "beverages", 12.0, "fl oz", 1.25, "Walmart", "44", None, "catalog_entry", (0.0, 0.95, 1.85 / 3))),
    ("elsewhere", {"name": "x"}, None), ("walmart", "not json", None),
]


def test_catalog_claims(spark):
    rows = [(kind, p if isinstance(p, str) else json.dumps(p)) for kind, p, _ in CASES]
    got = all_of(spark, rows, R.catalog_claim(F.col("kind"), F.col("p")), "kind string, p string")
    assert got == [expected for *_, expected in CASES]


def test_claims_are_coerced(spark):
    response = {"brand": "  ", "product_name": "Bar", "old_size": "12.5", "new_size": -1, "old_price": "x", "upc": 12, "observed_date": "2024-05", "is_shrinkflation": True, "confidence": {"brand": 1.7, "product_name": "-2", "size_change": "0.5", "overall": None}}
    full, broken, odd = all_of(spark, [json.dumps(response), "{", json.dumps({"observed_date": "2024", "confidence": "high"})], R.coerced_claim(F.col("t")))
    assert (full["brand"], full["product_name"], full["old_size"], full["new_size"], full["old_price"], full["upc"], full["observed_date"], full["is_shrinkflation"]) == (None, "Bar", 12.5, None, None, "12", "2024-05-01", True)
    assert full["confidence"] == {"brand": 1.0, "product_name": 0.0, "size_change": 0.5, "overall": 0.0} and full["change_description"] == "extraction_failed"
    for empty in (broken, odd):
        assert empty["change_description"] == "extraction_failed" and empty["observed_date"] is None and set(empty["confidence"].values()) == {0.0} and not empty["is_shrinkflation"]


@pytest.mark.parametrize("payload,expected", [
    ({"socialimage": "https://a/b", "url": "https://c/d.jpg"}, "https://a/b"), ({"socialimage": "none", "url": "https://c/d.JPG?x=1"}, "https://c/d.JPG?x=1"), ({"url": "https://c/page", "preview": {"images": [{"source": {"url": "https://p/?a=1&amp;b=2"}}]}}, "https://p/?a=1&b=2"),
    ({"media_metadata": {"m1": {"s": {}}, "m2": {"s": {"u": "https://g/&amp;x"}}}}, "https://g/&x"), ({"thumbnail": "self"}, None), ({"thumbnail": "https://t/i.png"}, "https://t/i.png"), ({}, None), (None, None),
])
def test_image_of_a_payload(spark, payload, expected):
    assert all_of(spark, [json.dumps(payload) if payload is not None else None], R.image_url(F.col("t"))) == [expected]


def test_names_in_texts(spark):
    assert all_of(spark, ["seen at Trader Joe's today", "targeted", "my local KROGER, then walmart", None], R.retailer_in(F.col("t"))) == ["Trader Joe'S", None, "Kroger", None]
    assert all_of(spark, ["BBC News", "Financial Times via BBC", "Some Blog", None], R.is_free_outlet(F.col("t"))) == [True, False, False, False]
    assert all_of(spark, ["0123456789012", "123456789012", "1234567", "CLAIM-1", None], R.ean13(F.col("t"))) == ["0123456789012", "0123456789012", None, None, None]
    assert all_of(spark, ["0123456789012", "1-23456 789012", "12345678", "1234567", "reddit-12345678", None], R.product_codes(F.col("t"))) == [["0123456789012", "123456789012"], ["123456789012", "0123456789012"], ["12345678"], [], [], []]
    assert all_of(spark, ["size_decrease", "", None], R.signal_label(F.col("t"))) == ["Size decrease", "Unverified", "Unverified"]
    heads = all_of(spark, ["Acme — Crackers", "How to: shop", "A - b", "Folgers: Coffee - dark", "none", None, "The Acme - Bar"], R.heading_parts(F.col("t")))
    assert [h and tuple(h.values()) for h in heads] == [("Acme", "Crackers"), None, None, ("Folgers", "Coffee - dark"), None, None, None]
    days = all_of(spark, ["2026-01-31", "2026-12-01"], F.concat_ws("|", R.quarter_key(F.col("t").cast("date")), R.quarter_label(F.col("t").cast("date")), R.month_label(F.col("t").cast("date"))))
    assert days == ["2026-Q1|Q1 '26|Jan '26", "2026-Q4|Q4 '26|Dec '26"]


def test_posts_off_the_subject(spark):
    rows = [("[Removed by moderator] x", None, None, ["This is not shrinkflation."]), ("x", "[removed]", None, ["Not an example of shrinkflation"]), ("x", None, "moderator", ["Thanks"]), ("x", "y", None, ["not shrinkflation"]), ("[removed]", None, None, None), (None, None, "automod", [None, "Rule 3: not shrinkflation"])]
    assert all_of(spark, rows, R.removed_as_off_topic(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "a string, b string, c string, d array<string>") == [True, True, False, False, False, True]


def test_articles_and_submissions(spark):
    got = all_of(spark, [("Data shows smaller bars - BBC", "Downsizing"), ("Bars — old and new — The Hill", None), ("Plain", "skimpflation"), (None, None)], R.article_fields(F.col("a"), F.col("b")), "a string, b string")
    assert [(x["headline"], x["outlet"], x["article_type"], x["tags"]) for x in got] == [("Data shows smaller bars", "BBC", "downsizing", ["Data"]), ("Bars", "The Hill", "shrinkflation", ["News"]), ("Plain", None, "skimpflation", ["News"]), ("", None, "shrinkflation", ["News"])]
    rows = [(" ", "p", "long enough text", None), ("b", None, "long enough text", None), ("b", "p", "short", None), ("b", "p", "long enough text", "ftp://x"), ("b", "p", "long enough text", "https://x/y"), ("b", "p", "long enough text", None)]
    errors = all_of(spark, rows, R.submission_error(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "a string, b string, c string, d string")
    assert [bool(e) for e in errors] == [True, True, True, True, False, False]
    x = all_of(spark, [(" b" + "x" * 300, "12.5", "abc", " 10.0.0.1, 2")], R.submission(F.col("a"), F.lit("p"), F.lit("d"), F.col("b"), F.col("c"), F.lit(" "), F.col("d")), "a string, b string, c string, d string")[0]
    import hashlib

    assert (len(x["brand"]), x["old_size"], x["new_size"], x["size_unit"], x["sender"]) == (200, 12.5, None, None, hashlib.sha256(b"10.0.0.1").hexdigest()[:24])
    assert all_of(spark, ["m&m's x"], R.page_address("https://s", "brands", F.col("t"))) == ["https://s/brands/m%26m%27s%20x"]
