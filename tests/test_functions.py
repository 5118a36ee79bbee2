import pytest
from pyspark.sql import functions as F

from packwatch.functions import classify as C, text as T, units as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("6 oz", (6.0, "oz")), ("340g", (340.0, "g")), ("1 LB 4 OZ", (20.0, "oz")), ("6 oz/170 g", (6.0, "oz")), ("each / 2.5 kg", (2.5, "kg")), ("12 FL OZ (355 ml)", (12.0, "fl oz")),
    ("16.9 FL. OZ", (16.9, "fl oz")), ("2 KGM", (2.0, "kg")), ("1 gal", (1.0, "g")), ("assorted", None), ("", None), (None, None), ("   ", None),
])
def test_package_weights(spark, text, expected):
    got = one(spark, U.parse_package_weight(F.col("t")), t=text)
    assert (tuple(got) if got else None) == expected


def test_strict_weights_end_with_the_word(spark):
    assert tuple(one(spark, U.parse_package_weight(F.col("t"), strict=True), t="1 gal")) == (1.0, "gal")


@pytest.mark.parametrize("unit,expected", [("Ounces", "oz"), (" fl  oz ", "fl oz"), ("ONZ", "oz"), ("boxes", "boxes"), ("", "oz"), (None, "oz"), ("lbs", "lb"), ("packs", "ct")])
def test_units(spark, unit, expected):
    assert one(spark, U.normalize_unit(F.col("t")), t=unit) == expected


@pytest.mark.parametrize("value,unit,expected", [(2.0, "kg", (2000.0, "g")), (1.0, "lb", (16.0, "oz")), (3.0, "ct", (3.0, "ct")), (1.0, "gal", (128.0, "fl oz"))])
def test_base_units(spark, value, unit, expected):
    assert tuple(one(spark, U.convert_to_base(F.col("v"), F.col("u")), v=value, u=unit)) == expected


@pytest.mark.parametrize("old,new,p,q,kind,severity", [(10, 8, 5, 5, "shrinkflation", "major"), (100, 93, 5, 5, "shrinkflation", "moderate"), (100, 99, 5, 5, "shrinkflation", "minor"), (10, 8, 5, 4, "downsizing", "major"), (8, 10, 5, 5, "upsizing", "minor"), (10, 10, 5, 6, "price_hike", "minor"), (10, 10, 5, 5, "downsizing", "minor")])
def test_classify(spark, old, new, p, q, kind, severity):
    got = one(spark, C.classify_change(F.col("a"), F.col("b"), F.col("p"), F.col("q")), a=float(old), b=float(new), p=float(p), q=float(q))
    assert (got["change_type"], got["severity"]) == (kind, severity)


@pytest.mark.parametrize("pct,kind,severity", [(-25.0, "shrinkflation", "major"), (-20.0, "shrinkflation", "moderate"), (-5.0, "shrinkflation", "minor"), (0.0, "shrinkflation", "minor"), (5.0, "restoration", "minor"), (5.1, "upsizing", "minor")])
def test_published_scale(spark, pct, kind, severity):
    assert tuple(one(spark, C.classify_published(F.col("p")), p=pct)) == (kind, severity)


@pytest.mark.parametrize("function,text,expected", [
    (T.normalize_owner, "THE FRITO-LAY, INC.", "frito lay"), (T.normalize_owner, "Kellogg's Company", "kelloggs"), (T.normalize_owner, "General Mills, Inc", "general mills"), (T.normalize_owner, None, ""),
    (T.normalize_description, "  Honey-Nut  Cheerios  ", "honey nut cheerios"), (T.strip_size, "Lay's Classic Potato Chips 10 Ounce Plastic Bag", "Lay's Classic Potato Chips"),
    (T.strip_size, "Hershey's Soft Donut Bites 72 Count", "Hershey's Soft Donut Bites"), (T.strip_size, "CAMPBELL'S SOUP TOMATO", "CAMPBELL'S SOUP TOMATO"),
    (T.title_case, "coca-cola m&m's", "Coca-Cola M&M'S"), (T.slugify, "M&M's Peanut!", "mmspeanut"), (T.fuzzy_name_key, "Oat Bars 2 x 40 g, New", "bars new oat"), (T.url_domain, "https://www.Example.com/a", "example.com"),
    (T.strip_html, "<p>a &amp; b</p><script>x</script>", "a & b"), (T.category_guess, "Orange Juice", "Beverages"), (T.category_guess, "spanner", "Other"),
])
def test_texts(spark, function, text, expected):
    assert one(spark, function(F.col("t")), t=text) == expected


def test_ingredients(spark):
    got = one(spark, T.parse_ingredients(F.col("t")), t="Water, potatoes (dehydrated (flakes), salt), contains 2% or less of: sugar, *trace.")
    assert got == ["WATER", "POTATOES", "SUGAR"]


def test_post(spark):
    got = one(spark, T.parse_post(F.col("t"), ["oreo"]), t="Oreo went from 14.3 oz to 13.29 oz, same price $4.29")
    assert (got["brand"], got["old_size"], got["new_size"], got["unit"], got["new_price"], got["explicit_from_to"], got["has_shrink_words"], got["fields_found"]) == ("oreo", 14.3, 13.29, "oz", 4.29, True, True, 4)
    assert one(spark, T.confidence_tier(T.parse_post(F.col("t"), ["oreo"])), t="Oreo went from 14.3 oz to 13.29 oz, same price $4.29") == "auto"
    assert one(spark, T.confidence_tier(T.parse_post(F.col("t"), ["oreo"])), t="I like Oreo") == "discard"


@pytest.mark.parametrize("text,sizes,explicit,fields", [
    ("Oreo 16 oz -> 14 oz", (16.0, 14.0, "oz"), True, 3), ("12oz vs 10oz", (12.0, 10.0, "oz"), True, 2), ("10 sheets to 12", (12.0, 10.0, "sheets"), True, 2), ("14 oz versus 1 lb", (14.0, 1.0, "lb"), True, 2),
    ("Oreo: the 500 g box is a 450 gram box today", (500.0, 450.0, "g"), False, 2), ("450 grams, before that 480 g, long ago 500 g", (500.0, 450.0, "g"), False, 1), ("Oreo, 12 oz", (None, 12.0, "oz"), False, 1),
    ("a 2 lb bag and a 14 oz bag", (None, None, None), False, 0), ("was 12 oz now 12 oz", (None, None, None), False, 0), ("from 12 oz to 12 oz, 10 oz next", (12.0, 10.0, "oz"), False, 1), ("used to be 5 now 8 sheets", (8.0, 5.0, "sheets"), True, 2),
    ("no size", (None, None, None), False, 0), (None, (None, None, None), False, 0),
])
def test_sizes_of_a_post(spark, text, sizes, explicit, fields):
    got = one(spark, T.parse_post(F.col("t"), ["oreo"]), t=text)
    assert ((got["old_size"], got["new_size"], got["unit"]), got["explicit_from_to"], got["fields_found"]) == (sizes, explicit, fields)


def test_prices_of_a_post_can_count_once(spark):
    got = [one(spark, T.parse_post(F.col("t"), [], prices_once=once), t=text)["fields_found"] for text in ("$3.49, now $3.99", "$3.99") for once in (False, True)]
    assert got == [2, 1, 1, 0]


@pytest.mark.parametrize("text,expected", [("2021-03", "2021-03-01"), ("2021M07", "2021-07-01"), ("44197", "2021-01-01"), ("Jan 2020", "2020-01-01"), ("2020 Dec", "2020-12-01"), ("Jan 21", "2021-01-01"), ("jan-21", "2021-01-01"), ("January 2021", "2021-01-01"), ("2021 september", "2021-09-01"), ("2021-13", None), ("Foo 2021", None), ("later", None), (None, None)])
def test_periods(spark, text, expected):
    got = one(spark, T.parse_period(F.col("t")), t=text)
    assert (str(got) if got else None) == expected


def test_brands_and_hints_of_posts(spark):
    got = one(spark, T.parse_post(F.col("t"), T.KNOWN_BRANDS, prices_once=True), t="My M&M's bag: 12 oz -> 10 oz, $3.49 then $3.99")
    assert (got["brand"], got["old_size"], got["new_size"], got["fields_found"]) == ("m&m's", 12.0, 10.0, 4)
    assert one(spark, T.parse_post(F.col("t"), T.KNOWN_BRANDS), t="an agressive and pastoral day")["brand"] is None
    assert [one(spark, T.product_hint(F.col("t")), t=t) for t in ("[META] Smaller bags\nmore", "discussion  bars", "x" * 200, None)] == ["Smaller bags", "bars", "x" * 120, None]


@pytest.mark.parametrize("kind,severity,events,action", [("sku_mashup", "high", 3.0, "retract_entity"), ("sku_mashup", "med", 3.0, "leave"), ("size_outlier", "high", 1.0, "retract_event"), ("short_brand", "med", 0.0, "retract_entity"), ("short_brand", "med", 2.0, "leave"), ("fuzzy_brand_collision", "low", 1.0, "merge"), ("mixed_units", "low", 1.0, "leave")])
def test_triage(spark, kind, severity, events, action):
    assert one(spark, C.flag_action(F.col("k"), F.col("s"), F.col("n"), F.lit(False), F.lit(False)), k=kind, s=severity, n=events) == action
