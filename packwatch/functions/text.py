"""Text of brands, products and posts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Endings of company names, size tails of descriptions and noise in product names.
OWNER_SUFFIX = r"(?i),?\s*\b(inc\.?|llc\.?|ltd\.?|co\.?|corp\.?|corporation|company|l\.?l\.?c\.?|l\.?p\.?|plc|sa|gmbh|ag|pty|limited)\b\.?"
SIZE_TAIL = r"(?i)\s+\d[\d\s/.,]*\s*(?:ounces?|oz|pounds?|lbs?|count|ct|grams?|g|ml|fl\.?\s*oz|liters?|gallons?|gal|quarts?|qt|pints?|pt)\b.*$"
PACK_TAIL = r"(?i)\s+\d+\s+pack\b.*$"
SIZE_LABEL = r"(?i)\s+(?:party\s+size|family\s+size|king\s+size|snack\s+size|fun\s+size)(?:\s+\w+)?\s*$"
BRAND_SUFFIX = r"(?i)\s+(plc|inc|ltd|llc|gmbh|sa|co|corp|corporation|limited)\.?$"
MULTIPACK = r"(?i)\b\d+\s*x\s*\d+(\.\d+)?\s*(g|kg|ml|l|oz)\b"
SIZE_NOISE = r"(?i)\b\d+(\.\d+)?\s*(g|kg|ml|l|oz|lb|fl\s*oz|ct|count|pack|x)\b"
# Categories, tried in this order, by words in a text.
CATEGORY_WORDS = {
    "Beverages": r"juice|soda|water|drink|coffee|tea|milk|creamer|gatorade|powerade|lemonade|beer|wine|energy drink",
    "Snacks": r"chip[s]?|cookie|cracker|pretzel|popcorn|candy|chocolate|gum|snack|goldfish|cheeto|dorito|frito|pringles|oreo|ritz|wheat thin",
    "Cereal": r"cereal|oat|granola|cheerio|frosted flake|special k|raisin bran",
    "Paper Goods": r"paper towel|toilet paper|tissue|napkin|bounty|charmin|scott|cottonelle|kleenex",
    "Household": r"soap|shampoo|conditioner|detergent|cleaner|dish|laundry|tide|dawn|lysol|clorox|toothpaste|deodorant",
    "Frozen": r"ice cream|frozen|pizza|bagel bite|hot pocket|totino|digiorno|stouffer|lean cuisine",
    "Bakery": r"bread|bagel|muffin|roll|bun|tortilla|wrap|pita|croissant|english muffin",
    "Dairy": r"yogurt|cheese|butter|cream cheese|sour cream|cottage cheese|milk|egg",
    "Pantry": r"sauce|ketchup|mustard|mayo|dressing|salsa|soup|broth|pasta|rice|bean|canned",
    "Meat": r"chicken|beef|pork|turkey|bacon|sausage|hot dog|deli|meat|fish|shrimp|salmon",
    "Spreads": r"peanut butter|jam|jelly|honey|syrup|spread|nutella",
}
# Words that say a size went down, and how old and new sizes are named.
SHRINK_WORDS = (
    r"(?i)\b(shrinkflation|shrunk|smaller|reduced|less|shrank|downsized|downsizing|size cut|weight cut|ounces less|fewer ounces|net weight|same price|price increase|"
    r"got smaller|getting smaller|they reduced|they cut|less product|rip[- ]?off|same box|same package|smaller amount|used to be|went from|half the size|"
    r"thin[n]?er|narrower|shorter|lighter|watered down|diluted|fewer count|less sheets|less rolls|family size|not as big|getting ripped off)\b"
)
# Brands looked for in posts, tried in this order.
KNOWN_BRANDS = [
    "tropicana", "lays", "lay's", "doritos", "gatorade", "pepsi", "coca-cola", "coke", "hellmann's", "hellmanns", "unilever", "general mills", "cheerios", "nature valley", "tide", "dawn", "bounty",
    "charmin", "folgers", "maxwell house", "starbucks", "oreo", "nabisco", "mondelez", "campbell's", "campbells", "kraft", "heinz", "heinz ketchup", "kellogg's", "kelloggs", "special k",
    "frosted flakes", "quaker", "pepsico", "post", "planters", "skippy", "jif", "peanut butter", "trader joe's", "trader joes", "costco", "kirkland", "whole foods", "365", "ben & jerry's",
    "haagen-dazs", "breyers", "blue bell", "tyson", "perdue", "oscar mayer", "ball park", "hebrew national", "minute maid", "simply orange", "florida's natural", "colgate", "crest", "oral-b",
    "listerine", "febreze", "glad", "ziploc", "scotch-brite", "stouffer's", "lean cuisine", "marie callender's", "progresso", "amy's", "annie's", "horizon", "tostitos", "ruffles", "cheetos",
    "fritos", "sun chips", "pringles", "wheat thins", "triscuit", "ritz", "goldfish", "hershey", "reese's", "kit kat", "snickers", "m&m's", "twix", "nestle", "nescafe", "coffee mate", "dreyer's",
    "edy's", "tillamook", "chobani", "yoplait", "dannon", "oikos", "jimmy dean", "johnsonville", "hillshire", "goya", "old el paso", "taco bell", "mission", "barilla", "ragu", "prego", "classico",
    "bertolli", "hidden valley", "ranch", "french's", "grey poupon", "velveeta", "philadelphia", "sargento", "borden", "totino's", "digiorno", "red baron", "tombstone", "hot pocket", "hot pockets",
    "bagel bites", "frito-lay", "frito lay", "pepperidge farm", "smucker's", "smuckers", "welch's", "welchs", "aunt jemima", "pearl milling", "mrs butterworth", "wonder bread", "sara lee", "arnold",
    "dave's killer bread", "thomas'", "thomas", "entenmann's", "entenmanns", "little debbie", "hostess", "drake's", "scott", "cottonelle", "viva", "kleenex", "puffs", "huggies", "pampers", "luvs",
    "downy", "gain", "all", "arm & hammer", "oxiclean", "clorox", "lysol", "pine-sol", "mr clean", "dial", "irish spring", "dove", "ivory", "olay", "pantene", "head & shoulders", "suave", "tresemme",
    "toblerone", "cadbury", "lindt", "ghirardelli", "godiva", "red bull",
]
# Units and patterns of sizes and prices in posts.
_UNIT = r"(oz|fl\.?\s*oz|ounce[s]?|lb[s]?|pound[s]?|g|gram[s]?|kg|ml|ct|count|pack|sheet[s]?|roll[s]?|pt|pint[s]?|qt|quart[s]?|gal|gallon[s]?)?"
FROM_TO = (
    r"(?i)(?:from|was|went from|used to be|previously|old[:]?|originally|started at)\s+(\d+(?:\.\d+)?)\s*" + _UNIT
    + r"(?:\s*(?:to|now|→|->|-->|–|—|-|down to|reduced to|shrunk to|changed to)\s*)(\d+(?:\.\d+)?)\s*" + _UNIT
)
_ARROW_UNIT = r"(oz|fl\.?\s*oz|g|gram[s]?|ml|lb[s]?|ct|count|sheet[s]?|roll[s]?)"
ARROW = r"(?i)(\d+(?:\.\d+)?)\s*" + _ARROW_UNIT + r"\s*(?:→|->|-->|⟶|to|vs\.?|versus|down to)\s*(\d+(?:\.\d+)?)\s*" + _ARROW_UNIT + "?"
SIZE = (
    r"(?i)(\d+(?:\.\d+)?)\s*(oz|fl\.?\s*oz|ounce[s]?|lb[s]?|pound[s]?|g|gram[s]?|kg|ml|liter[s]?|l|ct|count|pack|piece[s]?|sheet[s]?|roll[s]?|"
    r"sq\.?\s*ft|pt|pint[s]?|qt|quart[s]?|gal|gallon[s]?)"
)
PRICE = r"(?i)\$\s*(\d+(?:\.\d{1,2})?)"
# Units of posts, without a plural s.
POST_UNITS = {"fl oz": "fl oz", "fl. oz": "fl oz", "ounce": "oz", "pound": "lb", "gram": "g", "liter": "l", "pint": "pt", "quart": "qt", "gallon": "gal", "sheet": "sheets", "roll": "rolls", "piece": "ct", "sq ft": "sq ft", "sq. ft": "sq ft"}


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_owner(brand: Column) -> Column:
    """Company name for grouping: no legal ending, leading "the", hyphen or punctuation."""
    name = F.regexp_replace(F.trim(F.lower(F.coalesce(brand, F.lit("")))), OWNER_SUFFIX, "")
    name = F.regexp_replace(name, r"(?i)^\s*the\s+", "")
    return _squeeze(F.regexp_replace(F.replace(name, F.lit("-"), F.lit(" ")), r"[^a-z0-9\s]", ""))


def normalize_description(text: Column) -> Column:
    return _squeeze(F.regexp_replace(F.replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), F.lit("-"), F.lit(" ")), r"[^a-z0-9\s]", ""))


def strip_size(text: Column) -> Column:
    """A description without its trailing size, pack count or size label."""
    for pattern in (SIZE_TAIL, PACK_TAIL, SIZE_LABEL):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def normalize_brand(brand: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(brand, F.lit("")))), BRAND_SUFFIX, ""), r"\s+", " "))


def fuzzy_name_key(name: Column) -> Column:
    """Sorted words of a name without sizes and punctuation."""
    text = F.lower(F.coalesce(name, F.lit("")))
    for pattern in (MULTIPACK, SIZE_NOISE, r"[^\w\s]"):
        text = F.regexp_replace(text, pattern, " ")
    return F.array_join(F.array_sort(F.array_remove(F.split(text, r"\s+"), "")), " ")


def _number(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.round(value, 3).cast("decimal(18,3)").cast("string"), "0+$", ""), r"\.$", "")
    return F.coalesce(text, F.lit("?"))


def size_bucket(old: Column, new: Column, unit: Column) -> Column:
    """"a→b" with the unit behind each known size, "?" for an unknown one."""
    unit = F.trim(F.lower(F.coalesce(unit, F.lit(""))))
    part = lambda x: F.when(x.isNull(), "?").otherwise(F.concat(_number(x), unit))
    return F.concat(part(old), F.lit("→"), part(new))


def entity_key(brand: Column, name: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lower(brand), F.lit("|"), F.lower(name))), 1, 16)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small letters else: Coca-Cola, M&M'S."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")


def category_guess(text: Column, default: str = "Other") -> Column:
    """The first category one of whose words stands in the text."""
    out = F.when(F.lit(False), "")
    for name, words in CATEGORY_WORDS.items():
        out = out.when(F.lower(text).rlike(words), name)
    return out.otherwise(default)


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), r"^www\.", "")


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return _squeeze(text)


def upc_variants(upc: Column) -> Column:
    """Digits of a code, with and without a leading zero; none below 8 digits."""
    digits = F.regexp_replace(F.coalesce(upc, F.lit("")), r"\D", "")
    other = F.when(digits.startswith("0"), F.substring(digits, 2, 64)).otherwise(F.concat(F.lit("0"), digits))
    return F.when(F.length(digits) < 8, F.array().cast("array<string>")).otherwise(F.array(digits, other))


def _post_unit(found: Column) -> Column:
    base = F.regexp_replace(F.trim(F.lower(found)), "s+$", "")
    return F.when(base == "", "oz").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in POST_UNITS.items() for x in kv]), base), base))


# Names of brands, the first of which counts.
KNOWN_BRANDS = [
    "tropicana", "lays", "lay's", "doritos", "gatorade", "pepsi", "coca-cola", "coke", "hellmann's", "hellmanns", "unilever", "general mills", "cheerios", "nature valley", "tide",
    "dawn", "bounty", "charmin", "folgers", "maxwell house", "starbucks", "oreo", "nabisco", "mondelez", "campbell's", "campbells", "kraft", "heinz", "heinz ketchup", "kellogg's",
    "kelloggs", "special k", "frosted flakes", "quaker", "pepsico", "post", "planters", "skippy", "jif", "peanut butter", "trader joe's", "trader joes", "costco", "kirkland",
    "whole foods", "365", "ben & jerry's", "haagen-dazs", "breyers", "blue bell", "tyson", "perdue", "oscar mayer", "ball park", "hebrew national", "minute maid", "simply orange",
    "florida's natural", "colgate", "crest", "oral-b", "listerine", "febreze", "glad", "ziploc", "scotch-brite", "stouffer's", "lean cuisine", "marie callender's", "progresso",
    "amy's", "annie's", "horizon", "tostitos", "ruffles", "cheetos", "fritos", "sun chips", "pringles", "wheat thins", "triscuit", "ritz", "goldfish", "hershey", "reese's", "kit kat",
    "snickers", "m&m's", "twix", "nestle", "nescafe", "coffee mate", "dreyer's", "edy's", "tillamook", "chobani", "yoplait", "dannon", "oikos", "jimmy dean", "johnsonville",
    "hillshire", "goya", "old el paso", "taco bell", "mission", "barilla", "ragu", "prego", "classico", "bertolli", "hidden valley", "ranch", "french's", "grey poupon", "velveeta",
    "philadelphia", "sargento", "borden", "totino's", "digiorno", "red baron", "tombstone", "hot pocket", "hot pockets", "bagel bites", "frito-lay", "frito lay", "pepperidge farm",
    "smucker's", "smuckers", "welch's", "welchs", "aunt jemima", "pearl milling", "mrs butterworth", "wonder bread", "sara lee", "arnold", "dave's killer bread", "thomas'", "thomas",
    "entenmann's", "entenmanns", "little debbie", "hostess", "drake's", "scott", "cottonelle", "viva", "kleenex", "puffs", "huggies", "pampers", "luvs", "downy", "gain", "all",
    "arm & hammer", "oxiclean", "clorox", "lysol", "pine-sol", "mr clean", "dial", "irish spring", "dove", "ivory", "olay", "pantene", "head & shoulders", "suave", "tresemme",
    "toblerone", "cadbury", "lindt", "ghirardelli", "godiva", "red bull",
]


def known_brand(text: Column, brands: list[str]) -> Column:
    """The first of the brands, in their order, that stands in a text in small letters between non-letters; null if none does.

    One pass looks at every place for the first brand that stands just there; of what
    is found the first in the order counts, which is what trying brand after brand gives.
    """
    if not brands:
        return F.lit(None).cast("string")
    places = F.regexp_extract_all(text, F.lit(rf"(?<![a-z])(?=({'|'.join(map(re.escape, brands))})(?![a-z]))"), F.lit(1))
    order = F.array(*map(F.lit, brands))
    first = F.array_min(F.transform(places, lambda b: F.array_position(order, b)))
    return F.get(order, (first - 1).cast("int"))


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_post(text: Column, brands: list[str], prices_once: bool = False) -> Column:
    """What a post says: brand, sizes, unit, prices, shrink words, and how many fields it fills.

    Sizes come from a from-to pair, else from an arrow ("16 oz -> 14 oz", "12oz vs
    10oz"); if neither names two different sizes, from the first and the last size
    if they differ and share a unit, and a single size is the new one.  Only the
    first two are explicit.  The old size is the larger one; the unit is that of the
    new size.  Brands are tried in their order and must stand between non-letters.

    Fields: a brand 1, explicit sizes 2, first and last size 1, a single size 0.
    Each price counts 1; with ``prices_once`` two or more count 1 and one alone 0.
    """
    found = F.struct(
        known_brand(F.lower(text), brands).alias("brand"), F.regexp_extract(text, FROM_TO, 0).alias("from_to"), F.regexp_extract_all(text, F.lit(SIZE), 1).cast("array<double>").alias("sizes"),
        F.transform(F.regexp_extract_all(text, F.lit(SIZE), 2), _post_unit).alias("units"), F.regexp_extract_all(text, F.lit(PRICE), 1).alias("prices"), F.coalesce(text.rlike(SHRINK_WORDS), F.lit(False)).alias("words"),
    )
    arrow = F.regexp_extract(text, ARROW, 0)
    return _bound(found, lambda f: _bound(F.when(f["from_to"] != "", f["from_to"]).otherwise(arrow), lambda m: _post(f, m, prices_once)))


def _post(found: Column, phrase: Column, prices_once: bool) -> Column:
    """A post's struct from what was found in it; phrase is the from-to pair or the arrow, each looked for once."""
    brand, sizes, units, prices = found["brand"], found["sizes"], found["units"], found["prices"]
    part = lambda k: F.when(found["from_to"] != "", F.regexp_extract(phrase, FROM_TO, k)).otherwise(F.regexp_extract(phrase, ARROW, k))
    a, b = (F.nullif(part(k), F.lit("")).cast("double") for k in (1, 3))
    explicit = F.coalesce(a != b, F.lit(False))
    own, other = F.when(b > a, part(2)).otherwise(part(4)), F.when(b > a, part(4)).otherwise(part(2))
    first, last = F.get(sizes, F.lit(0)), F.try_element_at(sizes, F.lit(-1))
    pair = ~explicit & (F.size(sizes) >= 2) & (first != last) & (F.get(units, F.lit(0)) == F.try_element_at(units, F.lit(-1)))
    single = ~explicit & (F.size(sizes) == 1)
    old_size = F.when(explicit, F.greatest(a, b)).when(pair, F.greatest(first, last))
    new_size = F.when(explicit, F.least(a, b)).when(pair, F.least(first, last)).when(single, first)
    unit = F.when(explicit, _post_unit(F.when(own != "", own).otherwise(other))).when(pair | single, F.get(units, F.lit(0)))
    old_price = F.when(F.size(prices) >= 2, F.get(prices, F.lit(0)).cast("double"))
    new_price = F.when(F.size(prices) >= 1, F.element_at(prices, -1).cast("double"))
    counted = [old_price] if prices_once else [old_price, new_price]
    fields = sum((x.isNotNull().cast("int") for x in (brand, *counted)), F.when(explicit, 2).when(pair, 1).otherwise(0))
    return F.struct(
        brand.alias("brand"), old_size.alias("old_size"), new_size.alias("new_size"), unit.alias("unit"),
        old_price.alias("old_price"), new_price.alias("new_price"), explicit.alias("explicit_from_to"),
        found["words"].alias("has_shrink_words"), fields.alias("fields_found"),
    )


def product_hint(text: Column) -> Column:
    """The first line of a post, without marks such as [META], up to 120 characters."""
    line = F.substring(F.get(F.split(F.trim(text), "\n"), F.lit(0)), 1, 120)
    for mark in ("META", "Discussion"):
        line = F.regexp_replace(line, rf"(?i)^\[?{mark}\]?\s*", "")
    return F.trim(line)


def confidence_tier(post: Column, auto: int = 4, review: int = 2) -> Column:
    fields, explicit, words = post["fields_found"], post["explicit_from_to"], post["has_shrink_words"]
    return (
        F.when((fields >= auto) & post["brand"].isNotNull() & explicit & words, "auto")
        .when((fields >= review) & words, "review")
        .when((fields >= auto) & explicit, "review")
        .otherwise("discard")
    )


def confidence_score(post: Column, dedicated: Column, has_vision: Column) -> Column:
    """0 to 100 from what a post says and where it stands."""
    points = lambda flag, n: F.when(flag, n).otherwise(0)
    return F.least(
        F.lit(100),
        points(post["explicit_from_to"], 25) + points(post["brand"].isNotNull(), 15) + F.least(post["fields_found"], F.lit(5)) * 8
        + points(dedicated, 10) + points(has_vision, 10) + points(post["old_price"].isNotNull() & post["new_price"].isNotNull(), 5),
    )


def parse_ingredients(text: Column, rounds: int = 10) -> Column:
    """Top-level ingredients in order; what stands in brackets is left out."""
    out = F.regexp_replace(F.trim(F.upper(F.coalesce(text, F.lit("")))), r"\.+$", "")
    for _ in range(rounds):
        out = F.regexp_replace(F.regexp_replace(out, r"\([^()]*\)", ""), r"\[[^\[\]]*\]", "")
    parts = F.transform(F.split(out, ","), lambda x: F.trim(x))
    parts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^CONTAINS?\s+\d+%?\s+OR\s+LESS\s+(OF:?\s*)?", "")))
    parts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^LESS\s+THAN\s+\d+%?\s+(OF:?\s*)?", "")))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~x.startswith("*"))


MONTH_NAMES = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def parse_period(text: Column) -> Column:
    """Month start of a period: a spreadsheet day number, YYYY-MM, YYYYMnn, Mon YYYY, Mon-YY or YYYY Mon, months by three letters or in full; a year of two digits is in this century."""
    text = F.trim(text)
    serial = F.when(text.rlike(r"^\d{5}$") & text.cast("string").between("34000", "55000"), F.date_add(F.lit("1899-12-30").cast("date"), F.when(text.rlike(r"^\d{5}$"), text).cast("int")))
    dash = F.when(text.rlike(r"^\d{4}-\d{2}"), F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01"))))
    coded = F.when(text.rlike(r"^\d{4}M\d{2}$"), F.try_to_date(F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 6, 2), F.lit("-01"))))
    year = lambda digits: F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits)
    month = lambda name: F.initcap(F.substring(name, 1, 3))
    parts = lambda pattern, y, m: F.when(text.rlike(pattern), F.try_to_date(F.concat_ws(" ", month(F.regexp_extract(text, pattern, m)), year(F.regexp_extract(text, pattern, y))), "MMM yyyy"))
    name_first = parts(rf"(?i)^({MONTH_NAMES})[-\s]+(\d{{4}}|\d{{2}})$", 2, 1)
    year_first = parts(rf"(?i)^(\d{{4}})\s+({MONTH_NAMES})$", 1, 2)
    return F.trunc(F.coalesce(serial, dash, coded, name_first, year_first), "month")


def canonical_json(payload: Column) -> Column:
    """A JSON text with the keys of every object in order and one space after each comma and colon; null where it isn't JSON.

    Key order is that of Spark's variant objects: by code unit.  Of a repeated key the
    text isn't valid.  Characters beyond ASCII stay as they are.
    """
    compact = F.to_json(F.try_parse_json(payload))
    tokens = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*"|[,:]|[^",:]+'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), "")


def content_hash(payload: Column) -> Column:
    """SHA-256 of the canonical form of a JSON payload, or of the text itself where it isn't JSON; null for null."""
    return F.sha2(F.coalesce(canonical_json(payload), payload), 256)
