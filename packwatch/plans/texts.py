"""The text and unit functions over strings made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, units as U
from .base import query, read

# Strings of the kinds that the functions meet, one for each product.
_SIZES = """CASE p_partkey % 9 WHEN 0 THEN concat(p_size, ' oz') WHEN 1 THEN concat(p_size, 'g') WHEN 2 THEN concat('1 LB ', p_size, ' OZ') WHEN 3 THEN concat(p_size, '.5 fl. oz/', p_size * 28, ' g')
  WHEN 4 THEN concat(p_size, ' Fluid  Ounces (pack)') WHEN 5 THEN 'assorted' WHEN 6 THEN concat('about ', p_size, ' gal') WHEN 7 THEN NULL ELSE concat('each / ', p_size, ' KGM') END"""
_UNITS = "CASE p_partkey % 7 WHEN 0 THEN 'Ounces' WHEN 1 THEN ' fl  oz ' WHEN 2 THEN 'GRM' WHEN 3 THEN 'boxes' WHEN 4 THEN '' WHEN 5 THEN 'pounds' ELSE NULL END"
_OWNERS = "CASE p_partkey % 6 WHEN 0 THEN concat('THE ', p_name, ', INC.') WHEN 1 THEN concat(p_brand, ' Company') WHEN 2 THEN concat(p_name, '-Lay Corp') WHEN 3 THEN concat('  ', p_name, '''s  L.L.C. ') WHEN 4 THEN concat(p_brand, ' GmbH') ELSE NULL END"
_NAMES = "CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' ', p_size, ' Ounce Plastic Bag') WHEN 1 THEN concat(p_name, ' Family Size') WHEN 2 THEN concat(p_name, ' 12 Pack') WHEN 3 THEN concat('Big ', p_name, ' 2 x ', p_size, ' g, new!') WHEN 4 THEN concat(p_name, ' ', p_size, ' FL OZ') ELSE p_name END"
_POSTS = """CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' went from ', p_size + 2, ' oz to ', p_size, ' oz and it is $3.99 now, was $3.49') WHEN 1 THEN concat('My ', p_name, ' used to be ', p_size, ' now ', p_size + 3, ' sheets')
  WHEN 2 THEN concat('Shrunk! ', p_name, ' is smaller, $', p_size, '.50') WHEN 3 THEN concat('I like the ', p_name) WHEN 4 THEN concat('same price, was ', p_size + 1, ' grams -> ', p_size, ' grams (', p_name, ')') WHEN 5 THEN concat('[META] ', p_name, ' ', p_size + 4, ' oz -> ', p_size, ' oz, fewer ounces') WHEN 6 THEN concat('The ', p_size + 2, ' g ', p_name, ' box holds ', p_size, ' grams, smaller') WHEN 7 THEN concat(p_name, ' with ', p_size, ' ct') ELSE NULL END"""
BRANDS = ["widget", "gizmo", "bolt", "ring", "gear", "rod"]


def _strings(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name", F.expr(sql.replace("'''s", r"'\'s")).alias("t"))


def _q(text: str) -> str:
    return text.replace("'", "''")


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{_q(str(k))}' THEN '{_q(str(v))}'" for k, v in table.items()) + " END"


def _unit(raw: str) -> str:
    key = rf"trim(regexp_replace(lower({raw}), '\s+', ' ', 'g'))"
    return f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN 'oz' ELSE coalesce({_case(U.UNITS, key)}, {_case(U.UNITS, f'rtrim({key}, ' + chr(39) + 's' + chr(39) + ')')}, {key}) END"


_N = _q(U.NUMBER_UNIT)
_LB = _q(U.POUNDS_OUNCES)
_PARSED = f"""SELECT p_partkey, t, CASE WHEN regexp_extract(t, '{_LB}', 1) <> '' THEN regexp_extract(t, '{_LB}', 1)::DOUBLE * 16 + regexp_extract(t, '{_LB}', 2)::DOUBLE ELSE try_cast(nullif(regexp_extract(pick, '{_N}', 1), '') AS DOUBLE) END AS value,
  CASE WHEN regexp_extract(t, '{_LB}', 1) <> '' THEN 'oz' WHEN regexp_extract(pick, '{_N}', 1) <> '' THEN {_unit(f"regexp_extract(pick, '{_N}', 2)")} END AS unit
FROM (SELECT *, CASE WHEN contains(t, '/') AND regexp_matches(split_part(t, '/', 1), '{_N}') THEN split_part(t, '/', 1) WHEN contains(t, '/') AND regexp_matches(substr(t, position('/' IN t) + 1), '{_N}') THEN substr(t, position('/' IN t) + 1)
  WHEN contains(t, '(') AND regexp_matches(split_part(t, '(', 1), '{_N}') THEN split_part(t, '(', 1) ELSE t END AS pick FROM (SELECT p_partkey, trim({_SIZES}) AS t FROM part))"""


@query("parse_package_weight", f"SELECT p_partkey, value, unit FROM ({_PARSED})")
def parse_package_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _SIZES).withColumn("p", U.parse_package_weight(F.col("t"))).select("p_partkey", "p.value", "p.unit")


@query("convert_to_base", f"""
SELECT p_partkey, value * CASE unit {' '.join(f"WHEN '{k}' THEN {float(v[1])}" for k, v in U.BASE_UNITS.items())} ELSE 1.0::DOUBLE END AS value, coalesce({_case({k: v[0] for k, v in U.BASE_UNITS.items()}, 'unit')}, unit) AS unit,
  {_case(U.FAMILIES, f"coalesce({_case({k: v[0] for k, v in U.BASE_UNITS.items()}, 'unit')}, unit)")} AS family FROM ({_PARSED})""")
def convert_to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strings(spark, sf_dir, _SIZES).withColumn("p", U.parse_package_weight(F.col("t"))).withColumn("b", U.convert_to_base(F.col("p.value"), F.col("p.unit")))
    return rows.select("p_partkey", "b.value", "b.unit", U.unit_family(F.col("b.unit")).alias("family"))


@query("normalize_unit", f"SELECT p_partkey, {_unit('t')} AS unit FROM (SELECT p_partkey, {_UNITS} AS t FROM part)")
def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _UNITS).select("p_partkey", U.normalize_unit(F.col("t")).alias("unit"))


def _sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{_q(pattern)}', '{to}', 'g')"


_CLEAN = lambda x: f"trim({_sub(_sub(f'replace({x}, {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})', '[^a-z0-9 ]'), ' +', ' ')})"


@query("normalize_owner", f"""SELECT p_partkey, {_CLEAN(_sub(_sub("trim(lower(coalesce(t, '')))", T.OWNER_SUFFIX), '(?i)^ *the +'))} AS owner, {_CLEAN("trim(lower(coalesce(t, '')))")} AS description FROM (SELECT p_partkey, {_OWNERS} AS t FROM part)""")
def normalize_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _OWNERS).select("p_partkey", T.normalize_owner(F.col("t")).alias("owner"), T.normalize_description(F.col("t")).alias("description"))


@query("normalize_brand", f"SELECT p_partkey, trim({_sub(_sub(chr(108) + 'ower(trim(coalesce(t, ' + chr(39) * 2 + ')))', T.BRAND_SUFFIX), ' +', ' ')}) AS brand FROM (SELECT p_partkey, {_OWNERS} AS t FROM part)")
def normalize_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _OWNERS).select("p_partkey", T.normalize_brand(F.col("t")).alias("brand"))


@query("strip_size", f"SELECT p_partkey, trim({_sub(_sub(_sub('t', T.SIZE_TAIL), T.PACK_TAIL), T.SIZE_LABEL)}) AS name FROM (SELECT p_partkey, {_NAMES} AS t FROM part)")
def strip_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMES).select("p_partkey", T.strip_size(F.col("t")).alias("name"))


@query("slugify", f"SELECT p_partkey, {_sub('lower(t)', '[^a-z0-9]+')} AS slug FROM (SELECT p_partkey, {_NAMES} AS t FROM part)")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMES).select("p_partkey", T.slugify(F.col("t")).alias("slug"))


_KEY = f"array_to_string(list_sort(list_filter(string_split_regex({_sub(_sub(_sub('lower(t)', T.MULTIPACK, ' '), T.SIZE_NOISE, ' '), '[^0-9A-Za-z_ ]', ' ')}, ' +'), lambda x: x <> '')), ' ')"


@query("fuzzy_name_key", f"SELECT p_partkey, {_KEY} AS key FROM (SELECT p_partkey, {_NAMES} AS t FROM part)")
def fuzzy_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMES).select("p_partkey", T.fuzzy_name_key(F.col("t")).alias("key"))


@query("size_bucket", """SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE concat(rtrim(rtrim(CAST(CAST(p_size / 4 AS DECIMAL(18, 3)) AS VARCHAR), '0'), '.'), 'oz') END, '→', p_size, 'oz') AS bucket FROM part""")
def size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    old = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 4)
    return part.select("p_partkey", T.size_bucket(old, F.col("p_size").cast("double"), F.lit(" OZ")).alias("bucket"))


@query("entity_key", "SELECT p_partkey, substring(md5(concat(lower(p_brand), '|', lower(p_name))), 1, 16) AS key FROM part")
def entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.entity_key(F.col("p_brand"), F.col("p_name")).alias("key"))


@query("title_case", f"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+'), lambda x: concat(upper(x[1:1]), lower(x[2:]))), '') AS name FROM (SELECT p_partkey, coalesce({_OWNERS}, '') AS t FROM part)""")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, f"coalesce({_OWNERS}, '')").select("p_partkey", T.title_case(F.col("t")).alias("name"))


@query("category_guess", f"""SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(lower(t), '{_q(w)}') THEN '{c}'" for c, w in T.CATEGORY_WORDS.items())} ELSE 'Other' END AS category
FROM (SELECT p_partkey, concat({_NAMES}, CASE p_partkey % 5 WHEN 0 THEN ' Orange Juice' WHEN 1 THEN ' chips' WHEN 2 THEN ' Cheese' ELSE '' END) AS t FROM part)""")
def category_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, f"concat({_NAMES}, CASE p_partkey % 5 WHEN 0 THEN ' Orange Juice' WHEN 1 THEN ' chips' WHEN 2 THEN ' Cheese' ELSE '' END)").select("p_partkey", T.category_guess(F.col("t")).alias("category"))


@query("upc_variants", "SELECT p_partkey, unnest(CASE WHEN length(d) < 8 THEN [] WHEN d[1:1] = '0' THEN [d, d[2:]] ELSE [d, concat('0', d)] END) AS code FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('0', 10000000 + p_partkey) WHEN 1 THEN concat(4000000 + p_partkey, '1') ELSE CAST(p_partkey AS VARCHAR) END AS d FROM part)")
def upc_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE p_partkey % 3 WHEN 0 THEN concat('0-', 10000000 + p_partkey) WHEN 1 THEN concat(4000000 + p_partkey, ' 1') ELSE CAST(p_partkey AS STRING) END"
    return _strings(spark, sf_dir, raw).select("p_partkey", F.explode(T.upc_variants(F.col("t"))).alias("code"))


_F = _q(T.FROM_TO)
_POST = f"""SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(lower(t), '(^|[^a-z]){b}([^a-z]|$)') THEN '{b}'" for b in BRANDS)} END AS brand, greatest(a, b) AS old_size, least(a, b) AS new_size,
  CASE WHEN a IS NULL THEN NULL WHEN u = '' THEN 'oz' ELSE coalesce({_case(T.POST_UNITS, 'u')}, u) END AS unit, CASE WHEN len(p) >= 2 THEN p[1]::DOUBLE END AS old_price, CASE WHEN len(p) >= 1 THEN p[-1]::DOUBLE END AS new_price,
  a IS NOT NULL AS explicit_from_to, coalesce(regexp_matches(t, '{_q(T.SHRINK_WORDS)}'), false) AS has_shrink_words
FROM (SELECT *, try_cast(nullif(regexp_extract(t, '{_F}', 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(t, '{_F}', 3), '') AS DOUBLE) AS b, rtrim(trim(lower(coalesce(nullif(regexp_extract(t, '{_F}', 4), ''), regexp_extract(t, '{_F}', 2)))), 's') AS u,
  regexp_extract_all(t, '{_q(T.PRICE)}', 1) AS p FROM (SELECT p_partkey, {_POSTS} AS t FROM part))"""
# What the posts of each kind say, by how they were made: old size, new size, unit, whether they stand in one phrase.
_SAID = """SELECT *, CASE k WHEN 0 THEN p_size + 2 WHEN 1 THEN p_size + 3 WHEN 4 THEN p_size + 1 WHEN 5 THEN p_size + 4 WHEN 6 THEN p_size + 2 END::DOUBLE AS old_size, CASE WHEN k IN (0, 1, 4, 5, 6, 7) THEN p_size END::DOUBLE AS new_size,
  CASE k WHEN 0 THEN 'oz' WHEN 1 THEN 'sheets' WHEN 4 THEN 'g' WHEN 5 THEN 'oz' WHEN 6 THEN 'g' WHEN 7 THEN 'ct' END AS unit, k IN (0, 1, 4, 5) AS explicit_from_to, CASE WHEN k = 0 THEN 3.99::DOUBLE END AS old_price, CASE k WHEN 0 THEN 3.49 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS new_price, k IN (0, 1, 2, 4, 5, 6) AS has_shrink_words,
  CASE WHEN k < 8 THEN string_split(p_name, ' ')[2] END AS said, CASE WHEN k = 5 THEN substr(t, 8) ELSE t END AS product_hint FROM (SELECT p_partkey, p_size, p_name, p_partkey % 9 AS k, {posts} AS t FROM part)"""
_POST = f"""SELECT p_partkey, CASE WHEN said IN ({", ".join(map(repr, BRANDS))}) THEN said END AS brand, old_size, new_size, unit, old_price, new_price, explicit_from_to, has_shrink_words, product_hint,
  CASE WHEN said IN ({", ".join(map(repr, BRANDS))}) THEN 1 ELSE 0 END + CASE WHEN explicit_from_to THEN 2 WHEN old_size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN old_price IS NOT NULL THEN 1 ELSE 0 END AS fields_found FROM ({_SAID.format(posts=_POSTS)})"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _POSTS).withColumn("post", T.parse_post(F.col("t"), BRANDS, prices_once=True))


@query("parse_text_nlp", f"SELECT * FROM ({_POST})")
def parse_text_nlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of posts; two prices count as one field, one alone as none."""
    return _posts(spark, sf_dir).select("p_partkey", "post.*", T.product_hint(F.col("t")).alias("product_hint"))


# Texts that name two known brands, some with letters next to them or in capitals, in the words of a product.
_BRANDED = "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' x' WHEN 1 THEN '-' ELSE '' END, {0}, CASE p_partkey % 5 WHEN 0 THEN 's ' ELSE ', ' END, {1}, CASE p_partkey % 7 WHEN 0 THEN 'ish' ELSE '' END, ' ', p_brand)"
_ORDER = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in T.KNOWN_BRANDS) + "]"
_NAMED = [f"(p_partkey * {m} + p_size) % {len(T.KNOWN_BRANDS)}" for m in (1, 7)]


@query("known_brands", f"""SELECT p_partkey, list_filter({_ORDER}, lambda b: regexp_matches(t, '(^|[^a-z])' || regexp_escape(b) || '([^a-z]|$)'))[1] AS brand FROM (SELECT p_partkey, lower({_BRANDED.format(f"{_ORDER}[{_NAMED[0]} + 1]", f"upper({_ORDER}[{_NAMED[1]} + 1])")}) AS t FROM part)""")
def known_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known brand that a text names, the first in the order of the list."""
    order = F.array(*map(F.lit, T.KNOWN_BRANDS))
    rows = read(spark, sf_dir, "part").withColumns({f"b{k}": F.get(order, F.expr(f"CAST({n} AS INT)")) for k, n in enumerate(_NAMED)})
    return rows.select("p_partkey", T.known_brand(F.lower(F.expr(_BRANDED.format("b0", "upper(b1)"))), T.KNOWN_BRANDS).alias("brand"))


@query("confidence_tier", f"""SELECT p_partkey, CASE WHEN f >= 4 AND brand IS NOT NULL AND explicit_from_to AND has_shrink_words THEN 'auto' WHEN f >= 2 AND has_shrink_words THEN 'review' WHEN f >= 4 AND explicit_from_to THEN 'review' ELSE 'discard' END AS tier FROM (SELECT *, fields_found AS f FROM ({_POST}))""")
def confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("p_partkey", T.confidence_tier(F.col("post")).alias("tier"))


@query("confidence_score", f"""SELECT p_partkey, least(100, (CASE WHEN explicit_from_to THEN 25 ELSE 0 END) + (CASE WHEN brand IS NOT NULL THEN 15 ELSE 0 END) + least(fields_found, 5) * 8 + (CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 0 END)
  + (CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 0 END) + (CASE WHEN old_price IS NOT NULL AND new_price IS NOT NULL THEN 5 ELSE 0 END)) AS score FROM ({_POST})""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("p_partkey", T.confidence_score(F.col("post"), F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 5 == 0).alias("score"))


@query("url_domain", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"))


_HTML = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("strip_html", f"SELECT page_id, md5({_HTML}) AS text_md5, length({_HTML}) AS n_chars FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.strip_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


# Pages with a size in each of the layers, a decoy beside it, and of two retailers.
_PAGE_HTML = """CASE p_partkey % 10 WHEN 0 THEN concat('<script type="application/ld+json">{"@type":"Product","weight":{"@type":"Q","value":"', p_size, '","unitText":"GRM"}}</script><title>Box 5 oz</title>') WHEN 1 THEN concat('<div data-product-size="', p_size, ' fl oz"></div><title>Box 5 oz</title>')
  WHEN 2 THEN concat('<th>Item Weight</th><td>', p_size, ' pounds</td><title>Box 5 oz</title>') WHEN 3 THEN concat('<meta property="og:title" content="', p_name, ' ', p_size, ' g"><title>Box 5 oz</title>') WHEN 4 THEN concat('<title>', p_name, ' &amp; co, ', p_size, ' ct</title><p>99 g</p>')
  WHEN 5 THEN concat('<title>', p_name, '</title><body><p>Over 25 grams of joy</p>Net weight: ', p_size, ' g</body>') WHEN 6 THEN concat('<title>', p_name, '</title><meta name="product:weight" content="', p_size, ' kg">') WHEN 7 THEN concat('<title>', p_name, '</title><body><b>Contents:</b> ', p_size, ' ounces</body>')
  WHEN 8 THEN concat('<title>', p_name, '</title><body>Over 25 grams of joy</body>') ELSE NULL END"""
_PAGE_URL = "CASE p_partkey % 10 WHEN 1 THEN 'https://www.walmart.com/ip/1' WHEN 2 THEN 'https://www.amazon.com/dp/1' ELSE 'https://shop.example/1' END"


@query("html_size_extract", """SELECT concat('p', p_partkey) AS page, CASE WHEN p_partkey % 10 < 8 THEN p_size END::DOUBLE AS size, (['g', 'fl oz', 'lb', 'g', 'ct', 'g', 'kg', 'oz'])[p_partkey % 10 + 1] AS unit, (['json_ld', 'walmart_data_attr', 'amazon_detail_table', 'og_title', 'title', 'spec_label', 'spec_label', 'body_text'])[p_partkey % 10 + 1] AS method FROM part""")
def html_size_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a page from the first layer that has one, with its unit and the layer."""
    from ..functions.pages import size_from_html

    # the files are small and the work on a page is not, so rows are dealt to all cores first
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    made = rows.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("page"), F.expr(_PAGE_HTML).alias("html"), F.expr(_PAGE_URL).alias("url"))
    return made.withColumn("r", size_from_html(F.col("html"), F.col("url"))).select("page", "r.size", "r.unit", "r.method")


_PERIODS = "CASE o_orderkey % 6 WHEN 0 THEN substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) WHEN 1 THEN concat(year(o_orderdate), 'M', lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0')) WHEN 2 THEN CAST(34700 + o_orderkey % 2000 AS VARCHAR(5)) WHEN 3 THEN 'Mar 1998' WHEN 4 THEN '1999 Nov' ELSE 'n/a' END"


@query("period_parse", f"""SELECT o_orderkey, CAST(date_trunc('month', CASE WHEN regexp_matches(t, '^\\d{{5}}$') AND t BETWEEN '34000' AND '55000' THEN DATE '1899-12-30' + t::INT WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}') THEN CAST(concat(t[1:7], '-01') AS DATE)
  WHEN regexp_matches(t, '^\\d{{4}}M\\d{{2}}$') THEN CAST(concat(t[1:4], '-', t[6:7], '-01') AS DATE) WHEN t = 'Mar 1998' THEN DATE '1998-03-01' WHEN t = '1999 Nov' THEN DATE '1999-11-01' END) AS DATE) AS month FROM (SELECT o_orderkey, {_PERIODS} AS t FROM orders)""")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PERIODS.replace("VARCHAR(10)", "STRING").replace("VARCHAR(2)", "STRING").replace("VARCHAR(5)", "STRING")).alias("t")).select("o_orderkey", T.parse_period(F.col("t")).alias("month"))


# The payload of an event with its props within, in either order of keys, with odd spaces.
_PAYLOAD = """CASE WHEN event_id % 2 = 0 THEN concat('{"user_id":', user_id, ' ,"props":', props, ',"event_type":"', event_type, '"}') ELSE concat('{"props": ', props, ', "event_type": "', event_type, '", "user_id": ', user_id, '}') END"""


@query("content_hash", """SELECT event_id, sha256(concat('{"event_type": "', event_type, '", "props": {"k": ', json_extract_string(props, '$.k'), '}, "user_id": ', user_id, '}')) AS hash FROM events""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the whole payload, whatever the order of its keys."""
    return read(spark, sf_dir, "events").select("event_id", T.content_hash(F.expr(_PAYLOAD)).alias("hash"))


# Records of four catalogs, one for each product.
_RECORDS = """CASE p_partkey % 5 WHEN 0 THEN concat('{"code":"', p_partkey, '","product_name":" ', p_name, ' ","brands":"', lower(p_brand), '","quantity":"', p_size, ' oz","categories":"', CASE WHEN p_size > 25 THEN 'Salty Snacks' ELSE 'Tools' END, '"}')
  WHEN 1 THEN concat('{"description":"', p_name, '","brand":"', CASE WHEN p_size > 40 THEN '' ELSE p_brand END, '","productId":"', p_partkey, '","itemInformation":{"size":"1 lb ', p_size, ' oz"},"items":[{"price":{"regular":0,"promo":', p_size, '.5}}],"categories":["Dairy","Milk"]}')
  WHEN 2 THEN concat('{"product_code":"', p_partkey, '","product":{"product_name":"', p_name, '"},"price":"', p_size, '.25","date":"2024-05-06T00:00","location":{"osm_name":"Shop ', p_size, '"}}')
  WHEN 3 THEN concat('{"name":"', p_name, ' ', p_size, ' fl oz","itemId":', p_partkey, ',"msrp":"', p_size - 20, '","categoryPath":"Home/', p_type, '"}') ELSE '{"code":"1"}' END"""
_CATALOG = "CASE p_partkey % 5 WHEN 1 THEN 'kroger_api' WHEN 2 THEN 'openprices' WHEN 3 THEN 'walmart' ELSE 'openfoodfacts' END"
_TITLED = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: concat(upper(x[1:1]), lower(x[2:]))), '')"


@query("catalog_claims", f"""SELECT p_partkey, CASE k WHEN 0 THEN {_TITLED.format("p_brand")} WHEN 1 THEN CASE WHEN p_size <= 40 THEN {_TITLED.format("p_brand")} END END AS brand, CASE WHEN k < 3 THEN p_name ELSE concat(p_name, ' ', p_size, ' fl oz') END AS product_name,
  CASE k WHEN 0 THEN CASE WHEN p_size > 25 THEN 'snacks' ELSE 'other' END WHEN 1 THEN 'dairy' WHEN 3 THEN 'other' END AS category, CASE k WHEN 0 THEN p_size WHEN 1 THEN 16 + p_size WHEN 3 THEN p_size END::DOUBLE AS new_size, CASE k WHEN 0 THEN 'oz' WHEN 1 THEN 'oz' WHEN 3 THEN 'fl oz' END AS new_size_unit,
  CASE k WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size + 0.25 WHEN 3 THEN CASE WHEN p_size > 20 THEN p_size - 20 END END::DOUBLE AS new_price, CASE k WHEN 1 THEN 'Kroger' WHEN 2 THEN concat('Shop ', p_size) WHEN 3 THEN 'Walmart' END AS retailer, CAST(p_partkey AS VARCHAR) AS upc, CASE k WHEN 2 THEN '2024-05-06' END AS observed_date,
  round(CASE k WHEN 0 THEN 0.9 WHEN 1 THEN least(0.95, ((CASE WHEN p_size <= 40 THEN 0.95 ELSE 0 END) + 0.95 + 0.9) / 3) WHEN 2 THEN 1.6 / 3 ELSE 1.85 / 3 END::DOUBLE, 6) AS overall
FROM (SELECT *, p_partkey % 5 AS k FROM part) WHERE k < 4""")
def catalog_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read from catalog records by their source's parser; a record without a name gives none."""
    from ..functions.records import catalog_claim

    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(_CATALOG).alias("source"), F.expr(_RECORDS).alias("payload"))
    found = rows.withColumn("c", catalog_claim(F.col("source"), F.col("payload"))).where("c is not null")
    return found.select("p_partkey", *[f"c.{x}" for x in ("brand", "product_name", "category", "new_size", "new_size_unit", "new_price", "retailer", "upc", "observed_date")], F.round("c.confidence.overall", 6).alias("overall"))


_RESPONSES = """concat('{"brand":"', CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE 'Acme ' END, '","old_size":', CASE o_orderkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '"12.5"' ELSE '"many"' END, ',"new_size":', o_custkey, ',"observed_date":"', CASE o_orderkey % 3 WHEN 0 THEN '2024' WHEN 1 THEN '2024-05' ELSE '2024-05-06' END,
  '","is_shrinkflation":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"confidence":{"overall":', o_orderkey % 30, ',"brand":"', CASE WHEN o_orderkey % 5 = 0 THEN 'high' ELSE '0.5' END, '"}', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '}' END)"""


@query("coerced_claims", """SELECT o_orderkey, CASE WHEN ok AND o_orderkey % 4 <> 0 THEN 'Acme' END AS brand, CASE WHEN ok AND o_orderkey % 3 = 1 THEN 12.5 END::DOUBLE AS old_size, CASE WHEN ok AND o_custkey > 0 THEN o_custkey END::DOUBLE AS new_size, CASE WHEN ok THEN CASE o_orderkey % 3 WHEN 1 THEN '2024-05-01' WHEN 2 THEN '2024-05-06' END END AS observed_date,
  ok AND o_orderkey % 2 = 0 AS is_shrinkflation, CASE WHEN ok THEN least(1, o_orderkey % 30) ELSE 0 END::DOUBLE AS overall, CASE WHEN ok AND o_orderkey % 5 <> 0 THEN 0.5 ELSE 0 END::DOUBLE AS of_brand, 'extraction_failed' AS change_description FROM (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders)""")
def coerced_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor responses as claims of the right types; a broken one is a failed extraction."""
    from ..functions.records import coerced_claim

    rows = read(spark, sf_dir, "orders").select("o_orderkey", coerced_claim(F.expr(_RESPONSES)).alias("c"))
    return rows.select("o_orderkey", "c.brand", "c.old_size", "c.new_size", "c.observed_date", "c.is_shrinkflation", F.col("c.confidence.overall").alias("overall"), F.col("c.confidence.brand").alias("of_brand"), "c.change_description")


_PAYLOADS = """CASE event_id % 6 WHEN 0 THEN concat('{"socialimage":"https://img/', user_id, '"}') WHEN 1 THEN concat('{"url":"https://i/', user_id, '.JPG?x=1"}') WHEN 2 THEN concat('{"url":"https://page/","preview":{"images":[{"source":{"url":"https://p/', user_id, '?a=1&amp;b=2"}}]}}')
  WHEN 3 THEN concat('{"media_metadata":{"m":{"s":{"u":"https://g/', user_id, '"}}}}') WHEN 4 THEN concat('{"thumbnail":"', CASE WHEN user_id % 2 = 0 THEN 'self' ELSE 'https://t/i.png' END, '"}') ELSE NULL END"""


@query("payload_images", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('https://img/', user_id) WHEN 1 THEN concat('https://i/', user_id, '.JPG?x=1') WHEN 2 THEN concat('https://p/', user_id, '?a=1&b=2') WHEN 3 THEN concat('https://g/', user_id) WHEN 4 THEN CASE WHEN user_id % 2 = 1 THEN 'https://t/i.png' END END AS image FROM events""")
def payload_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the image of each payload is."""
    from ..functions.records import image_url

    return read(spark, sf_dir, "events").select("event_id", image_url(F.expr(_PAYLOADS)).alias("image"))


@query("product_codes", """SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN [concat('0', 100000000000 + p_partkey), CAST(100000000000 + p_partkey AS VARCHAR)] WHEN 1 THEN [CAST(100000000000 + p_partkey AS VARCHAR), concat('0', 100000000000 + p_partkey)] WHEN 2 THEN [CAST(10000000 + p_partkey AS VARCHAR)] ELSE [] END) AS code FROM part""")
def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of product codes for look-ups; made-up and short ones have none."""
    from ..functions.records import product_codes as forms

    raw = "CASE p_partkey % 5 WHEN 0 THEN concat('0-', 100000000000 + p_partkey) WHEN 1 THEN concat(100000000000 + p_partkey, ' ') WHEN 2 THEN CAST(10000000 + p_partkey AS STRING) WHEN 3 THEN concat('Reddit-', 10000000 + p_partkey) ELSE '1234567' END"
    return _strings(spark, sf_dir, raw).select("p_partkey", F.explode(forms(F.col("t"))).alias("code"))
