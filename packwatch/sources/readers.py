"""Readers of landed files, by name, each with its own parsing and filters.

Files are read by Spark's sources with a schema, so no pass infers one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

POSTS = "id string, title string, selftext string, subreddit string, score long, created_utc long, url string"
NEWS_ITEM = "title string, link string, pubDate string, description string, source string"
PRICES = "id long, product_code string, price double, currency string, date string, location struct<osm_name:string,osm_address_city:string,osm_address_country:string>"
PRODUCT = "code string, product_name string, brands string, quantity string, categories string, ingredients_text string"


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts as JSON lines, the first of each id."""
    rows = spark.read.schema(POSTS).json(path).where("id is not null")
    return rows.groupBy("id").agg(F.min(F.struct("created_utc", "title", "selftext", "subreddit", "score", "url")).alias("r")).select("id", "r.*").withColumn("source_date", F.to_date(F.timestamp_seconds("created_utc")))


def news(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files."""
    rows = spark.read.schema(NEWS_ITEM).option("rowTag", "item").format("xml").load(path)
    return rows.withColumn("published", F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^\w{3}, ", ""), " (GMT|[+]0000)$", ""), F.lit("dd MMM yyyy HH:mm:ss")))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Price observations with their place; rows without a code or price go."""
    rows = spark.read.schema(PRICES).json(path).where("product_code is not null and price is not null")
    return rows.select("id", "product_code", "price", "currency", F.to_date("date").alias("date"), F.col("location.osm_name").alias("store"), F.col("location.osm_address_city").alias("city"), F.col("location.osm_address_country").alias("country"))


def products(spark: SparkSession, path: str) -> DataFrame:
    """Product records with a parsed size."""
    from ..functions.units import parse_package_weight

    rows = spark.read.schema(PRODUCT).json(path).where("code is not null")
    return rows.withColumn("size", parse_package_weight(F.col("quantity")))


def series_csv(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """observation_date and value of a CSV series; "." is a missing value; only days after ``since``."""
    rows = spark.read.schema("observation_date date, value double").option("header", True).option("nullValue", ".").csv(path)
    return rows.where(F.col("observation_date") > F.lit(since).cast("date")) if since else rows


def branded_foods(spark: SparkSession, foods: str, descriptions: str) -> DataFrame:
    """A release's products joined with their descriptions, the first of each code, with a hash of the ingredients."""
    read = lambda path, schema: spark.read.schema(schema).option("header", True).csv(path)
    rows = read(foods, "fdc_id long, brand_owner string, gtin_upc string, ingredients string, package_weight string")
    text = read(descriptions, "fdc_id long, description string")
    first = rows.where("gtin_upc is not null").groupBy("gtin_upc").agg(F.min(F.struct("fdc_id", "brand_owner", "ingredients", "package_weight")).alias("r")).select("gtin_upc", "r.*")
    return first.join(text, "fdc_id", "left").withColumn("ingredients_hash", F.md5("ingredients"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files with their address."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


STORE_PRODUCT = "_store_id string, _term string, _seq long, _product string"


def recent_posts(primary: DataFrame, fallback: DataFrame, after: int, least: int = 3) -> DataFrame:
    """Posts newer than a cursor; where the first source has fewer than ``least``, those of the second too, each id once, the first source's before the second's."""
    new = lambda rows, place: rows.where(F.col("created_utc") > after).withColumn("place", F.lit(place))
    found = new(primary, 0)
    if len(found.select("created_utc").take(least)) < least:
        found = found.unionByName(new(fallback, 1), allowMissingColumns=True)
    rest = [c for c in found.columns if c not in ("id", "place", "created_utc")]
    return found.where("id <> ''").groupBy("id").agg(F.min(F.struct("place", "created_utc", *rest)).alias("r")).select("id", "r.*").drop("place")


def backfill(posts: DataFrame, before: int | None, page: int = 100, pages: int = 500) -> DataFrame:
    """The posts next before a cursor, the newest first, as many as so many pages hold; the smallest created_utc is the next cursor."""
    rows = posts if before is None else posts.where(F.col("created_utc") < before)
    return rows.orderBy(F.desc("created_utc"), "id").limit(page * pages)


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``; rows with a null in a key go."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r")).select(*keys, "r.*")


def _store_products(spark: SparkSession, path: str, ids: list[str], source: str) -> DataFrame:
    rows = spark.read.schema(STORE_PRODUCT).json(path)
    product = F.from_json("_product", ", ".join(f"{i} string" for i in ids))
    rows = rows.select(F.col("_store_id").alias("store"), F.nullif(F.coalesce(*[product[i] for i in ids]), F.lit("")).alias("product_id"), F.col("_seq").alias("seq"), F.col("_term").alias("term"), F.col("_product").alias("payload"))
    rows = rows.withColumn("store", F.coalesce("store", F.lit("")))
    return keep_last(rows, ["store", "product_id"], "seq").withColumn("source_type", F.lit(source))


def kroger_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products of a chain's stores as JSON lines, the last record of each store and product; records without an id go."""
    return _store_products(spark, path, ["productId"], "kroger_catalog")


def walmart_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The same of the other chain."""
    return _store_products(spark, path, ["itemId"], "walmart_catalog")


def report_findings(pages: DataFrame) -> DataFrame:
    """Brands and products named by headings of report pages, with the paragraph behind each heading; one row for each page, brand and product in any case.

    pages: url, html.  Headings of the second and third level count; those that name
    no product are left out.
    """
    from ..functions.records import heading_parts
    from ..functions.text import strip_html

    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), 1)
    behind = F.regexp_extract_all("html", F.lit(r"(?is)</h[23]>((?:(?!<h[23][ >]).)*)"), 1)
    title = F.nullif(strip_html(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    rows = pages.select("url", title.alias("title"), F.posexplode(F.arrays_zip(blocks.alias("head"), behind.alias("text"))).alias("place", "b"))
    rows = rows.select("url", "title", "place", strip_html(F.col("b.head")).alias("head"), F.nullif(strip_html(F.regexp_extract("b.text", r"(?is)<p[^>]*>(.*?)</p>", 1)), F.lit("")).alias("excerpt"))
    rows = rows.withColumn("h", heading_parts(F.col("head"))).where("h is not null")
    first = F.min(F.struct("place", F.coalesce("title", "head").alias("title"), F.col("h.brand").alias("brand"), F.col("h.product").alias("product_name"), "excerpt")).alias("r")
    return rows.groupBy("url", F.lower("h.brand").alias("b"), F.lower("h.product").alias("p")).agg(first).select("url", "r.title", "r.brand", "r.product_name", "r.excerpt")


def series_of_sheet(sheet: DataFrame) -> DataFrame:
    """series, period (a month's first day), value of a sheet that is tall (columns series, period, value) or wide (a column for each period); empty cells and unreadable periods go."""
    from ..functions.text import parse_period

    names = {c.lower().strip(): c for c in sheet.columns}
    if "period" in names:
        number = next(c for k, c in names.items() if k not in ("series", "period"))
        tall = sheet.select(F.col(names["series"]).alias("series"), F.col(names["period"]).cast("string").alias("p"), F.col(number).cast("double").alias("value"))
    else:
        label, *rest = sheet.columns
        tall = sheet.select(F.col(label).alias("series"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot(["series"], rest, "p", "value")
    rows = tall.select(F.lower(F.trim("series")).alias("series"), parse_period(F.col("p")).alias("period"), "value")
    return rows.where("series <> '' and period is not null and value is not null")


READERS: dict[str, Callable] = {"posts": posts, "news": news, "prices": prices, "products": products, "series_csv": series_csv, "branded_foods": branded_foods, "pages": pages, "kroger_catalog": kroger_catalog, "walmart_catalog": walmart_catalog}
