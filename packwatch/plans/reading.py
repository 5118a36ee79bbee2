"""Read-side analytics: headline figures, charts, baskets, rollups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.search import holding
from ..operators.series import month_spine, run_summary, spaced, year_over_year
from ..session import shared_folder
from ..sources.paging import Pages, write_sorted
from .base import TABLES, query, view
from .views import AS_OF

view("bls_headline", """
WITH s AS (SELECT extract(YEAR FROM o_orderdate) * 100 + extract(MONTH FROM o_orderdate) AS period, count(*) AS n FROM {ord} WHERE o_orderpriority = '1-URGENT' GROUP BY extract(YEAR FROM o_orderdate) * 100 + extract(MONTH FROM o_orderdate)),
r AS (SELECT period, n, row_number() OVER (ORDER BY period DESC) AS place FROM s)
SELECT a.period AS latest_period, a.n AS latest, b.n AS previous, c.n AS year_before, round((a.n - c.n) * 100.0 / nullif(c.n, 0) + 1e-9, 1) AS yoy_pct
FROM r a LEFT JOIN r b ON b.place = 2 LEFT JOIN s c ON c.period = a.period - 100 WHERE a.place = 1""")


@query("fred_yoy", "SELECT a.month, a.value, b.value AS year_before, round((a.value - b.value) / b.value * 100, 2) AS yoy_pct FROM {cpi} a LEFT JOIN {cpi} b ON b.month = CAST(a.month - INTERVAL 1 YEAR AS DATE)")
def fred_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with its value twelve months earlier, by month and not by row."""
    return year_over_year(TABLES["cpi"](spark, sf_dir), "month", "value")


@query("insight_chart", f"""WITH m AS (SELECT CAST(unnest(range(DATE '{AS_OF}' - INTERVAL 38 MONTH, DATE '{AS_OF}' + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month),
e AS (SELECT CAST(date_trunc('month', observed_date) AS DATE) AS month, count(*) AS events, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrinks FROM {{pub}} WHERE NOT is_retracted GROUP BY 1)
SELECT m.month, coalesce(events, 0) AS events, coalesce(shrinks, 0) AS shrinks, value AS cpi FROM m LEFT JOIN e ON e.month = m.month LEFT JOIN {{cpi}} c ON c.month = m.month""")
def insight_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """39 months without gaps: events, shrinks and the index."""
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted")
    events = live.groupBy(F.trunc("observed_date", "month").alias("month")).agg(F.count("*").alias("events"), F.count(F.when(F.col("change_type") == "shrinkflation", 1)).alias("shrinks"))
    spine = month_spine(spark, AS_OF, 39)
    out = spine.join(events, "month", "left").join(TABLES["cpi"](spark, sf_dir), "month", "left")
    return out.select("month", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("shrinks", F.lit(0)).alias("shrinks"), F.col("value").alias("cpi"))


view("shrink_vs_inflation", """
WITH s AS (SELECT extract(YEAR FROM observed_date) AS y, count(*) AS shrinks FROM {pub} WHERE change_type = 'shrinkflation' AND NOT is_retracted GROUP BY extract(YEAR FROM observed_date)),
c AS (SELECT extract(YEAR FROM month) AS y, round(avg(value) + 1e-6, 2) AS mean_value, count(*) AS months FROM {cpi} GROUP BY extract(YEAR FROM month) HAVING count(*) >= 6)
SELECT CAST(c.y AS INT) AS year, c.mean_value AS mean_value, p.mean_value AS year_before, c.months < 12 AS partial, coalesce(shrinks, 0) AS shrinks FROM c LEFT JOIN c p ON p.y = c.y - 1 LEFT JOIN s ON s.y = c.y""")


@query("cart_basket", """WITH e AS (SELECT entity_id, brand, arg_min(size_before, observed_date) AS first_size, arg_max(size_after, observed_date) AS last_size FROM {pub} WHERE NOT is_retracted AND image_url IS NOT NULL GROUP BY entity_id, brand),
p AS (SELECT *, round((last_size - first_size) / first_size * 100, 2) AS pct FROM e), q AS (SELECT *, row_number() OVER (PARTITION BY lower(brand) ORDER BY pct, entity_id) AS r FROM p WHERE pct BETWEEN -60 AND -1.5)
SELECT entity_id, brand, first_size, last_size, pct FROM q WHERE r = 1 ORDER BY pct, entity_id LIMIT 12""")
def cart_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest falls over a product's life, one for each brand."""
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted and image_url is not null")
    ends = live.groupBy("entity_id", "brand").agg(F.min_by("size_before", "observed_date").alias("first_size"), F.max_by("size_after", "observed_date").alias("last_size"))
    rows = ends.withColumn("pct", F.round((F.col("last_size") - F.col("first_size")) / F.col("first_size") * 100, 2)).where("pct between -60 and -1.5")
    best = rows.groupBy(F.lower("brand").alias("b")).agg(F.min(F.struct("pct", "entity_id", "brand", "first_size", "last_size")).alias("r"))
    return best.select("r.entity_id", "r.brand", "r.first_size", "r.last_size", "r.pct").orderBy("pct", "entity_id").limit(12)


view("top_offenders", "SELECT entity_id, brand, count(*) AS n, min(size_delta_pct) AS worst FROM {pub} WHERE change_type = 'shrinkflation' AND NOT is_retracted GROUP BY entity_id, brand ORDER BY n DESC, worst, entity_id LIMIT 8")
view("home_most_active", f"SELECT brand, count(*) AS n, min(size_delta_pct) AS worst FROM {{pub}} WHERE observed_date >= DATE '{AS_OF}' - INTERVAL '14' DAY AND NOT is_retracted GROUP BY brand ORDER BY n DESC, brand LIMIT 6")
view("home_recent_shrinks", f"SELECT event_id, brand, size_delta_pct, observed_date FROM {{pub}} WHERE observed_date >= DATE '{AS_OF}' - INTERVAL '180' DAY AND size_delta_pct BETWEEN -50 AND -5 AND NOT is_retracted")
view("home_brand_of_week", f"""
SELECT brand, n, days FROM (SELECT brand, count(*) AS n, 14 AS days FROM {{pub}} WHERE observed_date >= DATE '{AS_OF}' - INTERVAL '14' DAY AND change_type = 'shrinkflation' GROUP BY brand
UNION ALL SELECT brand, count(*) AS n, 30 AS days FROM {{pub}} WHERE observed_date >= DATE '{AS_OF}' - INTERVAL '30' DAY AND change_type = 'shrinkflation' GROUP BY brand) t ORDER BY days, n DESC, brand LIMIT 1""")
view("home_counters", "SELECT (SELECT count(*) FROM {pub} WHERE NOT is_retracted) AS events, (SELECT count(*) FROM {ent}) AS products, (SELECT count(DISTINCT brand) FROM {ent}) AS brands, (SELECT count(*) FROM {claims} WHERE status = 'pending') AS pending")

# The evidence channels, in the order in which they are shown.
CHANNELS = ["view", "click", "purchase", "signup", "error", "photo", "receipt"]


@query("tag_counts", f"SELECT t.tag, t.place, count(r.raw_id) AS n FROM (SELECT unnest([{', '.join(repr(c) for c in CHANNELS)}]) AS tag, unnest(range(1, {len(CHANNELS) + 1}))::INT AS place) t LEFT JOIN {{raw}} r ON r.source_type = t.tag GROUP BY t.tag, t.place")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by channel, those without any included."""
    tags = spark.createDataFrame([(c, k + 1) for k, c in enumerate(CHANNELS)], "tag string, place int")
    counts = TABLES["raw"](spark, sf_dir).groupBy(F.col("source_type").alias("tag")).agg(F.count("*").alias("n"))
    return F.broadcast(tags).join(counts, "tag", "left").select("tag", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("timeline_buckets", """WITH s AS (SELECT brand, unnest(range(min(extract(year FROM observed_date))::INT, max(extract(year FROM observed_date))::INT + 1))::INT AS year FROM {pub} GROUP BY brand),
n AS (SELECT brand, extract(year FROM observed_date)::INT AS year, count(*) AS n FROM {pub} WHERE severity = 'major' AND NOT is_retracted GROUP BY 1, 2)
SELECT s.brand, s.year, coalesce(n, 0) AS n FROM s LEFT JOIN n ON n.brand = s.brand AND n.year = s.year""")
def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major events of a brand in each year from its first to its last."""
    events = TABLES["pub"](spark, sf_dir)
    ends = events.groupBy("brand").agg(F.min(F.year("observed_date")).alias("a"), F.max(F.year("observed_date")).alias("b"))
    years = ends.select("brand", F.explode(F.sequence("a", "b")).alias("year"))
    n = events.where("severity = 'major' and not is_retracted").groupBy("brand", F.year("observed_date").alias("year")).agg(F.count("*").alias("n"))
    return years.join(n, ["brand", "year"], "left").select("brand", "year", F.coalesce("n", F.lit(0)).alias("n"))


view("product_rollup", "SELECT brand, entity_id, product_name, count(*) AS events, min(size_delta_pct) AS worst_pct, max(observed_date) AS latest, count(DISTINCT store) AS stores FROM {pub} WHERE NOT is_retracted GROUP BY brand, entity_id, product_name")
view("dominant_manufacturer", "SELECT brand, manufacturer, n FROM (SELECT brand, manufacturer, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, manufacturer) AS r FROM {ent} WHERE manufacturer IS NOT NULL GROUP BY brand, manufacturer) t WHERE r = 1")
view("brand_tiers", "SELECT tier, count(*) AS brands, sum(n) AS events FROM (SELECT brand, count(*) AS n, CASE WHEN count(*) >= 11 THEN '11+' WHEN count(*) >= 6 THEN '6-10' WHEN count(*) >= 2 THEN '2-5' ELSE '1' END AS tier FROM {pub} WHERE severity = 'major' GROUP BY brand) t GROUP BY tier", "SELECT tier, count(*) AS brands, sum(n)::BIGINT AS events FROM (SELECT brand, count(*) AS n, CASE WHEN count(*) >= 11 THEN '11+' WHEN count(*) >= 6 THEN '6-10' WHEN count(*) >= 2 THEN '2-5' ELSE '1' END AS tier FROM {pub} WHERE severity = 'major' GROUP BY brand) t GROUP BY tier")
view("category_tally", "SELECT concat(upper(substring(category, 1, 1)), lower(substring(category, 2, 99))) AS category, count(DISTINCT brand) AS brands, count(*) AS products FROM {ent} GROUP BY concat(upper(substring(category, 1, 1)), lower(substring(category, 2, 99)))")
# Searches of an admin: words, parts of words and several words, with and without findings.
SEARCHES = ["wid", "BOLT", "small a", "large", "t g", "x", "zzz", "widget", "el", ""]


@query("entity_search", f"""SELECT s AS search, e.entity_id, e.brand, e.name, count(p.event_id) AS live_events FROM (SELECT unnest({SEARCHES}) AS s) JOIN {{ent}} e ON s <> '' AND contains(lower(e.name), lower(s)) JOIN {{pub}} p ON p.entity_id = e.entity_id WHERE NOT p.is_retracted GROUP BY ALL""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose names hold a search, with their live events."""
    searches = spark.createDataFrame([(x,) for x in SEARCHES], "search string")
    ent = TABLES["ent"](spark, sf_dir)
    found = holding(searches.select(F.col("search").alias("wanted")), ent.select(F.col("entity_id").alias("id"), F.col("name").alias("text")))
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted").groupBy("entity_id").agg(F.count("*").alias("live_events"))
    named = found.join(searches, F.lower("search") == F.col("wanted")).select("search", F.col("id").alias("entity_id"), F.col("text").alias("name"))
    return named.join(ent.select("entity_id", "brand"), "entity_id").join(live, "entity_id").select("search", "entity_id", "brand", "name", "live_events")


view("related_products", "SELECT brand, entity_id, n FROM (SELECT brand, entity_id, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, entity_id) AS r FROM {pub} WHERE change_type = 'shrinkflation' GROUP BY brand, entity_id) t WHERE r <= 8")
view("distinct_brands", "SELECT DISTINCT brand FROM {ent} WHERE brand IS NOT NULL")
view("claims_page", "SELECT claim_id, entity_id, status, confidence FROM {claims} WHERE status = 'pending' AND source_type = '1' AND confidence >= 0.5 ORDER BY extracted_date DESC NULLS LAST, claim_id LIMIT 50 OFFSET 100")
view("flag_counts", "SELECT change_type, severity, is_retracted, count(*) AS n FROM {pub} GROUP BY change_type, severity, is_retracted")
view("dominant_source", """SELECT entity_id, r.store, -r.minus AS n, evidence FROM (SELECT entity_id, min(struct(-n AS minus, first, store)) AS r, sum(n) AS evidence
FROM (SELECT entity_id, store, count(*) AS n, min(observed_date) AS first FROM {pub} GROUP BY entity_id, store) GROUP BY entity_id) t""", "SELECT entity_id, store, n, evidence::BIGINT AS evidence FROM (SELECT entity_id, store, count(*) AS n, sum(count(*)) OVER (PARTITION BY entity_id) AS evidence, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, min(observed_date), store) AS r FROM {pub} GROUP BY entity_id, store) t WHERE r = 1")


@query("trajectory", """WITH o AS (SELECT upc, round(size / 5) AS size, observed_date, row_number() OVER (PARTITION BY upc ORDER BY observed_date) AS k FROM {obs}),
w AS (SELECT *, lag(size) OVER (PARTITION BY upc ORDER BY k) AS before FROM o), s AS (SELECT * FROM w WHERE before IS NULL OR abs(size - before) > 0.01)
SELECT upc, count(*) AS steps, arg_min(size, k) AS first_size, arg_max(size, k) AS last_size, round((arg_max(size, k) - arg_min(size, k)) / nullif(arg_min(size, k), 0) * 100, 1) AS cumulative_pct FROM s GROUP BY upc""")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's sizes with runs of equal ones collapsed, and the change from first to last."""
    rows = TABLES["obs"](spark, sf_dir).select("upc", "observed_date", F.round(F.col("size") / 5).alias("size"))
    runs = run_summary(rows, "upc", "observed_date", "size", 0.01)
    return runs.select("upc", "steps", F.col("first").alias("first_size"), F.col("last").alias("last_size"), F.round(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, 1).alias("cumulative_pct"))


@query("spaced_snapshots", """WITH s AS (SELECT upc, observed_date, size, row_number() OVER (PARTITION BY upc ORDER BY observed_date) - 1 AS i, count(*) OVER (PARTITION BY upc) AS n FROM {obs})
SELECT upc, observed_date, size FROM s WHERE n <= 6 OR list_contains(list_transform(range(6), lambda k: CAST(floor((n - 1) / 5 * k + 0.5) AS BIGINT)), i)""")
def spaced_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six snapshots of a product: the oldest, the newest and four evenly spaced between."""
    return spaced(TABLES["obs"](spark, sf_dir).select("upc", "observed_date", "size"), "upc", "observed_date", 6)


@query("keyset_pages", " UNION ALL ".join(f"SELECT {after} AS after, * FROM (SELECT claim_id, entity_id, status, confidence FROM {{claims}} WHERE claim_id > {after} ORDER BY claim_id LIMIT 40)" for after in (-1, 321, 1480)))
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all claims behind three keys, read through the index of a sorted table."""
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    write_sorted(TABLES["claims"](spark, sf_dir).select("claim_id", "entity_id", "status", "confidence"), "claim_id", path, rows_per_file=1000)
    pages = Pages(spark, path, "claim_id")
    return reduce(DataFrame.union, [pages.after(after, 40).select(F.lit(after).alias("after"), "claim_id", "entity_id", "status", "confidence") for after in (-1, 321, 1480)])
