"""Views on products, events and claims.

Each is one SQL text over the tables of ``base``; Catalyst prunes what a view does
not use and turns DISTINCT ON and correlated lookups, written as row_number and
min_by here, into one shuffle on their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .base import TABLES, change_events, query, view

# A nudge of 1e-9 away from zero before rounding means that ties, which two
# engines may see on either side of a binary fraction, go away from zero in both.

#: Day that takes the place of today.
AS_OF = "2001-08-01"

query("change_events", "SELECT * FROM {chg}")(lambda spark, sf_dir: change_events(spark, sf_dir))

view("product_timeline", """
SELECT e.entity_id, e.brand, e.name, o.observed_date, o.size, o.price, round(o.price / nullif(o.size, 0) + 1e-9, 4) AS price_per_unit, o.store
FROM {ent} e JOIN {obs} o ON o.upc = e.entity_id""")

view("classify_change_sql", """
SELECT change_type, severity, count(*) AS n, round(avg(size_delta_pct), 2) AS avg_pct, round(max(ppu_after), 4) AS max_ppu FROM {chg} GROUP BY change_type, severity""")

view("classify_change_promote", """
SELECT change_type, severity, count(*) AS n, min(size_delta_pct) AS least, max(size_delta_pct) AS most FROM {pub} GROUP BY change_type, severity""")

view("repeat_offenders", """
SELECT entity_id, count(*) AS n_shrinks, min(size_delta_pct) AS worst_pct FROM {pub} WHERE change_type = 'shrinkflation' AND NOT is_retracted GROUP BY entity_id HAVING count(*) > 1""")

view("current_state", """
SELECT upc, max(observed_date) AS last_seen, max_by(size, observed_date) AS current_size, max_by(price, observed_date) AS current_price, min_by(size, observed_date) AS first_size FROM {obs} GROUP BY upc""")

#: A change gives both its versions, and equal ones are passed over where a product's stand in order, in the shuffle that found its changes.
view("backfill_versions", """
SELECT upc, version_date, size FROM (
  SELECT *, row_number() OVER (PARTITION BY upc, version_date, size ORDER BY upc) AS r FROM (
    SELECT upc, inline(array(struct(add_months(date_after, -12) AS version_date, size_before AS size), struct(date_after AS version_date, size_after AS size))) FROM {chg})) WHERE r = 1""", """
SELECT upc, version_date, size FROM (
  SELECT upc, CAST(date_after - INTERVAL 1 YEAR AS DATE) AS version_date, size_before AS size FROM {chg}
  UNION SELECT upc, date_after AS version_date, size_after AS size FROM {chg})""")

#: Every version of a product counts each of its events, as in the first definition; the two are counted apart and multiplied.
view("leaderboard_v1", """
SELECT o.upc, n * changes AS total_changes, n * shrinks AS shrink_count, round(n * pct, 2) AS cumulative_pct, first_size, last_size
FROM (SELECT upc, count(*) AS n, min_by(size, observed_date) AS first_size, max_by(size, observed_date) AS last_size FROM {obs} GROUP BY upc) o
JOIN (SELECT upc, count(date_after) AS changes, count(date_after) FILTER (WHERE size_after < size_before) AS shrinks, sum(size_delta_pct) FILTER (WHERE size_delta_pct < 0) AS pct FROM {chg} GROUP BY upc) c ON c.upc = o.upc
WHERE shrinks > 0""", """
SELECT o.upc, count(c.date_after) AS total_changes, count(c.date_after) FILTER (WHERE c.size_after < c.size_before) AS shrink_count,
       round(sum(c.size_delta_pct) FILTER (WHERE c.size_delta_pct < 0), 2) AS cumulative_pct, min_by(o.size, o.observed_date) AS first_size, max_by(o.size, o.observed_date) AS last_size
FROM {obs} o JOIN {chg} c ON c.upc = o.upc GROUP BY o.upc HAVING count(c.date_after) FILTER (WHERE c.size_after < c.size_before) > 0""")

view("leaderboard", """
SELECT entity_id, brand, product_name, count(*) AS total_changes, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrink_count,
       round(sum(size_delta_pct) FILTER (WHERE size_delta_pct < 0), 2) AS cumulative_shrink_pct, max(observed_date) AS latest_change
FROM {pub} WHERE NOT is_retracted GROUP BY entity_id, brand, product_name HAVING count(*) FILTER (WHERE change_type = 'shrinkflation') > 0""")

SCORECARD = """SELECT brand, count(DISTINCT entity_id) AS products, count(*) AS total_events, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrink_events,
       count(*) FILTER (WHERE change_type = 'restoration') AS restoration_events, round(sum(size_delta_pct) FILTER (WHERE size_delta_pct < 0), 2) AS total_shrink_pct,
       min(observed_date) AS first_event, max(observed_date) AS last_event
FROM {pub} WHERE NOT is_retracted GROUP BY brand"""
view("brand_scorecard", SCORECARD)

view("brand_rankings", f"""
WITH score AS ({SCORECARD})
SELECT brand, products, total_events, shrink_events, total_shrink_pct, round(total_shrink_pct / nullif(shrink_events, 0) - 1e-9, 1) AS avg_shrink_pct,
       row_number() OVER (ORDER BY shrink_events DESC, brand) AS place FROM score WHERE shrink_events > 0""")

_BRAND_INDEX = f"""
WITH score AS ({SCORECARD}),
thumb AS (SELECT brand, image_url FROM (SELECT brand, image_url, row_number() OVER (PARTITION BY brand ORDER BY observed_date DESC, event_id) AS r FROM {{pub}} WHERE image_url IS NOT NULL AND NOT is_retracted) t WHERE r = 1),
worst AS (SELECT brand, min(size_delta_pct) AS worst_pct FROM {{pub}} WHERE NOT is_retracted GROUP BY brand),
kinds AS (SELECT brand, category FROM (SELECT brand, category, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, category) AS r FROM {{pub}} WHERE NOT is_retracted GROUP BY brand, category) t WHERE r = 1)
SELECT score.brand, products, total_events, shrink_events, worst_pct, category AS primary_category, image_url AS thumb_url
FROM score LEFT JOIN thumb ON thumb.brand = score.brand LEFT JOIN worst ON worst.brand = score.brand LEFT JOIN kinds ON kinds.brand = score.brand"""


@query("brand_index", _BRAND_INDEX)
def brand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's counts, worst change, commonest category and newest picture, from one pass over the events.

    Events are counted by brand, category and product first; both steps behind it read
    the same exchange of these small rows.
    """
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted")
    newest = F.min(F.when(F.col("image_url").isNotNull(), F.struct((-F.unix_date("observed_date")).alias("d"), "event_id", "image_url")))
    small = live.groupBy("brand", "category", "entity_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("change_type") == "shrinkflation", 1)).alias("shrinks"), F.min("size_delta_pct").alias("worst"), newest.alias("newest"))
    totals = small.groupBy("brand").agg(F.countDistinct("entity_id").alias("products"), F.sum("n").alias("total_events"), F.sum("shrinks").alias("shrink_events"), F.min("worst").alias("worst_pct"), F.min("newest").alias("newest"))
    kinds = small.groupBy("brand", "category").agg(F.sum("n").alias("k")).groupBy("brand").agg(F.min(F.struct((-F.col("k")).alias("minus"), "category")).alias("kind"))
    out = totals.join(kinds, "brand")
    return out.select("brand", "products", "total_events", "shrink_events", "worst_pct", F.col("kind.category").alias("primary_category"), F.col("newest.image_url").alias("thumb_url"))


@query("product_index", """
SELECT entity_id, brand, product_name, category, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrink_count, count(*) FILTER (WHERE change_type = 'restoration') AS restoration_count,
       round(avg(size_delta_pct) FILTER (WHERE size_delta_pct < 0), 1) AS avg_shrink_pct, min(size_delta_pct) AS worst_pct, max(observed_date) AS last_event
FROM {pub} WHERE NOT is_retracted GROUP BY entity_id, brand, product_name, category HAVING count(*) > 0""")
def product_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and worst fall and last event of each product.

    Many means lie between two tenths, where the order of adding doubles decides which
    one they round to; so the falls of a product add up from the newest to the oldest, as
    the SQL's engine adds them, whatever the partitions, and tenths are rounded as
    there, from the mean times ten.
    """
    live, falls = TABLES["pub"](spark, sf_dir).where("not is_retracted"), F.col("size_delta_pct") < 0
    kind = lambda name: F.count(F.when(F.col("change_type") == name, 1))
    by_day = F.sort_array(F.collect_list(F.when(falls, F.struct("observed_date", "size_delta_pct"))), asc=False)
    rows = live.groupBy("entity_id", "brand", "product_name", "category").agg(
        kind("shrinkflation").alias("shrink_count"), kind("restoration").alias("restoration_count"), by_day.alias("falls"), F.min("size_delta_pct").alias("worst_pct"), F.max("observed_date").alias("last_event"),
    )
    total = F.aggregate("falls", F.lit(0.0), lambda a, x: a + x["size_delta_pct"])
    mean = F.when(F.size("falls") > 0, F.round(total / F.size("falls") * 10) / 10)
    return rows.select("entity_id", "brand", "product_name", "category", "shrink_count", "restoration_count", mean.alias("avg_shrink_pct"), "worst_pct", "last_event")


view("category_stats", """
SELECT category, count(DISTINCT entity_id) AS products, count(*) AS events, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrink_events, round(avg(size_delta_pct), 1) AS avg_pct
FROM {pub} WHERE NOT is_retracted GROUP BY category""")

_EVENT = "event_id, entity_id, brand, product_name, size_before, size_after, size_delta_pct, change_type, severity, observed_date"
view("biggest_shrinks", f"SELECT {_EVENT}, category, image_url FROM {{pub}} WHERE change_type = 'shrinkflation' AND size_delta_pct < 0 AND NOT is_retracted ORDER BY size_delta_pct")
view("restorations", f"SELECT {_EVENT} FROM {{pub}} WHERE change_type = 'restoration' AND NOT is_retracted ORDER BY observed_date DESC")
view("recent_changes", f"SELECT {_EVENT} FROM {{pub}} WHERE NOT is_retracted ORDER BY observed_date DESC")

view("dashboard_stats", f"""
SELECT (SELECT count(*) FROM {{ent}}) AS total_products, count(*) AS total_events, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrink_events, count(DISTINCT brand) AS brands,
       round(avg(size_delta_pct) FILTER (WHERE size_delta_pct < 0), 1) AS avg_shrink_pct, min(size_delta_pct) AS worst_pct, count(*) FILTER (WHERE observed_date > DATE '{AS_OF}' - INTERVAL '7' DAY) AS events_this_week
FROM {{pub}} WHERE NOT is_retracted""")

view("pending_review", """
SELECT claim_id, entity_id, old_size, new_size, round((new_size - old_size) / nullif(old_size, 0) * 100, 1) AS computed_pct, confidence FROM {claims} WHERE status = 'pending' ORDER BY confidence DESC, claim_id""")

view("shrink_timeline_monthly", """
SELECT CAST(date_trunc('month', observed_date) AS DATE) AS month, count(*) AS events, count(*) FILTER (WHERE change_type = 'shrinkflation') AS shrinks,
       count(*) FILTER (WHERE change_type = 'restoration') AS restorations, round(avg(size_delta_pct) FILTER (WHERE size_delta_pct < 0), 1) AS avg_negative_pct
FROM {pub} WHERE NOT is_retracted GROUP BY CAST(date_trunc('month', observed_date) AS DATE)""")

view("cpi_context", """
WITH months AS (SELECT CAST(date_trunc('month', observed_date) AS DATE) AS month, count(*) AS n FROM {pub} WHERE NOT is_retracted GROUP BY CAST(date_trunc('month', observed_date) AS DATE)),
moved AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS before FROM {cpi})
SELECT moved.month AS month, value, before, round((value - before) / nullif(before, 0) * 100, 2) AS mom_pct, coalesce(n, 0) AS events FROM moved LEFT JOIN months ON months.month = moved.month""")

view("content_score", f"""
SELECT event_id, brand, size_delta_pct, observed_date,
       (CASE WHEN image_url IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN abs(size_delta_pct) >= 20 THEN 25 WHEN abs(size_delta_pct) >= 10 THEN 15 WHEN abs(size_delta_pct) >= 5 THEN 10 ELSE 5 END)
       + (CASE WHEN observed_date >= DATE '{AS_OF}' - INTERVAL '30' DAY THEN 15 WHEN observed_date >= DATE '{AS_OF}' - INTERVAL '90' DAY THEN 10 WHEN observed_date >= DATE '{AS_OF}' - INTERVAL '365' DAY THEN 5 ELSE 0 END) AS content_score
FROM {{pub}} WHERE NOT is_retracted""")

view("news_brand_mentions", f"""
WITH score AS ({SCORECARD}),
said AS (SELECT concat('brand#', CAST(user_id % 40 AS VARCHAR(9))) AS brand, raw_id, source_type FROM {{raw}} WHERE source_type IN ('view', 'click'))
SELECT said.brand AS brand, count(DISTINCT raw_id) AS mentions, count(DISTINCT source_type) AS kinds, max(shrink_events) AS shrink_events
FROM said LEFT JOIN score ON lower(score.brand) = lower(said.brand) GROUP BY said.brand HAVING count(DISTINCT raw_id) >= 2""")

SIGNALS = """SELECT event_id AS signal_id, 'event' AS kind, change_type AS signal_type, brand, severity, size_delta_pct, observed_date AS signal_date FROM {pub} WHERE NOT is_retracted
UNION ALL SELECT CAST(raw_id AS VARCHAR(20)) AS signal_id, 'evidence' AS kind, source_type AS signal_type, concat('Brand#', CAST(user_id % 25 + 1 AS VARCHAR(9))) AS brand, CAST(NULL AS VARCHAR(9)) AS severity, CAST(NULL AS DOUBLE) AS size_delta_pct, source_date AS signal_date FROM {raw} WHERE source_type <> 'error'"""
view("signals_summary", SIGNALS)
view("brand_signal_counts", f"""WITH signals AS ({SIGNALS})
SELECT brand, count(*) AS total, count(*) FILTER (WHERE kind = 'event') AS events, count(DISTINCT signal_type) AS signal_types, max(signal_date) AS latest FROM signals GROUP BY brand""")
view("signal_type_counts", f"WITH signals AS ({SIGNALS}) SELECT signal_type, count(*) AS total, count(DISTINCT brand) AS brands FROM signals GROUP BY signal_type")
view("monthly_signal_counts", f"""WITH signals AS ({SIGNALS})
SELECT CAST(date_trunc('month', signal_date) AS DATE) AS month, kind, count(*) AS total FROM signals GROUP BY CAST(date_trunc('month', signal_date) AS DATE), kind""")

view("news_feed", """
SELECT r.raw_id, r.source_type, r.source_date, r.value, count(c.claim_id) AS linked FROM {raw} r LEFT JOIN {claims} c ON c.entity_id = r.user_id AND c.status = 'matched'
WHERE r.source_type = 'view' GROUP BY r.raw_id, r.source_type, r.source_date, r.value""")

view("product_news", """
SELECT c.entity_id, r.raw_id, r.source_date, c.claim_id FROM {claims} c JOIN {raw} r ON r.user_id = c.entity_id WHERE r.source_type = 'purchase' AND c.status = 'matched'""")

view("skimpflation_events", f"SELECT {_EVENT} FROM {{pub}} WHERE severity = 'major' AND price_after > price_before AND NOT is_retracted")

view("daily_stats", f"""
SELECT extracted_date, source_type, count(*) AS claims, count(*) FILTER (WHERE status = 'matched') AS matched FROM {{claims}}
WHERE extracted_date >= DATE '{AS_OF}' - INTERVAL '90' DAY GROUP BY extracted_date, source_type""")

_BRANDS = "SELECT coalesce(manufacturer, brand) AS parent, brand, count(*) AS n FROM {pub} WHERE NOT is_retracted GROUP BY coalesce(manufacturer, brand), brand"


@query("corporate_tree", f"""
WITH b AS ({_BRANDS}), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n DESC, brand) AS place FROM b)
SELECT parent, count(*) AS brands, sum(n)::BIGINT AS events, string_agg(concat(brand, ':', n), ',' ORDER BY place) FILTER (WHERE place <= 3) AS top_brands FROM r GROUP BY parent HAVING sum(n) >= 5""")
def corporate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manufacturers with their brands' events and three largest brands."""
    events = TABLES["pub"](spark, sf_dir).where("not is_retracted")
    brands = events.groupBy(F.coalesce("manufacturer", "brand").alias("parent"), "brand").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "brand"))
    first = F.when(F.col("place") <= 3, F.struct("place", "brand", "n"))  # a list takes no nulls, so it holds three at most
    out = brands.withColumn("place", place).groupBy("parent").agg(F.count("*").alias("brands"), F.sum("n").alias("events"), F.array_sort(F.collect_list(first)).alias("top"))
    top = F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["brand"], x["n"].cast("string"))), ",")
    return out.where("events >= 5").select("parent", "brands", "events", top.alias("top_brands"))


@query("event_evidence_summary", """
SELECT p.entity_id, count(*) AS sources, string_agg(concat(source_type, '@', strftime(source_date, '%Y-%m-%d')), ',' ORDER BY source_date DESC, raw_id) AS listed, max(substring(payload, 1, 240)) AS excerpt
FROM (SELECT DISTINCT entity_id FROM {pub} WHERE NOT is_retracted) p JOIN {raw} ON user_id = p.entity_id GROUP BY p.entity_id""")
def event_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources behind the events of a product, the newest first."""
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted").select("entity_id").distinct()
    raw = TABLES["raw"](spark, sf_dir)
    rows = live.join(raw, F.col("user_id") == F.col("entity_id"))
    newest = F.struct((-F.unix_date("source_date")).alias("d"), "raw_id", F.concat_ws("@", "source_type", F.date_format("source_date", "yyyy-MM-dd")).alias("what"))
    out = rows.groupBy("entity_id").agg(F.count("*").alias("sources"), F.array_sort(F.collect_list(newest)).alias("all"), F.max(F.substring("payload", 1, 240)).alias("excerpt"))
    return out.select("entity_id", "sources", F.array_join(F.transform("all", lambda x: x["what"]), ",").alias("listed"), "excerpt")


@query("product_history_json", """
SELECT upc, concat('[', string_agg(concat('{"d":"', strftime(observed_date, '%Y-%m-%d'), '","s":', CAST(size AS BIGINT), '}'), ',' ORDER BY observed_date), ']') AS history FROM {obs} GROUP BY upc""")
def product_history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's observations as one JSON document, in order of days."""
    obs = TABLES["obs"](spark, sf_dir)
    rows = obs.groupBy("upc").agg(F.array_sort(F.collect_list(F.struct(F.date_format("observed_date", "yyyy-MM-dd").alias("d"), F.col("size").cast("bigint").alias("s")))).alias("rows"))
    return rows.select("upc", F.to_json("rows").alias("history"))
