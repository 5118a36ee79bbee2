"""Pages and feeds over the driver's tables: products, evidence, headlines, submissions, articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import records as R
from ..operators.series import month_spine
from . import detectors
from .base import ORACLE_SQL, TABLES, query, read, view
from .lifecycle import _LINKS, _links
from .views import AS_OF

view("product_timeline_v1", """SELECT e.entity_id, e.brand, e.name, o.observed_date AS version_date, o.size, o.price, c.change_type, c.severity, c.size_delta_pct FROM {ent} e JOIN {obs} o ON o.upc = e.entity_id LEFT JOIN {chg} c ON c.upc = o.upc AND c.date_after = o.observed_date""")

_RAW = "SELECT raw_id, source_type, CASE WHEN raw_id % 7 = 0 THEN NULL ELSE source_date END AS source_date, CASE WHEN raw_id % 3 = 0 THEN NULL ELSE concat('https://', CASE WHEN raw_id % 2 = 0 THEN 'www.' ELSE '' END, 'site', user_id % 20, '.example/p/', raw_id) END AS source_url, CASE WHEN raw_id % 5 = 0 THEN repeat('long text ', 30) WHEN raw_id % 5 = 1 THEN '' END AS selftext, CASE WHEN raw_id % 5 > 1 THEN concat('about ', raw_id) END AS description FROM {raw}"


@query("evidence_sources", f"""WITH {_LINKS}, r AS ({_RAW}),
s AS (SELECT event_id, l.claim_id, source_type, source_date, regexp_extract(source_url, '^https?://(?:www\\.)?([^/]+)', 1) AS domain, nullif(left(coalesce(selftext, description, ''), 240), '') AS excerpt FROM (SELECT DISTINCT event_id, claim_id FROM links) l LEFT JOIN r ON raw_id = l.claim_id)
SELECT p.event_id, count(s.claim_id) AS n_sources, coalesce(string_agg(concat_ws('|', s.claim_id, coalesce(source_type, '-'), coalesce(nullif(domain, ''), '-'), coalesce(CAST(source_date AS VARCHAR), '-'), coalesce(md5(excerpt), '-')), ';' ORDER BY source_date DESC NULLS LAST, s.claim_id) FILTER (WHERE s.claim_id IS NOT NULL), '') AS sources
FROM {{pub}} p LEFT JOIN s ON s.event_id = p.event_id WHERE NOT p.is_retracted GROUP BY p.event_id""")
def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources behind each live event, the newest first and undated ones last, with domain and the first 240 characters; an event without any has an empty list."""
    events, claims = TABLES["pub"](spark, sf_dir), TABLES["claims"](spark, sf_dir)
    raw = spark.sql(_RAW, raw=TABLES["raw"](spark, sf_dir))
    rows = _links(events, claims).distinct().join(raw, F.col("claim_id") == F.col("raw_id"), "left")
    excerpt = F.nullif(F.left(F.coalesce("selftext", "description", F.lit("")), F.lit(240)), F.lit(""))
    domain = F.nullif(F.regexp_extract("source_url", r"^https?://(?:www\.)?([^/]+)", 1), F.lit(""))
    order = F.struct(F.col("source_date").isNull().alias("undated"), (-F.unix_date("source_date")).alias("d"), "claim_id")
    text = F.concat_ws("|", F.col("claim_id").cast("string"), F.coalesce("source_type", F.lit("-")), F.coalesce(domain, F.lit("-")), F.coalesce(F.col("source_date").cast("string"), F.lit("-")), F.coalesce(F.md5(excerpt), F.lit("-")))
    lists = rows.groupBy("event_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("x")))).alias("s"))
    out = events.where("not is_retracted").select("event_id").join(lists, "event_id", "left")
    return out.select("event_id", F.coalesce("n", F.lit(0)).alias("n_sources"), F.coalesce(F.array_join(F.transform("s", lambda x: x["x"]), ";"), F.lit("")).alias("sources"))


@query("skimpflation_published", f"""WITH s AS ({ORACLE_SQL["skimp_promotion"]})
SELECT concat('skimp-', s.entity_id) AS event_id, s.entity_id, e.brand, e.name AS product_name, 'skimpflation' AS change_type, severity, skimp_score FROM s JOIN part p ON p.p_partkey = s.entity_id JOIN (SELECT p_partkey AS entity_id, p_brand AS brand, p_name AS name FROM part) e ON e.entity_id = s.entity_id WHERE p_size <= 45""")
def skimpflation_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the skimpflation type, from worsened nutrients, of products that aren't retracted."""
    found = detectors.skimp_promotion(spark, sf_dir)
    events = found.join(TABLES["ent"](spark, sf_dir), "entity_id").withColumn("change_type", F.lit("skimpflation")).withColumn("is_retracted", F.col("pack_size") > 45)
    return events.where("change_type = 'skimpflation' and not is_retracted").select(F.concat(F.lit("skimp-"), F.col("entity_id").cast("string")).alias("event_id"), "entity_id", "brand", F.col("name").alias("product_name"), "change_type", "severity", "skimp_score")


view("offender_flags", "SELECT upc, count(*) FILTER (WHERE NOT is_retracted) > 1 AS is_repeat_offender FROM {chg} WHERE change_type = 'shrinkflation' GROUP BY upc HAVING count(*) FILTER (WHERE NOT is_retracted) >= 1")


@query("product_documents", """SELECT entity_id AS upc, concat('{"product":{"upc":', entity_id, ',"name":"', name, '","brand":"', brand, '","category":"', category, '"', CASE WHEN image_url IS NULL THEN '' ELSE concat(',"image_url":"', image_url, '"') END, '},"versions":[', coalesce(versions, ''), '],"changes":[', coalesce(changes, ''), '],"upvotes":', coalesce(upvotes, 0), '}') AS doc
FROM {ent} LEFT JOIN (SELECT upc AS u, string_agg(concat('{"observed_date":"', observed_date, '","size":', CAST(size AS BIGINT), ',"store":', store, '}'), ',' ORDER BY observed_date) AS versions FROM {obs} GROUP BY upc) v ON v.u = entity_id
LEFT JOIN (SELECT upc AS u, string_agg(concat('{"detected_date":"', date_after, '","change_type":"', change_type, '","severity":"', severity, '"}'), ',' ORDER BY date_after) AS changes FROM {chg} GROUP BY upc) c ON c.u = entity_id
LEFT JOIN (SELECT user_id, count(*) AS upvotes FROM {raw} WHERE source_type = 'click' GROUP BY user_id) n ON n.user_id = entity_id""")
def product_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's fields, versions, changes and number of votes as one JSON document."""
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    listed = lambda rows, name, *fields: rows.groupBy(F.col("upc").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    versions = listed(TABLES["obs"](spark, sf_dir), "versions", day("observed_date", "observed_date"), F.col("size").cast("bigint").alias("size"), "store")
    found = listed(TABLES["chg"](spark, sf_dir), "changes", day("date_after", "detected_date"), "change_type", "severity")
    votes = TABLES["raw"](spark, sf_dir).where("source_type = 'click'").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("upvotes"))
    rows = TABLES["ent"](spark, sf_dir).join(versions, "entity_id", "left").join(found, "entity_id", "left").join(votes, "entity_id", "left")
    product = F.struct(F.col("entity_id").alias("upc"), "name", "brand", "category", "image_url").alias("product")
    some = lambda frame, c: F.coalesce(c, F.array().cast(frame.schema[c].dataType)).alias(c)
    return rows.select(F.col("entity_id").alias("upc"), F.to_json(F.struct(product, some(versions, "versions"), some(found, "changes"), F.coalesce("upvotes", F.lit(0)).alias("upvotes"))).alias("doc"))


_SERIES = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'All food, urgent' WHEN o_orderpriority = '5-LOW' THEN 'ALL FOOD, low' ELSE o_orderpriority END AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM {ord} GROUP BY 1, 2"
view("bls_headline_food", f"""WITH s AS ({_SERIES.replace("GROUP BY 1, 2", "GROUP BY CASE WHEN o_orderpriority = '1-URGENT' THEN 'All food, urgent' WHEN o_orderpriority = '5-LOW' THEN 'ALL FOOD, low' ELSE o_orderpriority END, CAST(date_trunc('month', o_orderdate) AS DATE)")}),
food AS (SELECT * FROM s WHERE lower(series) LIKE 'all food%'), used AS (SELECT * FROM food UNION ALL SELECT * FROM s WHERE (SELECT count(*) FROM food) = 0),
p AS (SELECT period, max(n) AS n FROM used GROUP BY period), r AS (SELECT period, n, row_number() OVER (ORDER BY period DESC) AS place FROM p)
SELECT a.period, concat(extract(YEAR FROM a.period), '-Q', extract(QUARTER FROM a.period)) AS quarter, a.n AS latest, coalesce(b.n, 0) AS previous, coalesce(c.n, 0) AS year_before, round(CASE WHEN coalesce(b.n, 0) > 0 THEN (a.n - b.n) * 100.0 / b.n ELSE 0 END + 1e-9, 1) AS previous_pct, round(CASE WHEN coalesce(c.n, 0) > 0 THEN (a.n - c.n) * 100.0 / c.n ELSE 0 END + 1e-9, 1) AS year_pct
FROM r a LEFT JOIN r b ON b.place = 2 LEFT JOIN p c ON extract(YEAR FROM c.period) = extract(YEAR FROM a.period) - 1 AND extract(MONTH FROM c.period) = extract(MONTH FROM a.period) WHERE a.place = 1""")


@query("insight_chart_full", f"""WITH m AS (SELECT CAST(unnest(range(DATE '{AS_OF}' - INTERVAL 38 MONTH, DATE '{AS_OF}' + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month), {_LINKS},
d AS (SELECT event_id, min(source_date) AS first_source FROM links JOIN {{raw}} ON raw_id = claim_id GROUP BY event_id),
e AS (SELECT CAST(date_trunc('month', coalesce(first_source, observed_date)) AS DATE) AS month, count(*) AS events FROM {{pub}} p LEFT JOIN d ON d.event_id = p.event_id WHERE NOT is_retracted GROUP BY 1),
b AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), g AS (SELECT CAST(date_trunc('month', captured_at) AS DATE) AS month, round(avg(value) + 1e-6, 2) AS trend FROM {{raw}} GROUP BY 1)
SELECT m.month, coalesce(events, 0) AS events, c.value AS cpi, round(b.n / 3 + 1e-9, 2) AS bls, trend FROM m LEFT JOIN e ON e.month = m.month LEFT JOIN {{cpi}} c ON c.month = m.month LEFT JOIN b ON b.q = CAST(date_trunc('quarter', m.month) AS DATE) LEFT JOIN g ON g.month = m.month""")
def insight_chart_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four series over 39 months: events by their earliest source, the price index, a quarter's count spread over its months, and a trend."""
    events, claims, raw = TABLES["pub"](spark, sf_dir), TABLES["claims"](spark, sf_dir), TABLES["raw"](spark, sf_dir)
    first = _links(events, claims).join(raw, F.col("claim_id") == F.col("raw_id")).groupBy("event_id").agg(F.min("source_date").alias("first_source"))
    by_month = events.where("not is_retracted").join(first, "event_id", "left").groupBy(F.trunc(F.coalesce("first_source", "observed_date"), "month").alias("month")).agg(F.count("*").alias("events"))
    quarters = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.trunc("o_orderdate", "quarter").alias("q")).agg(F.count("*").alias("n"))
    bls = quarters.select(F.explode(F.sequence("q", F.add_months("q", 2), F.expr("interval 1 month"))).alias("month"), F.round(F.col("n") / 3 + 1e-9, 2).alias("bls"))
    trend = raw.groupBy(F.trunc("captured_at", "month").alias("month")).agg(F.round(F.avg("value") + 1e-6, 2).alias("trend"))
    out = month_spine(spark, AS_OF, 39).join(by_month, "month", "left").join(TABLES["cpi"](spark, sf_dir), "month", "left").join(bls, "month", "left").join(trend, "month", "left")
    return out.select("month", F.coalesce("events", F.lit(0)).alias("events"), F.col("value").alias("cpi"), "bls", "trend")


_FOLDED = "SELECT entity_id, old_size, new_size, min(claim_id) AS origin, list(claim_id ORDER BY claim_id) AS summary FROM {claims} WHERE status = 'matched' GROUP BY entity_id, old_size, new_size"


@query("stuck_cleanup", f"WITH f AS ({_FOLDED}) SELECT claim_id, CASE WHEN status = 'matched' AND claim_id <> origin THEN 'evidence' ELSE status END AS status, CASE WHEN status = 'matched' THEN array_to_string(list_filter(summary, lambda x: x <> origin), ',') END AS summary FROM {{claims}} c LEFT JOIN f ON f.entity_id = c.entity_id AND f.old_size = c.old_size AND f.new_size = c.new_size")
def stuck_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched claims other than the one that made their event become evidence, and each has its event's summary without the maker."""
    c = TABLES["claims"](spark, sf_dir)
    keys = ["entity_id", "old_size", "new_size"]
    folded = c.where("status = 'matched'").groupBy(*keys).agg(F.min("claim_id").alias("origin"), F.array_sort(F.collect_list("claim_id")).alias("summary"))
    rows = c.join(folded, keys, "left")
    stripped = F.array_join(F.filter("summary", lambda x: x != F.col("origin")).cast("array<string>"), ",")
    stuck = (F.col("status") == "matched") & (F.col("claim_id") != F.col("origin"))
    return rows.select("claim_id", F.when(stuck, "evidence").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "matched", stripped).alias("summary"))


@query("blocked_transitions", "SELECT claim_id, status AS old_status, CASE WHEN status = 'matched' AND confidence < 0.3 THEN status WHEN confidence < 0.3 THEN 'pending' ELSE 'review' END AS status, status = 'matched' AND confidence < 0.3 AS blocked FROM {claims}")
def blocked_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions back from matched to pending are refused; the rest take effect."""
    c = TABLES["claims"](spark, sf_dir)
    wanted = F.when(F.col("confidence") < 0.3, "pending").otherwise("review")
    blocked = (F.col("status") == "matched") & (wanted == "pending")
    return c.select("claim_id", F.col("status").alias("old_status"), F.when(blocked, F.col("status")).otherwise(wanted).alias("status"), blocked.alias("blocked"))


_TITLES = "CASE p_partkey % 4 WHEN 0 THEN concat('Industry data on ', p_name, ' - BBC News') WHEN 1 THEN concat(p_name, ' — old and new — Financial Times') WHEN 2 THEN concat('Smaller ', p_name) ELSE NULL END"


@query("promoted_articles", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Industry data on ', p_name) WHEN 1 THEN p_name WHEN 2 THEN concat('Smaller ', p_name) ELSE '' END AS headline, CASE p_partkey % 4 WHEN 0 THEN 'BBC News' WHEN 1 THEN 'Financial Times' END AS outlet,
  CASE WHEN p_size > 40 THEN 'skimpflation' WHEN p_size > 20 THEN 'downsizing' ELSE 'shrinkflation' END AS article_type, CASE WHEN p_partkey % 4 = 0 THEN 'Data,Industry' ELSE 'News' END AS tags, p_partkey % 4 = 0 AS is_free FROM part""")
def promoted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged articles with headline, outlet, type and tags, and whether the outlet is free to read."""
    hint = F.when(F.col("p_size") > 40, "Skimpflation seen").when(F.col("p_size") > 20, "Downsized")
    rows = read(spark, sf_dir, "part").select("p_partkey", R.article_fields(F.expr(_TITLES), hint).alias("a"))
    return rows.select("p_partkey", "a.headline", "a.outlet", "a.article_type", F.array_join("a.tags", ",").alias("tags"), R.is_free_outlet(F.col("a.outlet")).alias("is_free"))


@query("sitemap", """SELECT concat('https://site.example/brands/', lower(replace(brand, '#', '%23'))) AS url, max(observed_date) AS last_modified, 0.6::DOUBLE AS priority FROM {pub} WHERE NOT is_retracted AND change_type = 'shrinkflation' GROUP BY brand
UNION ALL SELECT concat('https://site.example/products/', entity_id), max(observed_date), 0.5 FROM {pub} WHERE NOT is_retracted AND change_type = 'shrinkflation' GROUP BY entity_id
UNION ALL SELECT concat('https://site.example/', p), DATE '2001-08-01', w FROM (VALUES ('', 1.0), ('brands', 0.9), ('products', 0.9), ('insights', 0.9), ('about', 0.6)) t(p, w)""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the fixed pages, of brands and of products, with the day of their latest event."""
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted and change_type = 'shrinkflation'")
    of = lambda column, kind, weight: live.groupBy(column).agg(F.max("observed_date").alias("last_modified")).select(R.page_address("https://site.example", kind, F.lower(F.col(column).cast("string"))).alias("url"), "last_modified", F.lit(weight).alias("priority"))
    fixed = spark.createDataFrame([("", 1.0), ("brands", 0.9), ("products", 0.9), ("insights", 0.9), ("about", 0.6)], "p string, priority double").select(F.concat(F.lit("https://site.example/"), "p").alias("url"), F.lit(AS_OF).cast("date").alias("last_modified"), "priority")
    return of("brand", "brands", 0.6).union(of("entity_id", "products", 0.5)).union(fixed)


@query("submissions", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Brand is required' WHEN o_orderkey % 7 = 0 THEN 'Product is required' WHEN o_orderkey % 5 = 0 THEN 'Description must be at least 10 characters' WHEN o_orderkey % 3 = 0 THEN 'Evidence URL must be a valid http(s) URL' END AS error,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Acme' END AS brand, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS old_size, substring(sha256(concat('10.0.0.', o_custkey)), 1, 24) AS sender FROM orders""")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' submissions with what is wrong with them, their fields and a hash of their sender."""
    k = F.col("o_orderkey")
    brand, product = F.when(k % 11 == 0, "  ").otherwise(" Acme "), F.when(k % 7 != 0, "Bar")
    description, url = F.when(k % 5 == 0, "too small").otherwise("The bar is smaller now"), F.when(k % 3 == 0, "javascript:x").when(k % 2 == 0, "https://a.example/b")
    size = F.when(k % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("big")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", R.submission_error(brand, product, description, url).alias("error"), R.submission(brand, product, description, size, size, F.lit("oz"), F.concat(F.lit("10.0.0."), F.col("o_custkey").cast("string"), F.lit(", 10.1.1.1"))).alias("s"))
    return rows.select("o_orderkey", "error", "s.brand", "s.old_size", "s.sender")


view("evidence_channel_page", "SELECT raw_id, source_date, value FROM {raw} WHERE source_type = 'view' ORDER BY source_date DESC NULLS LAST, raw_id LIMIT 60 OFFSET 120")


@query("named_retailers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Walmart' WHEN 1 THEN 'Whole Foods' WHEN 2 THEN '7-Eleven' END AS retailer, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS off_topic FROM part""")
def named_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retailers named in posts, and posts that a moderator removed as off the subject."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "Seen at WALMART, then at Target").when(k % 4 == 1, "my whole foods had it").when(k % 4 == 2, "only 7-eleven sells it").otherwise("targeted ads")
    comments = F.array(F.lit("Thanks."), F.when(k % 2 == 0, "This isn't shrinkflation.").otherwise("Rule 3."))
    off = R.removed_as_off_topic(F.when(k % 3 == 0, "[Removed by moderator]").otherwise("x"), F.lit("y"), F.lit(None).cast("string"), comments)
    return read(spark, sf_dir, "part").select("p_partkey", R.retailer_in(text).alias("retailer"), off.alias("off_topic"))


@query("product_page", """WITH x AS (SELECT entity_id, string_agg(concat(observed_date, ' ', change_type), ',' ORDER BY observed_date) AS events FROM {pub} WHERE NOT is_retracted GROUP BY 1),
s AS (SELECT upc AS entity_id, string_agg(DISTINCT CAST(store AS VARCHAR), ',' ORDER BY CAST(store AS VARCHAR)) AS stores FROM {obs} GROUP BY 1), p AS (SELECT user_id AS entity_id, string_agg(raw_id, ',' ORDER BY raw_id) AS press FROM {raw} WHERE source_type = 'view' GROUP BY 1),
b AS (SELECT brand, entity_id, count(*) AS n FROM {pub} WHERE change_type = 'shrinkflation' GROUP BY 1, 2), k AS (SELECT e.entity_id, b.entity_id AS other, row_number() OVER (PARTITION BY e.entity_id ORDER BY n DESC, b.entity_id) AS r FROM {ent} e JOIN b ON b.brand = e.brand AND b.entity_id <> e.entity_id),
r AS (SELECT entity_id, string_agg(other, ',' ORDER BY r) AS related FROM k WHERE r <= 8 GROUP BY 1)
SELECT e.entity_id, name, events, stores, press, related FROM {ent} e LEFT JOIN x USING (entity_id) LEFT JOIN s USING (entity_id) LEFT JOIN p USING (entity_id) LEFT JOIN r USING (entity_id)""")
def product_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a product's page shows: its live events, stores, articles, and the eight products of its brand that shrank most often."""
    ent, pub = TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name"), TABLES["pub"](spark, sf_dir)
    events = pub.where("not is_retracted").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("observed_date").cast("string"), "change_type"))), ",").alias("events"))
    stores = TABLES["obs"](spark, sf_dir).groupBy(F.col("upc").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("store").cast("string"))), ",").alias("stores"))
    press = TABLES["raw"](spark, sf_dir).where("source_type = 'view'").groupBy(F.col("user_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("raw_id")).cast("array<string>"), ",").alias("press"))
    shrunk = pub.where("change_type = 'shrinkflation'").groupBy("brand", "entity_id").agg(F.count("*").alias("n"))
    ranked = shrunk.withColumn("r", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("n"), "entity_id"))).where("r <= 9")  # one more than shown, as a product isn't its own neighbour
    rail = ranked.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("r", "entity_id"))).alias("rail"))
    rows = ent.join(events, "entity_id", "left").join(stores, "entity_id", "left").join(press, "entity_id", "left").join(rail, "brand", "left")
    others = F.slice(F.filter(F.transform("rail", lambda x: x["entity_id"]), lambda e: e != F.col("entity_id")), 1, 8)
    return rows.select("entity_id", "name", "events", "stores", "press", F.nullif(F.array_join(others.cast("array<string>"), ","), F.lit("")).alias("related"))

