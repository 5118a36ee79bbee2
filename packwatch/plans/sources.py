"""Shaping of sources, feeds and incremental ingest over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from ..sources.readers import backfill, keep_last, series_of_sheet
from ..sources.sinks import markdown_table, rss_items
from ..streaming.ingest import run_to_table
from ..streaming.store import Store
from .base import TABLES, query, read, view

view("trend_monthly", "SELECT CAST(date_trunc('month', captured_at) AS DATE) AS month, source_type AS keyword, round(avg(value) + 1e-6, 2) AS value, count(*) AS n FROM {raw} GROUP BY CAST(date_trunc('month', captured_at) AS DATE), source_type")


@query("full_outer_merge", """WITH a AS (SELECT lower(trim(o_orderpriority)) AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT lower(trim(o_orderpriority)) AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(avg(o_totalprice) + 1e-6, 2) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(a.series, b.series) AS series, coalesce(a.period, b.period) AS period, n, value FROM a FULL JOIN b ON a.series = b.series AND a.period = b.period""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workbooks of a series, merged by its name and month."""
    orders = read(spark, sf_dir, "orders").withColumn("series", F.lower(F.trim("o_orderpriority"))).withColumn("period", F.trunc("o_orderdate", "month"))
    counts = orders.where("o_orderstatus = 'F'").groupBy("series", "period").agg(F.count("*").alias("n"))
    values = orders.where("o_orderstatus = 'O'").groupBy("series", "period").agg(F.round(F.avg("o_totalprice") + 1e-6, 2).alias("value"))
    return counts.join(values, ["series", "period"], "full")


@query("unpivot_series", """SELECT upc, y, name AS measure, v AS value FROM (SELECT l_partkey AS upc, extract(year FROM l_shipdate)::INT AS y, round(sum(l_quantity), 2) AS quantity, round(max(l_discount), 4) AS discount FROM lineitem GROUP BY 1, 2) UNPIVOT (v FOR name IN (quantity, discount))""")
def unpivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide sheet as rows."""
    wide = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("upc"), F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.max("l_discount"), 4).alias("discount"))
    return wide.unpivot(["upc", "y"], ["quantity", "discount"], "measure", "value")


@query("date_windows", """SELECT CAST(s AS DATE) AS start_date, CAST(least(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, (SELECT max(o_orderdate) FROM orders)) AS DATE) AS end_date FROM (SELECT unnest(range((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 3 MONTH)) AS s)""")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three months that follow on one another from the first day to the last."""
    ends = read(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    starts = ends.select(F.explode(F.sequence("a", F.date_sub("b", 1), F.expr("interval 3 months"))).alias("start_date"), "b")
    return starts.select("start_date", F.least(F.date_sub(F.add_months("start_date", 3), 1), "b").alias("end_date"))


view("series_without_dots", "SELECT month, CASE WHEN value > 260000 THEN NULL ELSE value END AS value FROM {cpi} WHERE month > DATE '1996-01-01'")


@query("json_payload", "SELECT raw_id, CAST(json_extract_string(payload, '$.k') AS INT) AS k, coalesce(json_extract_string(payload, '$.missing'), 'none') AS missing FROM {raw}")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON payload; what isn't there is null."""
    raw = TABLES["raw"](spark, sf_dir).withColumn("p", F.from_json("payload", "k int, missing string"))
    return raw.select("raw_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing"))


# Events with an hour of publishing, which some lack, and a number of sources.
_FEED = "SELECT *, 'oz' AS size_unit, 1 + store % 3 AS evidence_count, CASE WHEN store % 4 > 0 THEN CAST(observed_date AS TIMESTAMP) + INTERVAL '30' HOUR END AS published_at FROM {pub}"


@query("rss_feed", f"""WITH f AS ({_FEED}), t AS (SELECT * FROM f WHERE NOT is_retracted AND change_type = 'shrinkflation' ORDER BY published_at DESC NULLS LAST, event_id LIMIT 50)
SELECT concat('<item><title>', replace(brand, '&', '&amp;'), ' ', product_name, ' shrank ', size_before::INT, 'oz → ', size_after::INT, 'oz</title><link>https://example.org/products/', entity_id, '</link><guid isPermaLink="false">https://example.org/events/', event_id, '</guid><pubDate>',
  strftime(coalesce(published_at, observed_date::TIMESTAMP), '%a, %d %b %Y %H:%M:%S GMT'), '</pubDate><description>', CAST(round(CAST(abs(size_delta_pct) AS DECIMAL(9, 2)), 1) AS DECIMAL(9, 1)), '% smaller · ', CASE WHEN evidence_count > 1 THEN concat(evidence_count, ' sources · ') ELSE '' END, 'observed ', observed_date, '</description></item>') AS value FROM t""")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty last published shrinks, as a feed shows them."""
    return rss_items(spark.sql(_FEED, pub=TABLES["pub"](spark, sf_dir)), "https://example.org", limit=50)


@query("markdown_report", "SELECT concat('| ', category, ' | ', count(*), ' |') AS value FROM {ent} GROUP BY category")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_table(TABLES["ent"](spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")))


@query("ingest_incremental", "SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) = 1")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table through a stream, each event once."""
    return run_to_table(spark, f"{sf_dir}/events.parquet", shared_folder(spark), ["event_id"], "ts")


@query("landed_upserts", """SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def landed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, landed in three batches of which the last days come first."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    store = Store(spark, f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}", part_rows=20_000)
    day = F.dayofmonth("ts")
    for number, rows in enumerate((events.where(day > 20), events.where(day <= 10), events.where(day.between(11, 20)))):
        batch = store.begin("landed", number)
        batch.upsert("newest", ["user_id", "event_type"], rows, ["ts", "event_id"])
        batch.commit()
    return store.read("newest")


# A sheet with a series in each row and a month in each column, and one with a row for each series and month.
_TALL = "SELECT lower(trim(o_orderpriority)) AS series, concat(extract(YEAR FROM o_orderdate), '-', lpad(CAST(extract(MONTH FROM o_orderdate) AS VARCHAR(2)), 2, '0')) AS period, count(*) AS n FROM {ord} GROUP BY lower(trim(o_orderpriority)), concat(extract(YEAR FROM o_orderdate), '-', lpad(CAST(extract(MONTH FROM o_orderdate) AS VARCHAR(2)), 2, '0'))"


@query("sheet_series", f"SELECT series, CAST(period || '-01' AS DATE) AS period, CAST(n AS DOUBLE) AS value FROM ({_TALL})")
def sheet_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide sheet read as series, periods and values, whichever way it lies."""
    tall = spark.sql(_TALL, ord=TABLES["ord"](spark, sf_dir))
    return series_of_sheet(tall.groupBy("series").pivot("period").agg(F.first("n")))  # a column for each month


@query("store_catalog", "SELECT CAST(l_suppkey AS VARCHAR) AS store, CAST(l_partkey AS VARCHAR) AS product_id, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS price FROM lineitem WHERE l_partkey > 0 GROUP BY 1, 2")
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed product records of stores, the last of each store and product; of records of one place in the order the dearest."""
    rows = read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_suppkey").cast("string").alias("store"), F.when(F.col("l_partkey") > 0, F.col("l_partkey").cast("string")).alias("product_id"), F.col("l_extendedprice").alias("price"))
    return keep_last(rows, ["store", "product_id"], "seq").drop("seq")


@query("older_posts", "SELECT event_id AS id, floor(epoch(ts))::BIGINT AS created_utc FROM events WHERE floor(epoch(ts))::BIGINT < 1705968000 ORDER BY created_utc DESC, id LIMIT 50000")
def older_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts next before a cursor, the newest first, of as many pages as a run asks for at most."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("created_utc"))
    return backfill(rows, 1705968000, page=100, pages=500)
