"""Tables of observations, products and events shaped from the driver's tables, in Spark and as SQL.

``TABLES`` holds, by name, how Spark builds a table and the SQL of the same rows.
``view`` registers a query whose SQL text runs on both engines over these tables;
``query`` one that is written with the DataFrame API and has SQL of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.classify import classify_change, classify_published, pct
from ..operators.changes import consecutive_changes, first_per_day

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, rest: tuple[str, ...] = ("flag", "discount", "tax")) -> DataFrame:
    """One observation of a product a day: upc, observed_date, size, price, store, and those of flag, discount and tax that are asked for."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    rows = lines.join(orders.select("o_orderkey", "o_orderdate"), lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_partkey").alias("upc"), F.to_date("o_orderdate").alias("observed_date"), "l_orderkey", "l_linenumber",
        F.col("l_suppkey").alias("store"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"),
        *[F.col({"flag": "l_returnflag", "discount": "l_discount", "tax": "l_tax"}[c]).alias(c) for c in rest],
    )
    return first_per_day(rows, ["upc", "observed_date"], ["l_orderkey", "l_linenumber", "store", "price", "size"]).drop("l_orderkey", "l_linenumber")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, brand, category, pack_size, list_price, image_url, manufacturer.

    Both joins behind the manufacturer are outer ones on distinct keys, so they and the
    read of all lines are left out of plans that don't use it.
    """
    part = read(spark, sf_dir, "part")
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.min("l_suppkey").alias("s"))
    makers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("s"), F.col("n_name").alias("manufacturer"))
    makers = makers.groupBy("s").agg(F.min("manufacturer").alias("manufacturer"))
    return part.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("pack_size"), F.col("p_retailprice").alias("list_price"), F.when(F.col("p_size") > 25, F.concat(F.lit("img/"), F.col("p_partkey"))).alias("image_url"),
    ).join(first, "entity_id", "left").join(makers, "s", "left").drop("s")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of size between consecutive observations, with the 15 / 5 scale."""
    changed = consecutive_changes(observations(spark, sf_dir, rest=("flag",)), "upc", "observed_date", "size", carry=["price"])
    found = changed.withColumn("c", classify_change(F.col("size_before"), F.col("size"), F.col("price_before"), F.col("price")))
    return found.select(
        "upc", F.col("observed_date_before").alias("date_before"), F.col("observed_date").alias("date_after"), "size_before", F.col("size").alias("size_after"),
        "price_before", F.col("price").alias("price_after"), "c.*", "store", (F.col("flag") == "R").alias("is_retracted"),
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public events: changes with the 20 / 5 scale and the product's brand, name and category."""
    changes = change_events(spark, sf_dir).drop("change_type", "severity")
    found = changes.join(products(spark, sf_dir), F.col("upc") == F.col("entity_id")).withColumn("c", classify_published(pct(F.col("size_before"), F.col("size_after"))))
    return found.select(
        F.concat_ws("-", F.col("entity_id").cast("string"), F.date_format("date_after", "yyyyMMdd")).alias("event_id"), "entity_id", "brand", F.col("name").alias("product_name"), "category",
        "manufacturer", "image_url", "size_before", "size_after", "size_delta_pct", "price_before", "price_after", "c.change_type", "c.severity",
        F.col("date_after").alias("observed_date"), "is_retracted", "store",
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted claims: one for each order, with sizes, a status, a source and a confidence."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("entity_id"), (F.lit(10) + F.col("o_custkey") % 7).cast("double").alias("old_size"), (F.lit(8) + F.col("o_orderkey") % 3).cast("double").alias("new_size"),
        F.when(F.col("o_custkey") % 2 == 0, "oz").otherwise("g").alias("size_unit"), F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "pending").otherwise("discarded").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("source_type"), F.round(F.col("o_totalprice") / 500000, 3).alias("confidence"), F.to_date("o_orderdate").alias("extracted_date"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw evidence: raw_id, source_type, source_date, user_id, value and a JSON payload."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("raw_id"), F.col("event_type").alias("source_type"), F.to_date("ts").alias("source_date"), F.col("ts").alias("captured_at"), "user_id", "value", F.col("props").alias("payload"),
    )


def cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly price index: the mean order total."""
    return read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.avg("o_totalprice") + 1e-6, 2).alias("value"))


def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with sizes in several units and a kind of source: some missing, some of a unit without a family."""
    s, size = F.col("store") % 8, F.col("size")
    own = F.when(s == 0, size / 1000).when(s == 1, size / 16).when(s == 2, F.lit(None)).otherwise(size)
    unit = F.when(s == 0, "kg").when(s == 1, "LB").when(s == 3, "oz").when(s == 4, "box").otherwise("g")
    return observations(spark, sf_dir, rest=("flag",)).select("upc", "observed_date", own.alias("size"), unit.alias("unit"), "price", "store", F.when(F.col("flag") == "R", "off_catalog").when(F.col("flag") == "A", "kroger_catalog").otherwise("receipt").alias("source_type"))


_CASE_V1 = """CASE WHEN size > size_before THEN 'upsizing' WHEN size < size_before AND price < price_before THEN 'downsizing' WHEN size < size_before THEN 'shrinkflation'
  WHEN size = size_before AND price > price_before THEN 'price_hike' ELSE 'downsizing' END"""
_SQL = {
    "obs": """SELECT upc, observed_date, size, price, store, flag, discount, tax FROM (
  SELECT l_partkey AS upc, CAST(o_orderdate AS DATE) AS observed_date, l_quantity AS size, l_extendedprice AS price, l_suppkey AS store, l_returnflag AS flag, l_discount AS discount, l_tax AS tax,
         row_number() OVER (PARTITION BY l_partkey, CAST(o_orderdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r = 1""",
    "obu": """SELECT upc, observed_date, CASE store % 8 WHEN 0 THEN size / 1000 WHEN 1 THEN size / 16 WHEN 2 THEN NULL ELSE size END AS size, CASE store % 8 WHEN 0 THEN 'kg' WHEN 1 THEN 'LB' WHEN 3 THEN 'oz' WHEN 4 THEN 'box' ELSE 'g' END AS unit,
  price, store, CASE flag WHEN 'R' THEN 'off_catalog' WHEN 'A' THEN 'kroger_catalog' ELSE 'receipt' END AS source_type FROM obs""",
    "ent": """SELECT p_partkey AS entity_id, p_name AS name, p_brand AS brand, p_type AS category, p_size AS pack_size, p_retailprice AS list_price,
  CASE WHEN p_size > 25 THEN concat('img/', p_partkey) END AS image_url, n_name AS manufacturer
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = s LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "chg": f"""SELECT upc, date_before, observed_date AS date_after, size_before, size AS size_after, price_before, price AS price_after,
  round((size - size_before) / NULLIF(size_before, 0) * 100, 2) + 0.0 AS size_delta_pct, round((price - price_before) / NULLIF(price_before, 0) * 100, 2) + 0.0 AS price_delta_pct,
  round(price_before / NULLIF(size_before, 0) + 1e-9, 4) AS ppu_before, round(price / NULLIF(size, 0) + 1e-9, 4) AS ppu_after, {_CASE_V1} AS change_type,
  CASE WHEN (size - size_before) / size_before * 100 <= -15 THEN 'major' WHEN (size - size_before) / size_before * 100 <= -5 THEN 'moderate' ELSE 'minor' END AS severity, store, flag = 'R' AS is_retracted
  FROM (SELECT *, lag(size) OVER w AS size_before, lag(price) OVER w AS price_before, lag(observed_date) OVER w AS date_before FROM obs WINDOW w AS (PARTITION BY upc ORDER BY observed_date)) WHERE size_before <> size""",
    "pub": """SELECT concat(entity_id, '-', strftime(date_after, '%Y%m%d')) AS event_id, entity_id, brand, name AS product_name, category, manufacturer, image_url, size_before, size_after, size_delta_pct, price_before, price_after,
  CASE WHEN size_after <= size_before THEN 'shrinkflation' WHEN (size_after - size_before) / size_before * 100 > 5 THEN 'upsizing' ELSE 'restoration' END AS change_type,
  CASE WHEN (size_after - size_before) / size_before * 100 < -20 THEN 'major' WHEN (size_after - size_before) / size_before * 100 < -5 THEN 'moderate' ELSE 'minor' END AS severity,
  date_after AS observed_date, is_retracted, store FROM chg JOIN ent ON upc = entity_id""",
    "claims": """SELECT o_orderkey AS claim_id, o_custkey AS entity_id, (10 + o_custkey % 7)::DOUBLE AS old_size, (8 + o_orderkey % 3)::DOUBLE AS new_size, CASE WHEN o_custkey % 2 = 0 THEN 'oz' ELSE 'g' END AS size_unit,
  CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'pending' ELSE 'discarded' END AS status, substring(o_orderpriority, 1, 1) AS source_type, round(o_totalprice / 500000, 3) AS confidence, CAST(o_orderdate AS DATE) AS extracted_date FROM orders""",
    "raw": "SELECT event_id AS raw_id, event_type AS source_type, CAST(ts AS DATE) AS source_date, ts AS captured_at, user_id, value, props AS payload FROM events",
    "ord": "SELECT * FROM orders",
    "cpi": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice) + 1e-6, 2) AS value FROM orders GROUP BY 1",
}
TABLES: dict[str, Query] = {"obs": observations, "obu": mixed_units, "ent": products, "chg": change_events, "pub": published, "claims": claims, "raw": raw_items, "cpi": cpi, "ord": lambda spark, sf_dir: read(spark, sf_dir, "orders")}
_NEEDS = {"obu": ["obs"], "chg": ["obs"], "pub": ["obs", "chg", "ent"]}


def with_tables(sql: str) -> str:
    """SQL that may name the tables in braces, with their definitions in front."""
    used = {t for t in re.findall(r"\{(\w+)\}", sql) if t in _SQL}
    order = [t for t in _SQL if t in used or any(t in _NEEDS.get(u, []) for u in used)]
    head = ",\n".join(f"{t} AS ({_SQL[t]})" for t in order)
    body = re.sub(r"\{(" + "|".join(_SQL) + r")\}", r"\1", sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def view(name: str, sql: str, duck: str | None = None) -> None:
    """Registers a query in SQL over the tables; ``duck`` is its text for the other engine where that differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t for t in re.findall(r"\{(\w+)\}", sql)}
        return spark.sql(sql, **{t: TABLES[t](spark, sf_dir) for t in used})

    QUERIES[name] = run
    ORACLE_SQL[name] = with_tables(duck or sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query written with the DataFrame API and its SQL, if it has one."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return register
