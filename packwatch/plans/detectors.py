"""Change detectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import normalize_description, normalize_owner, parse_ingredients, strip_size
from ..functions.units import convert_to_base
from ..operators import changes
from ..operators.ingredients import reformulations
from ..functions.tables import register
from .base import TABLES, observations, query, read

_CHANGED = "(SELECT *, lag(size) OVER w AS before, lag(observed_date) OVER w AS date_before FROM {obs} WINDOW w AS (PARTITION BY upc ORDER BY observed_date))"
_PCT = "(size - before) / before * 100"


@query("variance", f"""
SELECT upc, date_before AS old_date, observed_date AS new_date, before AS old_size, size AS new_size, round({_PCT}, 2) AS pct, CASE WHEN size < before THEN 'decrease' ELSE 'increase' END AS direction
FROM {_CHANGED} WHERE before > 0 AND size > 0 AND abs({_PCT}) > 2""")
def variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.variance(TABLES["obs"](spark, sf_dir), "upc", "observed_date", "size")
    return found.select("upc", F.col("observed_date_before").alias("old_date"), F.col("observed_date").alias("new_date"), F.col("size_before").alias("old_size"), F.col("size").alias("new_size"), "pct", "direction")


@query("latest_drop", f"""
SELECT upc, observed_date AS new_date, date_before AS old_date, size AS new_size, before AS old_size, round({_PCT}, 2) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY upc ORDER BY observed_date DESC) AS r FROM {_CHANGED} WHERE before > 0 AND {_PCT} <= -2) WHERE r = 1""")
def latest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.latest_drop(TABLES["obs"](spark, sf_dir), "upc", "observed_date", "size")
    return found.select("upc", F.col("observed_date").alias("new_date"), F.col("observed_date_before").alias("old_date"), F.col("size").alias("new_size"), F.col("size_before").alias("old_size"), "pct")


_STORE = "(SELECT store, upc, observed_date, size, lag(size) OVER w AS before FROM {obs} WINDOW w AS (PARTITION BY upc, store ORDER BY observed_date))"


@query("flipflop_filtered", f"""
WITH c AS (SELECT upc, store, observed_date, round({_PCT}, 2) AS pct FROM {_STORE} WHERE before > 0 AND before <> size)
SELECT upc, store, observed_date, pct FROM c WHERE pct BETWEEN -50 AND -2 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.upc = c.upc AND d.store = c.store AND d.pct > 0)""")
def flipflop_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls within a store for products that never rose there."""
    rows = TABLES["obs"](spark, sf_dir).withColumn("at", F.struct("upc", "store"))
    found = changes.consecutive_changes(rows, "at", "observed_date", "size").withColumn("pct", F.round((F.col("size") - F.col("size_before")) / F.col("size_before") * 100, 2))
    return changes.without_flipflops(found, "at").select("upc", "store", "observed_date", "pct")


@query("turnover", """
WITH g AS (SELECT brand, category, entity_id AS k, extract(year FROM observed_date)::INT AS release, min(size) AS size FROM {obs} JOIN {ent} ON upc = entity_id GROUP BY ALL),
n AS (SELECT brand, category, release, row_number() OVER (PARTITION BY brand, category ORDER BY release) AS n FROM (SELECT DISTINCT brand, category, release FROM g)),
p AS (SELECT g.*, n.n FROM g JOIN n USING (brand, category, release)),
gone AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.brand = p.brand AND q.category = p.category AND q.k = p.k AND q.n = p.n + 1)),
new AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.brand = p.brand AND q.category = p.category AND q.k = p.k AND q.n = p.n - 1))
SELECT gone.brand, gone.category, gone.k AS old_key, new.k AS new_key, gone.release AS old_release, new.release AS new_release, gone.size AS old_size, new.size AS new_size, round((gone.size - new.size) / gone.size * 100, 2) AS drop_pct
FROM gone JOIN new ON new.brand = gone.brand AND new.category = gone.category AND new.n = gone.n + 1 WHERE (gone.size - new.size) / gone.size * 100 BETWEEN 3 AND 40""")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that one year's range of a brand and category lost, with smaller ones that the next gained."""
    rows = TABLES["obs"](spark, sf_dir).join(TABLES["ent"](spark, sf_dir), F.col("upc") == F.col("entity_id"))
    return changes.turnover(rows.withColumn("release", F.year("observed_date")), ["brand", "category"], "entity_id", "release", "size")


@query("flap_guarded", """
WITH o AS (SELECT upc, extract(year FROM observed_date)::INT AS year, observed_date, ceil(size / 25) * 25 AS size, price FROM {obs}),
w AS (SELECT *, lag(size) OVER a AS b1, lag(size, 2) OVER a AS b2, lag(size, 3) OVER a AS b3, lead(size) OVER a AS nxt, lag(observed_date) OVER a AS d1, lag(price / size) OVER a AS p1,
  coalesce(list(size) OVER (PARTITION BY upc, year ORDER BY observed_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []) AS later,
  coalesce(list(size) OVER (PARTITION BY upc, year ORDER BY observed_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS earlier FROM o WINDOW a AS (PARTITION BY upc, year ORDER BY observed_date)),
c AS (SELECT *, CASE WHEN (size - b1) / b1 * 100 <= -2 THEN 'size_decrease' WHEN (price / size - p1) / p1 * 100 >= 5 THEN 'price_hike' END AS change_type FROM w
  WHERE b1 = b2 AND b1 = b3 AND b1 <> size AND b1 > 0 AND (nxt IS NULL OR nxt = size) AND NOT list_contains(later, b1) AND NOT list_contains(earlier, size))
SELECT upc, year, change_type, d1 AS old_date, observed_date AS new_date, b1 AS old_size, size AS new_size FROM c WHERE change_type IS NOT NULL""")
def flap_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir, rest=()).select("upc", F.year("observed_date").alias("year"), "observed_date", (F.ceil(F.col("size") / 25) * 25).cast("double").alias("size"), "price").withColumn("ppu", F.col("price") / F.col("size"))
    return changes.flap_guarded(rows, ["upc", "year"], "observed_date", "size", "ppu")


_YEARLY = """SELECT upc, extract(year FROM observed_date)::INT AS y, round(avg(size), 3) AS protein, round(avg(discount) * 1000, 3) AS fiber, round(avg(tax) * 1000, 3) AS sugar, round(avg(price) / 100, 3) AS sodium FROM {obs} GROUP BY 1, 2"""


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four figures of a product in a year, in place of nutrients."""
    return TABLES["obs"](spark, sf_dir).groupBy("upc", F.year("observed_date").alias("y")).agg(
        F.round(F.avg("size"), 3).alias("protein"), F.round(F.avg("discount") * 1000, 3).alias("fiber"), F.round(F.avg("tax") * 1000, 3).alias("sugar"), F.round(F.avg("price") / 100, 3).alias("sodium"))


@query("nutrition_skimp", f"""
WITH y AS ({_YEARLY}),
c AS (SELECT e.upc, e.protein AS old_protein, l.protein AS new_protein,
  CASE WHEN e.protein > 1 AND l.protein < e.protein * 0.95 AND l.protein > e.protein * 0.5 THEN round((l.protein - e.protein) * -1 / e.protein * 100, 1) END AS protein_drop,
  CASE WHEN e.fiber > 1 AND l.fiber < e.fiber * 0.95 AND l.fiber > e.fiber * 0.5 THEN round((l.fiber - e.fiber) * -1 / e.fiber * 100, 1) END AS fiber_drop,
  CASE WHEN e.sugar > 1 AND l.sugar > e.sugar * 1.05 AND l.sugar < e.sugar * 1.5 THEN round((l.sugar - e.sugar) / e.sugar * 100, 1) END AS sugar_rise,
  CASE WHEN e.sodium > 10 AND l.sodium > e.sodium * 1.05 AND l.sodium < e.sodium * 1.5 THEN round((l.sodium - e.sodium) / e.sodium * 100, 1) END AS sodium_rise
  FROM y e JOIN y l ON l.upc = e.upc WHERE e.y = 1996 AND l.y = 2000)
SELECT *, round(coalesce(protein_drop, 0) + coalesce(fiber_drop, 0) + coalesce(sugar_rise, 0) + coalesce(sodium_rise, 0), 1) AS skimp_score,
  CASE WHEN round(coalesce(protein_drop, 0) + coalesce(fiber_drop, 0) + coalesce(sugar_rise, 0) + coalesce(sodium_rise, 0), 1) >= 25 THEN 'major' WHEN round(coalesce(protein_drop, 0) + coalesce(fiber_drop, 0) + coalesce(sugar_rise, 0) + coalesce(sodium_rise, 0), 1) >= 12 THEN 'moderate' ELSE 'minor' END AS severity
FROM c WHERE round(coalesce(protein_drop, 0) + coalesce(fiber_drop, 0) + coalesce(sugar_rise, 0) + coalesce(sodium_rise, 0), 1) >= 5""")
def nutrition_skimp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose good figures fell or bad ones rose between two releases."""
    from ..functions.classify import skimp_severity

    y = _yearly(spark, sf_dir)
    early, late = y.where("y = 1996"), y.where("y = 2000").select("upc", *[F.col(c).alias(f"new_{c}") for c in ("protein", "fiber", "sugar", "sodium")])
    gates = {"protein_drop": ("protein", 1, -1), "fiber_drop": ("fiber", 1, -1), "sugar_rise": ("sugar", 1, 1), "sodium_rise": ("sodium", 10, 1)}
    rows = early.join(late, "upc").select("upc", F.col("protein").alias("old_protein"), "new_protein", *[changes.gated(F.col(c), F.col(f"new_{c}"), floor, sign).alias(name) for name, (c, floor, sign) in gates.items()])
    score = F.round(sum((F.coalesce(name, F.lit(0)) for name in gates), F.lit(0.0)), 1)
    return rows.withColumn("skimp_score", score).where("skimp_score >= 5").withColumn("severity", skimp_severity(F.col("skimp_score")))


@query("nutrition_long_to_wide", """
WITH l AS (SELECT l_partkey AS upc, l_linenumber AS nutrient, l_quantity AS amount, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT upc, max(amount) FILTER (WHERE nutrient = 1) AS n1, max(amount) FILTER (WHERE nutrient = 2) AS n2, max(amount) FILTER (WHERE nutrient = 3) AS n3, max(amount) FILTER (WHERE nutrient = 4) AS n4 FROM l WHERE r = 1 GROUP BY upc""")
def nutrition_long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first amount of each nutrient of a product, as columns."""
    first = changes.first_per_day(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("upc"), F.col("l_linenumber").alias("nutrient"), "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"), ["upc", "nutrient"], ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    wide = first.groupBy("upc").pivot("nutrient", [1, 2, 3, 4]).agg(F.max("l_quantity"))
    return wide.select("upc", *[F.col(f"`{k}`").alias(f"n{k}") for k in (1, 2, 3, 4)])


@query("skimp_widest_span", f"""
WITH y AS ({_YEARLY}), s AS (SELECT upc, upc // 4 AS entity, min(y) AS first_year, max(y) AS last_year, arg_min(protein, y) AS first_protein, arg_max(protein, y) AS last_protein FROM y GROUP BY upc)
SELECT entity, upc, first_year, last_year, first_protein, last_protein FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY last_year - first_year DESC, upc) AS r FROM s) WHERE r = 1""")
def skimp_widest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the codes of a product the one observed over the longest time, with its first and last figure."""
    spans = _yearly(spark, sf_dir).groupBy("upc").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.min_by("protein", "y").alias("first_protein"), F.max_by("protein", "y").alias("last_protein")).withColumn("entity", F.expr("upc div 4"))
    widest = F.min(F.struct((F.col("first_year") - F.col("last_year")).alias("minus"), "upc", "first_year", "last_year", "first_protein", "last_protein"))
    return spans.groupBy("entity").agg(widest.alias("r")).select("entity", "r.upc", "r.first_year", "r.last_year", "r.first_protein", "r.last_protein")


# Units of the mixed observations in their base: value, unit.
_BASE = "CASE lower(unit) WHEN 'kg' THEN size * 1000 WHEN 'lb' THEN size * 16 ELSE size END"
_BASE_UNIT = "CASE lower(unit) WHEN 'kg' THEN 'g' WHEN 'lb' THEN 'oz' ELSE lower(unit) END"


def _pairs(where: str = "TRUE") -> str:
    """Neighbours of a code in base units."""
    return f"""(SELECT *, (base - base_before) / base_before * 100 AS change FROM (SELECT *, lag(base) OVER w AS base_before, lag(bu) OVER w AS bu_before, lag(size) OVER w AS size_before, lag(unit) OVER w AS unit_before, lag(observed_date) OVER w AS date_before
  FROM (SELECT *, {_BASE} AS base, {_BASE_UNIT} AS bu FROM {{obu}} WHERE {where}) WINDOW w AS (PARTITION BY upc ORDER BY observed_date)) WHERE bu = bu_before AND base_before > 0 AND base IS NOT NULL)"""


@query("variance_units", f"""
SELECT upc, date_before AS old_date, observed_date AS new_date, size_before AS old_size, unit_before AS old_unit, size AS new_size, unit AS new_unit, round(change, 2) AS pct, CASE WHEN change < 0 THEN 'decrease' ELSE 'increase' END AS direction
FROM {_pairs()} WHERE abs(change) > 2""")
def variance_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of size between neighbours of one base unit."""
    found = changes.unit_variance(TABLES["obu"](spark, sf_dir), "upc", "observed_date", "size", "unit")
    return found.select("upc", F.col("observed_date_before").alias("old_date"), F.col("observed_date").alias("new_date"), F.col("size_before").alias("old_size"), F.col("unit_before").alias("old_unit"), F.col("size").alias("new_size"), F.col("unit").alias("new_unit"), "pct", "direction")


def _latest(since: str, sources: str) -> str:
    return f"""SELECT upc, observed_date AS new_date, date_before AS old_date, size AS new_size, unit AS new_unit, size_before AS old_size, unit_before AS old_unit, source_type, round(change, 2) AS pct
FROM {_pairs(f"source_type IN ({sources}) AND observed_date >= DATE '{since}'")} WHERE change <= -2 AND size <> 0 QUALIFY row_number() OVER (PARTITION BY upc ORDER BY observed_date DESC) = 1"""


def _latest_drop(spark: SparkSession, sf_dir: str, since: str, sources: list[str]) -> DataFrame:
    found = changes.unit_latest_drop(TABLES["obu"](spark, sf_dir), "upc", "observed_date", "size", "unit", "source_type", sources, since)
    return found.select("upc", F.col("observed_date").alias("new_date"), F.col("observed_date_before").alias("old_date"), F.col("size").alias("new_size"), F.col("unit").alias("new_unit"), F.col("size_before").alias("old_size"), F.col("unit_before").alias("old_unit"), "source_type", "pct")


@query("catalog_latest_drop", _latest("2001-02-02", "'off_catalog', 'kroger_catalog', 'walmart_catalog'"))
def catalog_latest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fall of each product in the three catalogs within 180 days."""
    return _latest_drop(spark, sf_dir, "2001-02-02", ["off_catalog", "kroger_catalog", "walmart_catalog"])


@query("off_latest_drop", _latest("2001-05-03", "'off_catalog'"))
def off_latest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one catalog within 90 days."""
    return _latest_drop(spark, sf_dir, "2001-05-03", ["off_catalog"])


@query("kroger_changes", f"""
WITH o AS (SELECT upc, CAST(store % 2 AS VARCHAR) AS store, observed_date, CASE store % 8 WHEN 0 THEN ceil(size * 1000 / 25) / 40 WHEN 1 THEN ceil(size * 16 / 25) * 25 / 16 ELSE ceil(size / 25) * 25 END AS size, unit, price FROM {{obu}} WHERE observed_date >= DATE '1996-01-01'),
k AS (SELECT *, price / size AS ppu, CASE WHEN size IS NOT NULL AND unit <> 'box' THEN round({_BASE}, 4) END AS v, CASE WHEN size IS NOT NULL AND unit <> 'box' THEN concat(round({_BASE}, 4), {_BASE_UNIT}) END AS k, {_BASE_UNIT} AS bu, row_number() OVER (PARTITION BY upc, store ORDER BY observed_date) AS n FROM o),
w AS (SELECT *, lag(k) OVER a AS b1, lag(k, 2) OVER a AS b2, lag(k, 3) OVER a AS b3, lead(k) OVER a AS nxt, lag(v) OVER a AS v1, lag(bu) OVER a AS bu1, lag(size) OVER a AS s1, lag(unit) OVER a AS u1, lag(price) OVER a AS p1, lag(ppu) OVER a AS q1, lag(observed_date) OVER a AS d1 FROM k WINDOW a AS (PARTITION BY upc, store ORDER BY n)),
c AS (SELECT *, CASE WHEN (v - v1) / v1 * 100 <= -2 THEN 'size_decrease' WHEN q1 > 0 AND ppu <> 0 AND (ppu - q1) / q1 * 100 >= 5 THEN 'price_hike' END AS change_type FROM w WHERE b1 = b2 AND b1 = b3 AND b1 <> k AND v1 > 0 AND bu = bu1 AND (nxt IS NULL OR nxt = k)
  AND NOT EXISTS (SELECT 1 FROM k x WHERE x.upc = w.upc AND x.store = w.store AND x.n > w.n AND x.k = w.b1) AND NOT EXISTS (SELECT 1 FROM k x WHERE x.upc = w.upc AND x.store = w.store AND x.n < w.n AND x.k = w.k))
SELECT upc, d1 AS old_date, observed_date AS new_date, count(DISTINCT store) AS store_count, min(store) AS first_store, arg_min(change_type, store) AS change_type, arg_min(s1, store) AS old_size, arg_min(u1, store) AS old_unit, arg_min(size, store) AS new_size, arg_min(unit, store) AS new_unit, arg_min(p1, store) AS old_price, arg_min(price, store) AS new_price
FROM c WHERE change_type IS NOT NULL GROUP BY upc, d1, observed_date""")
def kroger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way changes within two chains of stores, equal ones of both counted as one; sizes in steps, so that they hold for a while."""
    rows, unit = TABLES["obu"](spark, sf_dir), F.col("store") % 8
    size = F.when(unit == 0, F.ceil(F.col("size") * 1000 / 25) / 40).when(unit == 1, F.ceil(F.col("size") * 16 / 25) * 25 / 16).otherwise((F.ceil(F.col("size") / 25) * 25).cast("double"))
    rows = rows.withColumn("size", size.cast("double")).withColumn("store", (F.col("store") % 2).cast("string")).withColumn("ppu", F.col("price") / F.col("size"))
    return changes.store_changes(rows, "upc", "store", "observed_date", "size", "unit", "price", "ppu", since="1996-01-01")


_GROUPED = r"""SELECT trim(regexp_replace(regexp_replace(lower(brand), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm_brand, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm_name, category, entity_id AS k, extract(year FROM observed_date)::INT AS release, size, unit, observed_date
  FROM {obu} JOIN {ent} ON upc = entity_id WHERE size IS NOT NULL"""


@query("turnover_groups", f"""
WITH g AS (SELECT norm_brand, norm_name, category, {_BASE_UNIT} AS base_unit, k, release, arg_min({_BASE}, observed_date) AS size FROM ({_GROUPED}) GROUP BY ALL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY norm_brand, norm_name, category, base_unit ORDER BY release) AS n FROM g),
gone AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE (b.norm_brand, b.norm_name, b.category, b.base_unit, b.k) = (a.norm_brand, a.norm_name, a.category, a.base_unit, a.k) AND b.n = a.n + 1)),
new AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE (b.norm_brand, b.norm_name, b.category, b.base_unit, b.k) = (a.norm_brand, a.norm_name, a.category, a.base_unit, a.k) AND b.n = a.n - 1))
SELECT gone.norm_brand, gone.norm_name, gone.category, gone.base_unit, gone.k AS old_key, new.k AS new_key, gone.release AS old_release, new.release AS new_release, gone.size AS old_size, new.size AS new_size, round((gone.size - new.size) / gone.size * 100, 2) AS drop_pct
FROM gone JOIN new ON (new.norm_brand, new.norm_name, new.category, new.base_unit) = (gone.norm_brand, gone.norm_name, gone.category, gone.base_unit) AND new.n = gone.n + 1 WHERE gone.size > 0 AND (gone.size - new.size) / gone.size * 100 BETWEEN 3 AND 40""")
def turnover_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that left a group of one maker, name, category and base unit, with smaller ones that came to it at the next release."""
    rows = TABLES["obu"](spark, sf_dir).where("size is not null").join(TABLES["ent"](spark, sf_dir), F.col("upc") == F.col("entity_id"))
    rows = rows.withColumn("b", convert_to_base(F.col("size"), F.lower("unit"))).select(normalize_owner(F.col("brand")).alias("norm_brand"), normalize_description(strip_size(F.col("name"))).alias("norm_name"), "category", F.col("b.unit").alias("base_unit"), "entity_id", F.year("observed_date").alias("release"), "observed_date", F.col("b.value").alias("size"))
    group = ["norm_brand", "norm_name", "category", "base_unit"]
    first = changes.first_per_day(rows, [*group, "entity_id", "release"], ["observed_date", "size"])
    return changes.turnover(first, group, "entity_id", "release", "size")


@query("release_drops", f"""
WITH y AS (SELECT upc, extract(year FROM observed_date)::INT AS release, arg_min(size, observed_date) AS size FROM {{obs}} GROUP BY 1, 2),
c AS (SELECT *, lag(size) OVER w AS before, lag(release) OVER w AS old_release FROM y WINDOW w AS (PARTITION BY upc ORDER BY release)),
p AS (SELECT *, round({_PCT}, 2) AS pct FROM c WHERE before > 0 AND before <> size),
r AS (SELECT release, lead(release) OVER (ORDER BY release) AS later FROM (SELECT DISTINCT release FROM y))
SELECT upc, old_release AS old_date, release AS new_date, pct FROM p WHERE pct BETWEEN -50 AND -2 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.upc = p.upc AND q.pct > 0) AND EXISTS (SELECT 1 FROM r WHERE r.release = p.old_release AND r.later = p.release)""")
def release_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls between two releases that follow on one another, of products that never rose."""
    y = changes.first_per_day(observations(spark, sf_dir, rest=()).select("upc", F.year("observed_date").alias("release"), "observed_date", "size"), ["upc", "release"], ["observed_date", "size"])
    found = changes.consecutive_changes(y, "upc", "release", "size").where("size_before > 0")
    pct = F.round((F.col("size") - F.col("size_before")) / F.col("size_before") * 100, 2)
    return changes.release_drops(found.select("upc", F.col("release_before").alias("old_date"), F.col("release").alias("new_date"), pct.alias("pct")), y, "upc")


# What is bad of each nutrient, for promotion and on a product's page.
SKIMP = {"protein": "down", "fiber": "down", "calcium": "down", "sugar": "up", "sodium": "up", "saturated_fat": "up", "calories": "neither", "fat": "neither", "carbs": "neither", "cholesterol": "neither"}
OVERLAY = {"protein": "down", "fiber": "down", "sugar": "up", "sodium": "up", "saturated_fat": "up", "calcium": "down", "calories": "up"}
_FIGURES = {"protein": "avg(size)", "fiber": "avg(discount) * 1000", "sugar": "avg(tax) * 1000", "sodium": "avg(price) / 100", "calcium": "max(size)", "saturated_fat": "max(tax) * 500", "calories": "min(size) * 9", "fat": "min(discount) * 100", "carbs": "max(discount) * 300", "cholesterol": "min(tax) * 700"}
_TEN = "SELECT upc, extract(year FROM observed_date)::INT AS y, " + ", ".join(f"round({x}, 3) AS {n}" for n, x in _FIGURES.items()) + " FROM {obs} GROUP BY 1, 2"


def _ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten figures of a product in a year, in place of nutrients; 0 and null occur."""
    return TABLES["obs"](spark, sf_dir).groupBy("upc", F.year("observed_date").alias("y")).agg(*[F.round(F.expr(x), 3).alias(n) for n, x in _FIGURES.items()])


def _deltas(bad: dict[str, str], early: str, late: str, key: str) -> str:
    """Deltas and score from two relations, as SQL."""
    pct = {c: f"CASE WHEN abs((l.{c} - e.{c}) / nullif(e.{c}, 0) * 100) >= 2 THEN (l.{c} - e.{c}) / nullif(e.{c}, 0) * 100 END" for c in bad}
    parts = " + ".join(f"coalesce(greatest({'-' if bad[c] == 'down' else ''}{c}_raw, 0), 0)" for c in bad if bad[c] != "neither")
    return f"""SELECT {key}, {", ".join(f"round({c}_raw + 1e-9, 1) AS {c}_pct" for c in bad)}, round({parts} + 1e-9, 1) AS skimp_score FROM (SELECT e.{key}, {", ".join(f"{x} AS {c}_raw" for c, x in pct.items())} FROM {early} e JOIN {late} l ON l.{key} = e.{key}) WHERE {parts} >= 5"""


@query("skimp_promotion", f"""WITH y AS ({_TEN}), e AS (SELECT * FROM y WHERE y = 1996), l AS (SELECT * FROM y WHERE y = 2000), d AS ({_deltas(SKIMP, "e", "l", "upc")}),
v AS (SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN concat('0', 100000000000 + entity_id) ELSE CAST(100000000000 + entity_id AS VARCHAR) END AS code FROM {{ent}} WHERE pack_size > 5)
SELECT entity_id, d.*, CASE WHEN skimp_score >= 25 THEN 'major' WHEN skimp_score >= 12 THEN 'moderate' ELSE 'minor' END AS severity FROM d JOIN v ON code IN (CAST(100000000000 + upc AS VARCHAR), concat('0', 100000000000 + upc))""")
def skimp_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose figures worsened between two releases, found among the tracked ones by any form of their code."""
    from ..functions.classify import skimp_severity
    from ..functions.records import product_codes

    y = _ten(spark, sf_dir)
    found = changes.nutrient_deltas(y.where("y = 1996"), y.where("y = 2000"), "upc", SKIMP)
    code = lambda key: (F.lit(100000000000) + F.col(key)).cast("string")
    own = F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("0"), code("entity_id"))).otherwise(code("entity_id"))
    tracked = TABLES["ent"](spark, sf_dir).where("pack_size > 5").select("entity_id", own.alias("code"))
    forms = found.withColumn("code", F.explode(product_codes(code("upc"))))
    return tracked.join(forms, "code").select("entity_id", *found.columns, skimp_severity(F.col("skimp_score")).alias("severity"))


@query("skimp_overlay", f"""WITH y AS (SELECT *, upc // 4 AS entity FROM ({_TEN}) WHERE protein IS NOT NULL),
s AS (SELECT entity, upc, min(y) AS a, max(y) AS z, count(*) AS releases_compared FROM y GROUP BY entity, upc HAVING max(y) > min(y)), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY z - a DESC, upc) = 1),
e AS (SELECT y.* FROM y JOIN b ON b.upc = y.upc AND b.a = y.y), l AS (SELECT y.* FROM y JOIN b ON b.upc = y.upc AND b.z = y.y), d AS ({_deltas(OVERLAY, "e", "l", "entity")})
SELECT d.*, b.upc, a AS before_year, z AS after_year, releases_compared FROM d JOIN b ON b.entity = d.entity""")
def skimp_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a product's codes the one seen over the longest time, with what worsened of seven nutrients."""
    rows = _ten(spark, sf_dir).where("protein is not null").withColumn("entity", F.expr("upc div 4"))
    figures = F.struct(*OVERLAY)
    spans = rows.groupBy("entity", "upc").agg(F.min("y").alias("before_year"), F.max("y").alias("after_year"), F.count("*").alias("releases_compared"), F.min_by(figures, "y").alias("first"), F.max_by(figures, "y").alias("last")).where("after_year > before_year")
    best = F.min(F.struct((F.col("before_year") - F.col("after_year")).alias("minus"), "upc", "before_year", "after_year", "releases_compared", "first", "last"))
    widest = spans.groupBy("entity").agg(best.alias("r")).select("entity", "r.*")
    found = changes.nutrient_deltas(widest.select("entity", "first.*"), widest.select("entity", "last.*"), "entity", OVERLAY)
    return found.join(widest.select("entity", "upc", "before_year", "after_year", "releases_compared"), "entity")


@query("monitor_known_sizes", """SELECT o.upc, o.observed_date, o.size, o.unit, cur.size AS known_size, cur.unit AS known_unit, round((o.size - cur.size) / nullif(cur.size, 0) * 100, 2) AS pct FROM {obu} o
JOIN (SELECT upc, arg_max(coalesce(size, -1), observed_date) AS size, arg_max(unit, observed_date) AS unit FROM {obu} WHERE observed_date < DATE '2000-01-01' GROUP BY upc) cur ON cur.upc = o.upc
WHERE o.observed_date >= DATE '2000-01-01' AND cur.size >= 0 AND lower(o.unit) = lower(cur.unit) AND abs((o.size - cur.size) / nullif(cur.size, 0) * 100) >= 2""")
def monitor_known_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New observations against the size known before 2000."""
    rows = TABLES["obu"](spark, sf_dir)
    known = rows.where("observed_date < date '2000-01-01'").groupBy("upc").agg(F.max_by(F.struct("size", "unit"), "observed_date").alias("r")).select("upc", "r.*")
    return changes.against_current(rows.where("observed_date >= date '2000-01-01'"), known, "upc").select("upc", "observed_date", "size", "unit", "known_size", "known_unit", "pct")


_BARE = r"regexp_replace(upper(trim(replace(text, 'ß', 'ss'))), '\.+$', '')"
for _ in range(10):  # brackets within brackets
    _BARE = rf"regexp_replace(regexp_replace({_BARE}, '\([^()]*\)', '', 'g'), '\[[^\[\]]*\]', '', 'g')"
# The words of a text before a full stop stand for a list; two documents of neighbouring ids are two releases of one product.
_LISTS = f"""SELECT doc_id // 2 AS upc, doc_id AS release, list_filter(list_transform(string_split({_BARE}, ','), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT starts_with(x, '*')) AS items FROM documents"""
_NORMAL = r"list_transform(x, lambda i: trim(regexp_replace(regexp_replace(upper(trim(i)), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')))"


@query("ingredient_reformulation", f"""
WITH d AS ({_LISTS}), e AS (SELECT upc, arg_min(items, release) AS old, arg_max(items, release) AS new FROM d GROUP BY upc HAVING count(DISTINCT release) > 1),
m AS (SELECT upc, {_NORMAL.replace("transform(x", "transform(old")} AS old, {_NORMAL.replace("transform(x", "transform(new")} AS new FROM e WHERE len(old) > 0 AND len(new) > 0),
x AS (SELECT upc, old[1:5] AS top, old, new, i AS place, list_position(new, old[i]) AS now FROM m, LATERAL (SELECT unnest(range(1, least(len(old), 5) + 1)) AS i) WHERE list_position(old[1:5], old[i]) = i)
SELECT upc, sum(CASE WHEN now IS NULL THEN CASE WHEN place <= 3 THEN 10 ELSE 3 END WHEN now - place >= 2 THEN CASE WHEN place <= 3 THEN 5 * (now - place) ELSE now - place END ELSE 0 END)::BIGINT AS significance, count(*) FILTER (WHERE now IS NULL) AS removed,
  array_to_string(list_filter(any_value(new)[1:3], lambda i: NOT list_contains(any_value(old)[1:10], i)), '|') AS new_at_top
FROM x GROUP BY upc HAVING bool_or(now IS NULL OR now > place)""".replace("list_filter(any_value(new)[1:3], lambda i: NOT list_contains(any_value(old)[1:10], i))", "any_value(fresh)").replace("old[1:5] AS top, old, new, i AS place", "list_filter(new[1:3], lambda j: NOT list_contains(old[1:10], j)) AS fresh, i AS place"))
def ingredient_reformulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the leading ingredients of a product between its first and last list, and what is new at the top."""
    docs = read(spark, sf_dir, "documents")
    lists = docs.select(F.expr("doc_id div 2").alias("upc"), F.col("doc_id").alias("release"), parse_ingredients(F.col("text")).alias("items"))
    return reformulations(lists, "upc", "release", "items").withColumn("new_at_top", F.array_join("new_at_top", "|"))


_WORSE = "CASE WHEN e.{0} > {1} AND l.{0} {2} THEN round((l.{0} - e.{0}) * {3} / e.{0} * 100, 1) END"
_GATED = ", ".join(f"{_WORSE.format(n, floor, f'BETWEEN e.{n} * 0.5 + 1e-12 AND e.{n} * 0.95 - 1e-12' if sign < 0 else f'BETWEEN e.{n} * 1.05 + 1e-12 AND e.{n} * 1.5 - 1e-12', sign)} AS {n}_{'fall' if sign < 0 else 'rise'}" for n, floor, sign in (("protein", 1, -1), ("fiber", 1, -1), ("sugar", 1, 1), ("sodium", 10, 1)))
_SUM = "round(coalesce(protein_fall, 0) + coalesce(fiber_fall, 0) + coalesce(sugar_rise, 0) + coalesce(sodium_rise, 0), 1)"
_RELEASES = [(1996, 2000, 5.0), (1994, 1999, 20.0)]


def _functions(spark: SparkSession, sf_dir: str) -> None:
    register(TABLES["obs"](spark, sf_dir), _yearly(spark, sf_dir), TABLES["raw"](spark, sf_dir))


@query("skimp_function", f"WITH y AS ({_YEARLY}), c AS (SELECT e.y AS early, l.y AS late, e.upc, {_GATED} FROM y e JOIN y l ON l.upc = e.upc) SELECT *, {_SUM} AS skimp_score FROM c WHERE " + " OR ".join(f"(early = {a} AND late = {b} AND {_SUM} >= {least})" for a, b, least in _RELEASES))
def skimp_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function for two pairs of releases and two least scores."""
    _functions(spark, sf_dir)
    return spark.sql(" UNION ALL ".join(f"SELECT {a} AS early, {b} AS late, f.* FROM nutrition_skimpflation({a}, {b}, {least}D) f" for a, b, least in _RELEASES))


@query("changes_function", "SELECT p_brand AS brand, upc, observed_date, size_before, size AS size_after, round((size - size_before) / size_before * 100, 2) AS pct FROM part JOIN (SELECT *, lag(size) OVER (PARTITION BY upc ORDER BY observed_date) AS size_before FROM {obs}) ON upc = p_partkey WHERE size <> size_before")
def changes_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function called for every product of a table."""
    _functions(spark, sf_dir)
    return spark.sql("SELECT p_brand AS brand, f.* FROM {part}, LATERAL detect_changes_for_product(p_partkey) f", part=read(spark, sf_dir, "part"))


@query("daily_stats_function", "SELECT a AS as_of, source_type, source_date AS day, count(*) AS n FROM {raw}, (SELECT unnest([DATE '2024-01-30', DATE '2024-01-12']) AS a, unnest([14, 5]) AS d) WHERE source_date > a - d::INT AND source_date <= a GROUP BY ALL")
def daily_stats_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function for two days, of the usual and of five days."""
    _functions(spark, sf_dir)
    return spark.sql("SELECT DATE '2024-01-30' AS as_of, f.* FROM pipeline_daily_stats(DATE '2024-01-30') f UNION ALL SELECT DATE '2024-01-12', f.* FROM pipeline_daily_stats(DATE '2024-01-12', 5) f")

