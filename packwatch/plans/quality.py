"""Entity resolution and data quality over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.classify import flag_action
from ..functions.text import fuzzy_name_key, normalize_brand, size_bucket
from ..operators import quality as Q
from .base import TABLES, query, read, view
from .views import AS_OF

# What stands for a missing brand.
PLACEHOLDERS = ["unknown", "n/a", "na", "none", "generic", "various", "tbd", "brand#7"]

view("dedup_raw_items", "SELECT source_type, source_id, raw_id, value FROM (SELECT source_type, user_id AS source_id, raw_id, value, row_number() OVER (PARTITION BY source_type, user_id ORDER BY captured_at DESC, raw_id DESC) AS r FROM {raw}) t WHERE r = 1")


@query("fold_events", """SELECT entity_id, old_size, new_size, arg_min(claim_id, (extracted_date, claim_id)) AS origin_claim, min(extracted_date) AS observed_date, count(*) AS evidence_count, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS sources
FROM {claims} WHERE new_size / old_size BETWEEN 0.05 AND 5 AND status <> 'discarded' GROUP BY entity_id, old_size, new_size""")
def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims become events; what has a size ratio outside 0.05..5 is discarded."""
    return Q.fold_claims(TABLES["claims"](spark, sf_dir).where("new_size / old_size between 0.05 and 5 and status <> 'discarded'"))


# Events with a number of evidence rows, which may be missing, and some of the rows themselves.
_PROVEN = "SELECT *, CASE WHEN store % 4 = 0 THEN NULL ELSE store % 3 + 1 END AS evidence_count, CASE WHEN store % 2 = 0 THEN [event_id, concat(event_id, '+'), concat(event_id, '*')] ELSE [] END AS evidence FROM {pub} WHERE NOT is_retracted"


def _proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.when(F.col("store") % 4 != 0, F.col("store") % 3 + 1)
    evidence = F.when(F.col("store") % 2 == 0, F.array("event_id", F.concat("event_id", F.lit("+")), F.concat("event_id", F.lit("*"))))
    return TABLES["pub"](spark, sf_dir).where("not is_retracted").withColumns({"evidence_count": count, "evidence": evidence})


@query("dedup_events_wide", f"""SELECT entity_id, size_before, size_after, min(observed_date) AS first_date, arg_min(event_id, (observed_date, event_id)) AS event_id, count(*) AS merged, greatest(sum(len(evidence)), sum(coalesce(evidence_count, 1)))::BIGINT AS evidence
FROM ({_PROVEN}) GROUP BY entity_id, size_before, size_after""")
def dedup_events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal events of all times are one, with the evidence of all."""
    found = Q.merge_repeats(_proven(spark, sf_dir), ["entity_id", "size_before", "size_after"], "observed_date", "event_id")
    return found.select("entity_id", "size_before", "size_after", F.col("observed_date").alias("first_date"), "event_id", "merged", F.col("evidence_count").alias("evidence"))


@query("dedup_events_window", """WITH RECURSIVE v AS (SELECT event_id, entity_id, size_before, size_after, observed_date FROM {pub} WHERE NOT is_retracted),
a AS (SELECT entity_id, size_before, size_after, min(observed_date) AS anchor FROM v GROUP BY ALL UNION ALL SELECT a.entity_id, a.size_before, a.size_after, min(v.observed_date) AS anchor FROM a JOIN v ON v.entity_id = a.entity_id AND v.size_before = a.size_before AND v.size_after = a.size_after AND v.observed_date > a.anchor + 90 GROUP BY a.entity_id, a.size_before, a.size_after, a.anchor)
SELECT event_id, v.entity_id, v.size_before, v.size_after, observed_date, anchor FROM v JOIN a ON a.entity_id = v.entity_id AND a.size_before = v.size_before AND a.size_after = v.size_after AND a.anchor = v.observed_date""")
def dedup_events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a product with equal sizes within 90 days of the first are one event."""
    keys = ["entity_id", "size_before", "size_after"]
    live = TABLES["pub"](spark, sf_dir).where("not is_retracted").select("event_id", *keys, "observed_date").dropna(subset=["size_before", "size_after"])
    found = Q.cluster_by_days(live, keys, "observed_date", "event_id", 90)
    return found.where("is_canonical").select("event_id", *keys, "observed_date", "anchor")


@query("dedup_entities_strict", """WITH k AS (SELECT entity_id, lower(trim(brand)) AS b, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM {ent})
SELECT entity_id, first AS into, n AS group_size FROM (SELECT *, min(entity_id) OVER (PARTITION BY b, key) AS first, count(*) OVER (PARTITION BY b, key) AS n FROM k WHERE key <> '') WHERE n > 1 AND entity_id <> first""".replace("AS into", "AS \"into\""))
def dedup_entities_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.strict_duplicates(TABLES["ent"](spark, sf_dir))


@query("dedup_entities_fuzzy")
def dedup_entities_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.fuzzy_duplicates(TABLES["ent"](spark, sf_dir))


@query("duplicate_pairs", """WITH e AS (SELECT entity_id, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') || '|' || regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS slug FROM {ent}),
n AS (SELECT entity_id, count(*) AS events FROM {pub} WHERE NOT is_retracted GROUP BY entity_id),
r AS (SELECT e.entity_id, slug, coalesce(events, 0) AS events, first_value(e.entity_id) OVER (PARTITION BY slug ORDER BY coalesce(events, 0) DESC, e.entity_id) AS target FROM e LEFT JOIN n ON n.entity_id = e.entity_id)
SELECT entity_id AS source, target, events AS source_events FROM r WHERE entity_id <> target""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one slug, merged into the one with the most events."""
    from ..functions.text import slugify

    events = TABLES["pub"](spark, sf_dir).where("not is_retracted").groupBy("entity_id").agg(F.count("*").alias("events"))
    rows = TABLES["ent"](spark, sf_dir).join(events, "entity_id", "left").select("entity_id", F.coalesce("events", F.lit(0)).alias("events"), F.concat_ws("|", slugify(F.col("brand")), slugify(F.col("name"))).alias("slug"))
    best = rows.groupBy("slug").agg(F.min(F.struct((-F.col("events")).alias("minus"), "entity_id")).alias("best"))
    return rows.join(best, "slug").where(F.col("entity_id") != F.col("best.entity_id")).select(F.col("entity_id").alias("source"), F.col("best.entity_id").alias("target"), F.col("events").alias("source_events"))


@query("fuzzy_duplicate_groups", """WITH p AS (SELECT entity_id, brand, product_name, size_before, size_after, count(*) OVER (PARTITION BY entity_id) AS events, array_to_string(list_sort(string_split(lower(product_name), ' ')), ' ') AS k FROM {pub} WHERE NOT is_retracted),
m AS (SELECT DISTINCT brand, size_before, size_after, entity_id, events, k FROM p)
SELECT brand, size_before, size_after, count(*) AS products, arg_min(entity_id, (-events, entity_id)) AS target, count(DISTINCT k) < count(*) AS names_match FROM m GROUP BY ALL HAVING count(*) >= 2""")
def fuzzy_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one brand that had a change of the same sizes, the one with the most events as target, and whether two names are alike."""
    return Q.same_change_groups(TABLES["pub"](spark, sf_dir))


@query("claim_groups", """SELECT lower(p_brand) AS brand, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS name_key, concat(CAST(old_size AS INT), size_unit, '→', CAST(new_size AS INT), size_unit) AS bucket, count(*) AS n, min(confidence) AS least, max(confidence) AS most, count(DISTINCT source_type) AS kinds
FROM {claims} JOIN part ON p_partkey = entity_id WHERE status = 'pending' GROUP BY ALL""")
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending claims by brand, name and pair of sizes."""
    rows = TABLES["claims"](spark, sf_dir).where("status = 'pending'").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("entity_id"))
    keys = [normalize_brand(F.col("p_brand")).alias("brand"), fuzzy_name_key(F.col("p_name")).alias("name_key"), size_bucket(F.col("old_size"), F.col("new_size"), F.col("size_unit")).alias("bucket")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.countDistinct("source_type").alias("kinds"))


_PLACE = ", ".join(f"'{x}'" for x in PLACEHOLDERS)
FLAG_SQL = {
    "dq_short_brand": f"SELECT 'short_brand' AS flag_kind, CAST(entity_id AS VARCHAR) AS target, 'med' AS severity, brand AS detail FROM {{ent}} WHERE length(trim(brand)) < 2 OR lower(trim(brand)) IN ({_PLACE})",
    "dq_collision": """SELECT 'fuzzy_brand_collision' AS flag_kind, CAST(entity_id AS VARCHAR) AS target, 'low' AS severity, CAST(first AS VARCHAR) AS detail FROM (SELECT entity_id, min(entity_id) OVER w AS first, count(*) OVER w AS n FROM {ent} WINDOW w AS (PARTITION BY regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'))) WHERE n > 1 AND entity_id <> first""",
    "dq_size_outlier": """SELECT 'size_outlier' AS flag_kind, event_id AS target, CASE WHEN size_after / size_before < 0.1 OR size_after / size_before > 5 THEN 'high' ELSE 'med' END AS severity, CAST(round(size_after / size_before + 1e-9, 3) AS VARCHAR) AS detail FROM {pub} WHERE size_after / size_before < 0.5 OR size_after / size_before > 2""",
    "dq_sku_mashup": """SELECT 'sku_mashup' AS flag_kind, CAST(entity_id AS VARCHAR) AS target, CASE WHEN r >= 10 THEN 'high' ELSE 'med' END AS severity, CAST(round(r + 1e-9, 2) AS VARCHAR) AS detail FROM (SELECT entity_id, max(greatest(size_before, size_after)) / min(least(size_before, size_after)) AS r FROM {pub} GROUP BY entity_id) WHERE r >= 3""",
    "dq_mixed_units": """SELECT 'mixed_units' AS flag_kind, CAST(g AS VARCHAR) AS target, 'low' AS severity, unit AS detail FROM (SELECT g, size_unit AS unit, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, size_unit) AS r, count(*) OVER (PARTITION BY g) AS units FROM (SELECT entity_id // 2 AS g, size_unit FROM {claims}) GROUP BY g, size_unit) WHERE r = 1 AND units > 1""",
    "dq_stuck": f"""SELECT 'stuck_approved_claim' AS flag_kind, CAST(claim_id AS VARCHAR) AS target, 'med' AS severity, CAST(DATE '{AS_OF}' - extracted_date AS VARCHAR) AS detail FROM {{claims}} WHERE status = 'pending' AND DATE '{AS_OF}' - extracted_date > 7""",
}
FLAGS = {
    "dq_short_brand": lambda s, d: Q.short_brand(TABLES["ent"](s, d), PLACEHOLDERS),
    "dq_collision": lambda s, d: Q.brand_collision(TABLES["ent"](s, d)),
    "dq_size_outlier": lambda s, d: Q.size_outlier(TABLES["pub"](s, d)),
    "dq_sku_mashup": lambda s, d: Q.sku_mashup(TABLES["pub"](s, d)),
    "dq_mixed_units": lambda s, d: Q.mixed_units(TABLES["claims"](s, d).withColumn("entity_id", F.expr("entity_id div 2"))),
    "dq_stuck": lambda s, d: Q.stuck(TABLES["claims"](s, d), AS_OF),
}
for _name, _build in FLAGS.items():
    query(_name, FLAG_SQL[_name])(_build)

_ALL = " UNION ALL ".join(FLAG_SQL[n] for n in ("dq_short_brand", "dq_collision", "dq_size_outlier", "dq_sku_mashup"))


@query("dq_triage", f"""WITH n AS (SELECT CAST(entity_id AS VARCHAR) AS target, count(*) AS events FROM {{pub}} WHERE NOT is_retracted GROUP BY entity_id), f AS ({_ALL})
SELECT flag_kind, f.target AS target, severity, CASE WHEN flag_kind = 'fuzzy_brand_collision' THEN CASE WHEN coalesce(events, 0) = 0 THEN 'skip_already_done' ELSE 'merge' END WHEN flag_kind = 'sku_mashup' AND severity = 'high' THEN 'retract_entity'
  WHEN flag_kind = 'size_outlier' AND severity = 'high' THEN 'retract_event' WHEN flag_kind = 'short_brand' AND coalesce(events, 0) = 0 THEN 'retract_entity' ELSE 'leave' END AS action FROM f LEFT JOIN n ON n.target = f.target""")
def dq_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each open flag."""
    flags = reduce(DataFrame.unionByName, [FLAGS[n](spark, sf_dir) for n in ("dq_short_brand", "dq_collision", "dq_size_outlier", "dq_sku_mashup")])
    events = TABLES["pub"](spark, sf_dir).where("not is_retracted").groupBy(F.col("entity_id").cast("string").alias("target")).agg(F.count("*").alias("events"))
    rows = flags.join(events, "target", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return rows.select("flag_kind", "target", "severity", flag_action(F.col("flag_kind"), F.col("severity"), F.col("events"), F.col("events") == 0, F.lit(False)).alias("action"))


@query("raise_flags", f"""SELECT * FROM ({FLAG_SQL["dq_sku_mashup"]}) f WHERE NOT EXISTS (SELECT 1 FROM {{ent}} WHERE CAST(entity_id AS VARCHAR) = f.target AND pack_size > 25)""")
def raise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that are not open yet."""
    open_ = TABLES["ent"](spark, sf_dir).where("pack_size > 25").select(F.lit("sku_mashup").alias("flag_kind"), F.col("entity_id").cast("string").alias("target"))
    return Q.raise_flags(FLAGS["dq_sku_mashup"](spark, sf_dir), open_)




@query("orphan_entities", """SELECT entity_id, brand, name FROM (SELECT entity_id, brand, name FROM {ent} WHERE pack_size <= 45 UNION ALL SELECT s_suppkey + 1000000000, s_name, 'unlisted' FROM supplier) e WHERE NOT EXISTS (SELECT 1 FROM {pub} p WHERE p.entity_id = e.entity_id AND NOT p.is_retracted)""")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that aren't retracted and have no live event; each supplier stands for one that was never seen."""
    from ..operators.lifecycle import without_live_events

    ent = TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name", (F.col("pack_size") > 45).alias("is_retracted"))
    never = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000000).alias("entity_id"), F.col("s_name").alias("brand"), F.lit("unlisted").alias("name"), F.lit(False).alias("is_retracted"))
    return without_live_events(ent.union(never), TABLES["pub"](spark, sf_dir)).drop("is_retracted")


view("missing_upcs", "SELECT entity_id FROM {ent} e WHERE pack_size > 10 AND NOT EXISTS (SELECT 1 FROM {obs} o WHERE o.upc = e.entity_id AND o.store = 1)")
# Pending claims with the fields that their sources' rules ask for.
_DETAILED = """SELECT claim_id, CASE source_type WHEN '1' THEN 'news' WHEN '2' THEN 'gdelt' WHEN '3' THEN 'reddit' WHEN '4' THEN 'openfoodfacts' ELSE 'kroger_change' END AS source_type, CASE WHEN claim_id % 4 = 0 THEN '' WHEN claim_id % 9 = 0 THEN NULL ELSE 'Brand' END AS brand,
  CASE WHEN claim_id % 3 = 0 THEN NULL ELSE old_size END AS old_size, new_size, CASE WHEN claim_id % 5 = 0 THEN confidence END AS old_price, CASE WHEN claim_id % 2 = 0 THEN confidence END AS new_price, CASE WHEN claim_id % 7 = 0 THEN 'picture' END AS image,
  CASE claim_id % 4 WHEN 0 THEN 'kroger-change-v1' WHEN 1 THEN 'kroger-change-v0.9' WHEN 2 THEN 'kroger-change-v2' END AS extractor_version, claim_id % 3 > 0 AS has_image, CASE WHEN claim_id % 8 = 0 THEN 'sheets' ELSE upper(size_unit) END AS size_unit,
  confidence AS confidence_brand, CASE WHEN claim_id % 6 = 0 THEN NULL ELSE 1 - confidence END AS confidence_size, confidence * 2 AS confidence_name, status FROM {claims}"""


def _detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DETAILED, claims=TABLES["claims"](spark, sf_dir))


@query("auto_decline", f"""SELECT claim_id, reason FROM (SELECT *, CASE WHEN source_type IN ('news', 'gdelt') THEN CASE WHEN coalesce(brand, '') = '' THEN source_type || ': no brand' WHEN (old_size IS NULL OR new_size IS NULL) AND (old_price IS NULL OR new_price IS NULL) THEN source_type || ': no size or price change' END
  WHEN source_type = 'reddit' AND image IS NULL THEN 'reddit: no image' WHEN source_type = 'openfoodfacts' AND (old_size IS NULL OR new_size IS NULL) THEN 'openfoodfacts: missing before/after size'
  WHEN source_type = 'kroger_change' AND (extractor_version = 'kroger-change-v1' OR starts_with(extractor_version, 'kroger-change-v0')) THEN 'kroger_change: legacy analyzer' END AS reason FROM ({_DETAILED}) WHERE status = 'pending') WHERE reason IS NOT NULL""")
def auto_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending claims that their source's rules decline, and why."""
    return _detailed(spark, sf_dir).where("status = 'pending'").select("claim_id", Q.decline_reason().alias("reason")).where("reason is not null")


# Units of packaged goods.
AUDIT_UNITS = ["g", "kg", "mg", "oz", "lb", "ml", "l", "fl oz", "ct", "count", "pack"]


@query("audit_filters", f"""SELECT claim_id, CASE WHEN NOT has_image THEN 'no image' WHEN lower(size_unit) NOT IN ({", ".join(map(repr, AUDIT_UNITS))}) THEN 'unit' WHEN confidence_brand IS NULL OR confidence_brand < 0.85 THEN 'brand score' WHEN confidence_size IS NULL OR confidence_size < 0.85 THEN 'size score'
  WHEN confidence_name IS NULL OR confidence_name < 0.8 THEN 'name score' END AS failed FROM ({_DETAILED}) WHERE status = 'matched'""")
def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched claims, and which filter each would have failed."""
    return _detailed(spark, sf_dir).where("status = 'matched'").select("claim_id", Q.passes_audit(AUDIT_UNITS).alias("failed"))




@query("activate_variants", """SELECT entity_id, code FROM (SELECT entity_id, pack_size, CASE entity_id % 7 WHEN 0 THEN concat('CLAIM-', entity_id) WHEN 1 THEN NULL WHEN 2 THEN concat('temp-', entity_id) WHEN 3 THEN 'UNKNOWN7' ELSE CAST(entity_id AS VARCHAR) END AS code FROM {ent})
WHERE code IS NOT NULL AND NOT starts_with(upper(code), 'CLAIM-') AND NOT starts_with(upper(code), 'REDDIT-') AND NOT starts_with(upper(code), 'TEMP-') AND NOT starts_with(upper(code), 'UNKNOWN') AND pack_size <= 40""")
def activate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inactive variants with a code that wasn't made up."""
    from ..functions.records import MADE_UP_VARIANTS, is_made_up

    k = F.col("entity_id") % 7
    code = F.when(k == 0, F.concat(F.lit("CLAIM-"), "entity_id")).when(k == 1, None).when(k == 2, F.concat(F.lit("temp-"), "entity_id")).when(k == 3, "UNKNOWN7").otherwise(F.col("entity_id").cast("string"))
    return TABLES["ent"](spark, sf_dir).where("pack_size <= 40").select("entity_id", code.alias("code")).where(F.col("code").isNotNull() & ~is_made_up(F.col("code"), MADE_UP_VARIANTS))


view("vision_candidates", "SELECT c.claim_id, c.confidence, r.raw_id FROM {claims} c JOIN {raw} r ON r.user_id = c.entity_id WHERE c.confidence >= 0.2 AND c.confidence < 0.5 AND r.source_type = 'view' AND c.status = 'pending'")


@query("match_findings", """WITH f AS (SELECT DISTINCT lower(brand) AS brand, lower(CASE entity_id % 3 WHEN 0 THEN name WHEN 1 THEN string_split(name, ' ')[2] ELSE name[2:7] END) AS product FROM {ent}),
m AS (SELECT f.brand, f.product, entity_id, name, row_number() OVER (PARTITION BY f.brand, f.product ORDER BY length(name), entity_id) AS r FROM f JOIN {ent} e ON lower(e.brand) = f.brand AND contains(lower(name), f.product) WHERE f.product <> '')
SELECT brand, product, entity_id, name FROM m WHERE r = 1""")
def match_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reported brand and product, of whole names, words and parts of them, the shortest name of that brand that holds it."""
    ent = TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name")
    product = F.when(F.col("entity_id") % 3 == 0, F.col("name")).when(F.col("entity_id") % 3 == 1, F.get(F.split("name", " "), F.lit(1))).otherwise(F.substring("name", 2, 6))
    return Q.match_findings(ent.select(F.upper("brand").alias("brand"), product.alias("product")), ent)


@query("promote_staging", f"""SELECT claim_id, entity_id, CAST(extracted_date - 365 AS DATE) AS before_date, extracted_date AS after_date, old_size, new_size, concat('POST-', substring(md5(CAST(claim_id AS VARCHAR)), 1, 8)) AS upc,
  CASE WHEN confidence >= 0.7 AND new_size < old_size THEN 'promote' WHEN confidence < 0.25 THEN 'dismiss' ELSE 'review' END AS outcome FROM {{claims}} WHERE status = 'pending'""")
def promote_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged posts with their outcome and the two versions they stand for."""
    c = TABLES["claims"](spark, sf_dir).where("status = 'pending'")
    outcome = F.when((F.col("confidence") >= 0.7) & (F.col("new_size") < F.col("old_size")), "promote").when(F.col("confidence") < 0.25, "dismiss").otherwise("review")
    return c.select("claim_id", "entity_id", F.date_sub("extracted_date", 365).alias("before_date"), F.col("extracted_date").alias("after_date"), "old_size", "new_size", F.concat(F.lit("POST-"), F.substring(F.md5(F.col("claim_id").cast("string")), 1, 8)).alias("upc"), outcome.alias("outcome"))


@query("latest_per_key", "SELECT entity_id, claim_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY extracted_date DESC, claim_id DESC) AS r FROM {claims}) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that keeps the last row of each key."""
    return TABLES["claims"](spark, sf_dir).groupBy("entity_id").agg(F.max(F.struct("extracted_date", "claim_id", "confidence")).alias("r")).select("entity_id", "r.claim_id", "r.confidence")


@query("claim_group_clusters", """WITH g AS (SELECT lower(p_brand) AS brand, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS name_key, concat(CAST(old_size AS INT), size_unit, '→', CAST(new_size AS INT), size_unit) AS bucket, CASE WHEN claim_id % 5 = 0 THEN NULL ELSE claim_id % 3 END AS entity, source_type, confidence FROM {claims} JOIN part ON p_partkey = entity_id WHERE status = 'pending'),
c AS (SELECT brand, name_key, bucket, string_agg(concat(e, ':', k), ',' ORDER BY k DESC, e) AS clusters FROM (SELECT brand, name_key, bucket, coalesce(CAST(entity AS VARCHAR), 'unmatched') AS e, count(*) AS k FROM g GROUP BY ALL) GROUP BY ALL),
s AS (SELECT brand, name_key, bucket, string_agg(concat(e, ':', k), ',' ORDER BY k DESC, e) AS sources FROM (SELECT brand, name_key, bucket, source_type AS e, count(*) AS k FROM g GROUP BY ALL) GROUP BY ALL)
SELECT g.brand, g.name_key, g.bucket, count(*) AS n, min(confidence) AS least, max(confidence) AS most, any_value(clusters) AS clusters, any_value(sources) AS sources FROM g JOIN c ON (c.brand, c.name_key, c.bucket) = (g.brand, g.name_key, g.bucket) JOIN s ON (s.brand, s.name_key, s.bucket) = (g.brand, g.name_key, g.bucket) GROUP BY g.brand, g.name_key, g.bucket""")
def claim_group_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending claims by brand, name and sizes, with their clusters by product and their sources."""
    rows = TABLES["claims"](spark, sf_dir).where("status = 'pending'").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("entity_id"))
    keys = [normalize_brand(F.col("p_brand")).alias("brand"), fuzzy_name_key(F.col("p_name")).alias("name_key"), size_bucket(F.col("old_size"), F.col("new_size"), F.col("size_unit")).alias("bucket")]
    return Q.claim_groups(rows.select(*keys, F.when(F.col("claim_id") % 5 != 0, F.col("claim_id") % 3).alias("entity_id"), "source_type", "confidence"))


# Events with units and numbers of evidence, for the profiles.
_PROFILED = "SELECT *, CASE store % 5 WHEN 0 THEN ' G ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'oz' ELSE 'g' END AS size_unit, CASE WHEN store % 4 = 0 THEN NULL ELSE store % 7 END AS evidence_count FROM {pub}"


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PROFILED, pub=TABLES["pub"](spark, sf_dir))


@query("profile_outliers", f"SELECT event_id, entity_id, size_before, size_after, round(size_after / size_before, 4) AS ratio, evidence_count FROM ({_PROFILED}) WHERE size_before > 0 AND size_after > 0 AND NOT (size_after / size_before BETWEEN 0.5 AND 2)")
def profile_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.profile_outliers(_profiled(spark, sf_dir)).select("event_id", "entity_id", "size_before", "size_after", "ratio", "evidence_count")


@query("profile_units", f"""WITH c AS (SELECT entity_id, lower(trim(size_unit)) AS u, count(*) AS k FROM ({_PROFILED}) WHERE trim(coalesce(size_unit, '')) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY k DESC, u) AS r FROM c)
SELECT entity_id, sum(k)::BIGINT AS event_count, count(*)::INT AS unit_variants, string_agg(concat(u, '=', k), ', ' ORDER BY r) AS units_breakdown, arg_min(u, r) AS majority_unit, arg_min(k, r) AS majority_count, string_agg(u, ', ' ORDER BY r) FILTER (WHERE r > 1) AS minority_units FROM r GROUP BY entity_id HAVING count(*) > 1""")
def profile_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.profile_units(_profiled(spark, sf_dir))


@query("profile_sizes", f"SELECT entity_id, min(size_before) AS min_size, max(size_before) AS max_size, round(max(size_before) / min(size_before), 2) AS spread_ratio, count(*) AS event_count, CASE WHEN max(size_before) / min(size_before) >= 10 THEN 'extreme' ELSE 'wide' END AS severity FROM ({_PROFILED}) WHERE size_before > 0 GROUP BY entity_id HAVING count(*) >= 2 AND max(size_before) / min(size_before) >= 3")
def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.profile_sizes(_profiled(spark, sf_dir))


@query("profile_duplicates", """WITH n AS (SELECT entity_id AS e, count(*) AS k FROM {pub} GROUP BY 1), s AS (SELECT entity_id, name, coalesce(k, 0) AS k, lower(trim(brand)) AS b, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS g FROM {ent} LEFT JOIN n ON e = entity_id),
r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY b, g) AS m, first_value(entity_id) OVER w AS t, first_value(name) OVER w AS tn, first_value(k) OVER w AS tk FROM s WHERE g <> '' WINDOW w AS (PARTITION BY b, g ORDER BY k DESC, entity_id))
SELECT b AS group_brand, g AS group_slug, entity_id AS source_id, name AS source_name, k AS source_events, t AS target_id, tn AS target_name, tk AS target_events, m AS group_size FROM r WHERE m > 1 AND r > 1""")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = TABLES["pub"](spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("event_count"))
    return Q.profile_duplicates(TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name").join(counts, "entity_id", "left"))
