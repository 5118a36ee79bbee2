"""Merges, retractions, audits and constraint checks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lifecycle as L
from ..operators.actions import replay
from ..operators.quality import strict_duplicates
from ..session import kept, shared_folder
from ..streaming.cascade import Catalogue
from ..streaming.store import Store
from .base import TABLES, query, read, view

_MAP = """m AS (SELECT entity_id AS source, first AS target FROM (SELECT entity_id, min(entity_id) OVER (PARTITION BY lower(trim(brand)), regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) AS first FROM {ent}) WHERE entity_id <> first)"""


@query("merge_entities", f"WITH {_MAP} SELECT event_id, coalesce(target, entity_id) AS entity_id, CASE WHEN target IS NOT NULL THEN entity_id END AS previous_id FROM {{pub}} LEFT JOIN m ON source = entity_id")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = strict_duplicates(TABLES["ent"](spark, sf_dir)).select(F.col("entity_id").alias("source"), F.col("into").alias("target"))
    return L.merge_entities(TABLES["pub"](spark, sf_dir).select("event_id", "entity_id"), mapping)


view("reassign_by_size", """SELECT p.event_id, t.target AS entity_id, p.size_before, p.size_after FROM {pub} p JOIN (SELECT brand, size_before, size_after, min(entity_id) AS target FROM {pub} WHERE NOT is_retracted GROUP BY brand, size_before, size_after) t
ON t.brand = p.brand AND t.size_before = p.size_before AND t.size_after = p.size_after WHERE NOT p.is_retracted AND p.entity_id <> t.target""")


@query("retract_cascade", "SELECT entity_id, count(*) AS events, count(*) FILTER (WHERE is_retracted OR pack_size > 40) AS retracted FROM {pub} JOIN {ent} USING (entity_id) GROUP BY entity_id")
def retract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = L.retract_cascade(TABLES["ent"](spark, sf_dir), TABLES["pub"](spark, sf_dir), F.col("pack_size") > 40)
    return events.groupBy("entity_id").agg(F.count("*").alias("events"), F.count(F.when(F.col("is_retracted"), 1)).alias("retracted"))


@query("status_audit_diff", """WITH b AS (SELECT claim_id, status FROM {claims} WHERE extracted_date < DATE '2000-01-01'), a AS (SELECT claim_id, CASE WHEN confidence > 0.9 THEN 'matched' ELSE status END AS status FROM {claims} WHERE extracted_date >= DATE '1996-01-01' OR source_type <> '5')
SELECT coalesce(b.claim_id, a.claim_id) AS claim_id, b.status AS old_status, a.status AS new_status FROM b FULL JOIN a ON a.claim_id = b.claim_id WHERE b.status IS DISTINCT FROM a.status""")
def status_audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the claims and their differences: before, those until 2000; after, all but the oldest of one source."""
    c = TABLES["claims"](spark, sf_dir)
    after = c.where("extracted_date >= date '1996-01-01' or source_type <> '5'").withColumn("status", F.when(F.col("confidence") > 0.9, "matched").otherwise(F.col("status")))
    return L.status_changes(c.where("extracted_date < date '2000-01-01'"), after, "claim_id", "status")


@query("constraint_violations", """SELECT claim_id, unnest(list_filter([CASE WHEN NOT (new_size / old_size BETWEEN 0.7 AND 1.0) THEN 'ratio' END, CASE WHEN NOT (confidence <= 0.95) THEN 'confidence' END, CASE WHEN NOT (status <> 'discarded' OR source_type <> '5') THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM {claims}""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"ratio": (F.col("new_size") / F.col("old_size")).between(0.7, 1.0), "confidence": F.col("confidence") <= 0.95, "status": (F.col("status") != "discarded") | (F.col("source_type") != "5")}
    return L.violations(TABLES["claims"](spark, sf_dir), "claim_id", rules)


@query("append_new", "SELECT entity_id, min(claim_id) AS claim_id FROM {claims} c WHERE status = 'matched' AND NOT EXISTS (SELECT 1 FROM {claims} p WHERE p.entity_id = c.entity_id AND p.status = 'pending') GROUP BY entity_id")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that only matched claims name."""
    c = TABLES["claims"](spark, sf_dir)
    new = c.where("status = 'matched'").groupBy("entity_id").agg(F.min("claim_id").alias("claim_id"))
    return L.append_new(c.where("status = 'pending'").select("entity_id"), new, ["entity_id"])


@query("upsert", "SELECT claim_id, CASE WHEN source_type = '1' THEN 'checked' ELSE status END AS status FROM {claims}")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = TABLES["claims"](spark, sf_dir).select("claim_id", "status", "source_type")
    return L.upsert(c, c.where("source_type = '1'").withColumn("status", F.lit("checked")), ["claim_id"]).select("claim_id", "status")


view("originator_guard", """SELECT c.claim_id, c.entity_id, c.claim_id = o.origin AS is_originator FROM {claims} c JOIN (SELECT entity_id, old_size, new_size, min(claim_id) AS origin FROM {claims} WHERE status <> 'discarded' GROUP BY entity_id, old_size, new_size) o
ON o.entity_id = c.entity_id AND o.old_size = c.old_size AND o.new_size = c.new_size WHERE c.status = 'pending'""")
view("staging_transitions", "SELECT claim_id, CASE WHEN status = 'discarded' THEN status WHEN confidence > 0.8 THEN 'matched' ELSE coalesce(nullif(status, 'pending'), 'review') END AS status FROM {claims}")


# Made-up claims behind events: the first matched claim of a product's number made each of its events, the last one joined it.
_LINKS = "links AS (SELECT event_id, claim_id FROM {pub} JOIN (SELECT entity_id AS e, min(claim_id) AS a, max(claim_id) AS z FROM {claims} WHERE status = 'matched' GROUP BY entity_id) ON e = entity_id, LATERAL (SELECT unnest([a, z]) AS claim_id))"


def _links(events: DataFrame, claims: DataFrame) -> DataFrame:
    ends = claims.where("status = 'matched'").groupBy("entity_id").agg(F.min("claim_id").alias("a"), F.max("claim_id").alias("z"))
    return events.select("event_id", "entity_id").join(ends, "entity_id").select("event_id", F.explode(F.array("a", "z")).alias("claim_id"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TABLES["pub"](spark, sf_dir).select("event_id", "entity_id", "brand", "product_name", "size_before", "size_after", F.when(F.col("store") % 2 == 0, "oz").alias("size_unit"), "is_retracted")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name", "category", "manufacturer", (F.col("pack_size") > 45).alias("is_retracted"))


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    entities, claims = _entities(spark, sf_dir), TABLES["claims"](spark, sf_dir)
    pairs = strict_duplicates(entities).select(F.col("entity_id").alias("source"), F.col("into").alias("target"))
    variants = TABLES["obs"](spark, sf_dir).select(F.col("upc").alias("entity_id"), F.concat_ws("-", "upc", "store").alias("variant_id")).distinct()
    return L.merge_all(claims, _events(spark, sf_dir), variants, entities, pairs)


@query("merged_events", f"WITH {_MAP} SELECT event_id, coalesce(target, p.entity_id) AS entity_id, CASE WHEN target IS NOT NULL THEN p.entity_id END AS previous_entity_id, coalesce(t.brand, p.brand) AS brand, coalesce(t.name, product_name) AS product_name FROM {{pub}} p LEFT JOIN m ON source = p.entity_id LEFT JOIN {{ent}} t ON t.entity_id = target")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after merging equal products, with the brand and name of the one that stays."""
    return _merged(spark, sf_dir)["events"].select("event_id", "entity_id", "previous_entity_id", "brand", "product_name")


@query("merged_claims", f"WITH {_MAP} SELECT claim_id, coalesce(target, entity_id) AS entity_id, CASE WHEN target IS NOT NULL THEN entity_id END AS previous_entity_id FROM {{claims}} LEFT JOIN m ON source = entity_id")
def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)["claims"].select("claim_id", "entity_id", "previous_entity_id")


@query("merged_entities", f"WITH {_MAP} SELECT entity_id, pack_size > 45 OR target IS NOT NULL AS is_retracted FROM {{ent}} LEFT JOIN m ON source = entity_id")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)["entities"].select("entity_id", "is_retracted")


@query("merge_log", f"""WITH {_MAP} SELECT source, target, (SELECT count(*) FROM {{claims}} c WHERE c.entity_id = source) AS claims_moved, (SELECT count(*) FROM {{pub}} p WHERE p.entity_id = source) AS events_moved, (SELECT count(DISTINCT store) FROM {{obs}} o WHERE o.upc = source) AS variants_moved FROM m""")
def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each merge moved."""
    return _merged(spark, sf_dir)["log"]


_MOVES = """v AS (SELECT event_id, entity_id, brand, size_before, size_after, CASE WHEN store % 2 = 0 THEN 'oz' ELSE '' END AS u, is_retracted FROM {pub}),
mv AS (SELECT DISTINCT v.entity_id AS source, t.target, v.size_before, v.size_after, v.u FROM v JOIN (SELECT brand, size_before, size_after, u, min(entity_id) AS target FROM v GROUP BY ALL) t ON (t.brand, t.size_before, t.size_after, t.u) = (v.brand, v.size_before, v.size_after, v.u) AND t.target <> v.entity_id)"""


def _reassigned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events, claims = kept(_events(spark, sf_dir)), TABLES["claims"](spark, sf_dir)  # written once, as moves and links read them too
    sizes = ["brand", "size_before", "size_after", "u"]
    keyed = events.withColumn("u", F.coalesce("size_unit", F.lit("")))
    targets = keyed.groupBy(*sizes).agg(F.min("entity_id").alias("target"))
    moves = keyed.join(targets, sizes).where("entity_id <> target").select(F.col("entity_id").alias("source"), "target", "size_before", "size_after", F.col("u").alias("size_unit")).distinct()
    return L.reassign_by_size(events, claims, _links(events, claims), _entities(spark, sf_dir), moves)


@query("reassigned_events", f"WITH {_MOVES} SELECT event_id, CASE WHEN target IS NOT NULL AND NOT is_retracted THEN target ELSE v.entity_id END AS entity_id, CASE WHEN target IS NOT NULL AND NOT is_retracted THEN v.entity_id END AS previous_entity_id, CASE WHEN target IS NOT NULL AND NOT is_retracted THEN e.name ELSE o.name END AS product_name FROM v JOIN {{ent}} o ON o.entity_id = v.entity_id LEFT JOIN mv ON mv.source = v.entity_id AND (mv.size_before, mv.size_after, mv.u) = (v.size_before, v.size_after, v.u) LEFT JOIN {{ent}} e ON e.entity_id = target")
def reassigned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events of equal sizes and unit within a brand, moved to the product of the smallest number."""
    return _reassigned(spark, sf_dir)["events"].select("event_id", "entity_id", "previous_entity_id", "product_name")


@query("reassigned_claims", f"""WITH {_MOVES}, {_LINKS}, moved AS (SELECT event_id, v.entity_id AS source, target FROM v JOIN mv ON mv.source = v.entity_id AND (mv.size_before, mv.size_after, mv.u) = (v.size_before, v.size_after, v.u) WHERE NOT is_retracted),
c AS (SELECT claim_id, source, min(target) AS target FROM moved JOIN links USING (event_id) GROUP BY 1, 2)
SELECT k.claim_id, coalesce(target, entity_id) AS entity_id, CASE WHEN target IS NOT NULL THEN entity_id END AS previous_entity_id FROM {{claims}} k LEFT JOIN c ON c.claim_id = k.claim_id AND c.source = k.entity_id""")
def reassigned_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims behind the moved events, which move with them."""
    return _reassigned(spark, sf_dir)["claims"].select("claim_id", "entity_id", "previous_entity_id")


@query("field_audit", "SELECT entity_id, 'category' AS field, category AS old_value, CASE WHEN pack_size > 40 THEN NULL ELSE upper(category) END AS new_value, 'admin' AS edited_by FROM {ent} WHERE pack_size > 20 AND category IS DISTINCT FROM CASE WHEN pack_size > 40 THEN NULL ELSE upper(category) END")
def field_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of edits, those without effect left out."""
    ent = TABLES["ent"](spark, sf_dir)
    edits = ent.where("pack_size > 20").select("entity_id", F.when(F.col("pack_size") <= 40, F.upper("category")).alias("value"))
    return L.set_field(ent, edits, "category", "admin")[1]


@query("brand_merge", "SELECT event_id, CASE WHEN brand = 'Brand#11' AND NOT pack_size > 45 THEN 'Brand#12' WHEN brand = 'Brand#23' AND NOT pack_size > 45 THEN 'Brand#9' ELSE brand END AS brand FROM (SELECT p.event_id, p.brand, e.pack_size FROM {pub} p JOIN {ent} e ON e.entity_id = p.entity_id)")
def brand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after two brands were renamed."""
    brands = spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#23", "Brand#9"), ("Brand#1", "Brand#1")], "source string, target string")
    return L.merge_brands(_entities(spark, sf_dir), _events(spark, sf_dir), brands)[1].select("event_id", "brand")


@query("attribution_sync", "SELECT event_id, e.brand, e.name AS product_name, store % 3 = 0 AND lower(e.brand) <> e.brand AS synced FROM {pub} p JOIN {ent} e ON e.entity_id = p.entity_id")
def attribution_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose brand was spelt otherwise, set right."""
    events = TABLES["pub"](spark, sf_dir).withColumn("brand", F.when(F.col("store") % 3 == 0, F.lower("brand")).otherwise(F.col("brand")))
    return L.sync_attribution(events, TABLES["ent"](spark, sf_dir)).select("event_id", "brand", "product_name", "synced")


_GONE = "size_after / size_before < 0.1 OR size_after / size_before > 5"


def _swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, claims = _events(spark, sf_dir), TABLES["claims"](spark, sf_dir)
    gone = events.where("size_after / size_before < 0.1 or size_after / size_before > 5").select("event_id")
    return L.retract_events(events, claims, _links(events, claims), gone, "size outlier")


@query("swept_events", f"SELECT event_id, is_retracted OR {_GONE} AS is_retracted, CASE WHEN NOT is_retracted AND ({_GONE}) THEN 'size outlier' END AS retraction_reason FROM {{pub}}")
def swept_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after implausible ones were retracted."""
    return _swept(spark, sf_dir)[0].select("event_id", "is_retracted", "retraction_reason")


@query("swept_claims", f"WITH {_LINKS}, b AS (SELECT DISTINCT claim_id FROM links JOIN {{pub}} USING (event_id) WHERE NOT is_retracted AND ({_GONE})) SELECT c.claim_id, CASE WHEN b.claim_id IS NULL THEN status ELSE 'pending' END AS status, CASE WHEN b.claim_id IS NULL THEN entity_id END AS entity_id FROM {{claims}} c LEFT JOIN b ON b.claim_id = c.claim_id")
def swept_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims behind them, pending again."""
    return _swept(spark, sf_dir)[1].select("claim_id", "status", "entity_id")


@query("events_without_image", f"WITH {_LINKS} SELECT event_id FROM {{pub}} p ANTI JOIN (SELECT event_id FROM links JOIN {{claims}} USING (claim_id) WHERE source_type IN ('1', '2')) s USING (event_id) WHERE NOT is_retracted")
def events_without_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events none of whose claims shows a picture."""
    events, claims = _events(spark, sf_dir), TABLES["claims"](spark, sf_dir)
    return L.without_image(events, _links(events, claims), claims.withColumn("has_image", F.col("source_type").isin("1", "2"))).select("event_id")


@query("guarded_update", "SELECT claim_id, CASE WHEN status = 'pending' AND new_size * 2 / old_size <= 1.7 THEN new_size * 2 ELSE new_size END AS new_size, CASE WHEN status = 'pending' AND new_size * 2 / old_size <= 1.7 THEN 'checked' ELSE status END AS status FROM {claims}")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles sizes of pending claims where the ratio stays plausible."""
    rows = TABLES["claims"](spark, sf_dir).select("claim_id", "old_size", "new_size", "status")
    out = L.guarded_update(rows, F.col("status") == "pending", {"new_size": F.col("new_size") * 2, "status": F.lit("checked")}, (F.col("status") != "checked") | (F.col("new_size") / F.col("old_size") <= 1.7))
    return out.select("claim_id", "new_size", "status")


@query("delete_by_pattern", "SELECT raw_id, source_type FROM {raw} WHERE regexp_matches(source_type, '^(view|click|purchase)$')")
def delete_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.delete_unless(TABLES["raw"](spark, sf_dir), "source_type", "^(view|click|purchase)$").select("raw_id", "source_type")


@query("find_or_create", """WITH n AS (SELECT claim_id, p.brand, CASE WHEN source_type = '3' THEN concat('Fresh ', p.name) ELSE p.name END AS name FROM {claims} c JOIN {ent} p ON p.entity_id = c.entity_id)
SELECT claim_id, coalesce(CAST(known AS VARCHAR), substring(md5(concat(lower(n.brand), '|', lower(n.name))), 1, 16)) AS entity_id FROM n LEFT JOIN (SELECT brand, name, min(entity_id) AS known FROM {ent} GROUP BY 1, 2) k ON k.brand = n.brand AND k.name = n.name""")
def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the product of their name, known or made for them."""
    from ..functions.text import entity_key

    ent = TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "name")
    rows = TABLES["claims"](spark, sf_dir).join(ent, "entity_id").select("claim_id", "brand", F.when(F.col("source_type") == "3", F.concat(F.lit("Fresh "), "name")).otherwise(F.col("name")).alias("name"))
    known = ent.groupBy("brand", "name").agg(F.min("entity_id").cast("string").alias("entity_id"))  # ids of new ones are texts
    return L.find_or_create(rows, known, entity_key(F.col("brand"), F.col("name")))[0].select("claim_id", "entity_id")


@query("seeded_manufacturers", """WITH s(place, brand, category, maker) AS (VALUES (1, 'brand#11', 'STEEL', 'First Maker'), (2, 'BRAND#11', NULL, 'Second Maker'), (3, 'Brand#23', 'brass', 'Third Maker'), (4, 'none', NULL, 'Fourth Maker')),
e AS (SELECT entity_id, brand, category, CASE WHEN pack_size > 25 THEN manufacturer END AS manufacturer FROM {ent}), f AS (SELECT entity_id, arg_min(maker, place) AS maker FROM e JOIN s ON lower(s.brand) = lower(e.brand) AND (s.category IS NULL OR contains(lower(e.category), lower(s.category))) WHERE manufacturer IS NULL GROUP BY entity_id)
SELECT e.entity_id, coalesce(maker, manufacturer) AS manufacturer, maker IS NOT NULL AS seeded FROM e LEFT JOIN f ON f.entity_id = e.entity_id""")
def seeded_manufacturers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a manufacturer, seeded by brand and category."""
    seeds = spark.createDataFrame([(1, "brand#11", "STEEL", "First Maker"), (2, "BRAND#11", None, "Second Maker"), (3, "Brand#23", "brass", "Third Maker"), (4, "none", None, "Fourth Maker")], "place int, brand string, category string, manufacturer string")
    ent = TABLES["ent"](spark, sf_dir).select("entity_id", "brand", "category", F.when(F.col("pack_size") > 25, F.col("manufacturer")).alias("manufacturer"))
    return L.seed_manufacturers(ent, seeds).select("entity_id", "manufacturer", "seeded")


# A log of an action for each order: approvals, evidence, discards, edits, merges of a product into its neighbour, and undos of the action just before, undos among them.
_ACTIONS = """SELECT seq, kind, claim_id, value, entity_id, source, target, CASE WHEN kind = 'undo' THEN seq - 1 END AS undoes FROM (
  SELECT o_orderkey AS seq, o_custkey AS claim_id, o_orderpriority AS value, o_custkey + 5 AS entity_id, o_custkey AS source, o_custkey + 1 AS target,
  CASE (o_orderkey * 7919 + o_custkey) % 9 WHEN 0 THEN 'approve' WHEN 1 THEN 'evidence' WHEN 2 THEN 'discard' WHEN 3 THEN 'edit_brand' WHEN 4 THEN 'edit_product_name' WHEN 5 THEN 'merge' WHEN 6 THEN 'merge' ELSE 'undo' END AS kind FROM {ord})"""
_NAMED = "SELECT claim_id, status, entity_id, p_brand AS brand, p_name AS product_name FROM {claims} LEFT JOIN {part} ON p_partkey = entity_id"
_ENTS = "SELECT entity_id, pack_size > 45 AS is_retracted FROM {ent}"


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    claims = spark.sql(_NAMED, claims=TABLES["claims"](spark, sf_dir), part=read(spark, sf_dir, "part"))
    return replay(claims, spark.sql(_ENTS, ent=TABLES["ent"](spark, sf_dir)), spark.sql(_ACTIONS, ord=TABLES["ord"](spark, sf_dir)))


#: An action counts if an even number of undos follow on it in a row; claims step from merge to merge.
_REPLAY = f"""a AS ({_ACTIONS}), u AS (SELECT *, min(CASE WHEN kind <> 'undo' OR NOT before THEN seq END) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(seq) OVER () AS final FROM (SELECT *, coalesce(lag(seq) OVER (ORDER BY seq) = seq - 1, FALSE) AS before FROM a)),
k AS (SELECT *, (SELECT count(*) FROM a b WHERE b.seq > u.seq AND b.seq < coalesce(stop, final + 1)) AS n FROM u WHERE kind <> 'undo'), e AS (SELECT * FROM k WHERE n % 2 = 0),
m AS (SELECT seq, source, target FROM e WHERE kind = 'merge'), c AS ({_NAMED.replace("{part}", "part")}),
s AS (SELECT c.claim_id, coalesce(CASE (SELECT arg_max(kind, seq) FROM e WHERE e.claim_id = c.claim_id AND kind IN ('approve', 'evidence', 'discard')) WHEN 'approve' THEN 'matched' WHEN 'evidence' THEN 'evidence' WHEN 'discard' THEN 'discarded' END, status) AS status,
  coalesce((SELECT arg_max(e.entity_id, seq) FROM e WHERE e.claim_id = c.claim_id AND kind = 'approve'), c.entity_id) AS entity_id, coalesce((SELECT max(seq) FROM e WHERE e.claim_id = c.claim_id AND kind = 'approve'), -1) AS since,
  coalesce((SELECT arg_max(value, seq) FROM e WHERE e.claim_id = c.claim_id AND kind = 'edit_brand'), brand) AS brand, coalesce((SELECT arg_max(value, seq) FROM e WHERE e.claim_id = c.claim_id AND kind = 'edit_product_name'), product_name) AS product_name FROM c),
w AS (SELECT claim_id, entity_id AS spot, since, NULL::BIGINT AS previous UNION_STEPS)"""


@query("replayed_claims", "WITH RECURSIVE " + _REPLAY.replace("UNION_STEPS", "FROM s UNION ALL SELECT w.claim_id, m.target, m.seq, m.source FROM w JOIN m ON m.source = w.spot AND m.seq > w.since WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.source = w.spot AND x.seq > w.since AND x.seq < m.seq)")
       + " SELECT s.claim_id, status, spot AS entity_id, previous AS previous_entity_id, brand, product_name FROM s JOIN (SELECT claim_id, arg_max(spot, w.since) AS spot, max_by(previous, w.since) AS previous FROM w GROUP BY claim_id) z ON z.claim_id = s.claim_id")
def replayed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a log of actions."""
    return _replayed(spark, sf_dir)[0]


@query("replayed_products", "WITH " + _REPLAY[: _REPLAY.index(", c AS (")].rstrip() + ", p AS (" + _ENTS + ") SELECT entity_id, is_retracted OR entity_id IN (SELECT source FROM m) AS is_retracted FROM p")
def replayed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products after the same log: what was merged into another is retracted."""
    return _replayed(spark, sf_dir)[1]


@query("cascaded_changes", f"""WITH {_LINKS}, b AS (SELECT event_id, bool_and(status = 'discarded' OR confidence < 0.6) AS bare, bool_or(status <> 'discarded') AS had FROM links JOIN {{claims}} USING (claim_id) GROUP BY event_id),
ev AS (SELECT event_id, entity_id, NOT is_retracted AS live, NOT is_retracted AND coalesce(bare, FALSE) AS goes FROM {{pub}} LEFT JOIN b USING (event_id)),
p AS (SELECT entity_id, bool_or(goes) AND bool_and(NOT live OR goes) AS lost FROM ev GROUP BY entity_id)
SELECT 'event' AS what, event_id AS id FROM ev WHERE goes UNION ALL SELECT 'product', CAST(entity_id AS VARCHAR) FROM {{ent}} JOIN p USING (entity_id) WHERE lost AND pack_size <= 45""")
def cascaded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and products that are retracted when claims of little confidence are discarded, read from the changes between two versions."""
    claims = TABLES["claims"](spark, sf_dir)
    events = kept(_events(spark, sf_dir).select("event_id", "entity_id", "is_retracted"))  # read by three tables of the load
    store = Store(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}")
    catalogue = Catalogue(store)
    catalogue.load(claims, events, kept(_links(events, claims).distinct()), spark.sql(_ENTS, ent=TABLES["ent"](spark, sf_dir)))
    catalogue.step(0, claims.where("confidence < 0.6").select("claim_id", F.lit("discarded").alias("status")))
    changed = lambda name, key: store.changes(name, [key], 1).where("kind = 'update' and after.is_retracted").select(F.lit(name[:-1]).alias("what"), F.col(key).cast("string").alias("id"))
    return changed("events", "event_id").union(changed("products", "entity_id"))


# Triples that stand for a knowledge base: each brand leads to suppliers of its products by one of the properties, each supplier is of its nation's class; labels that are empty, addresses, bare ids or a brand occur.
_TRIPLES = """SELECT p_brand AS subject, CASE WHEN l_suppkey % 10 = 0 THEN 'P176' WHEN l_suppkey % 3 = 0 THEN 'P127' WHEN l_suppkey % 3 = 1 THEN 'P749' ELSE 'P17' END AS property, concat('S', l_suppkey) AS object FROM {lines} JOIN {part} ON p_partkey = l_partkey
UNION ALL SELECT concat('S', s_suppkey), 'P31', concat('C', s_nationkey) FROM {supplier}"""
_LABELS = "SELECT concat('S', s_suppkey) AS qid, CASE s_suppkey % 7 WHEN 0 THEN concat('http://x/', s_suppkey) WHEN 1 THEN concat('Q', s_suppkey) WHEN 2 THEN '' WHEN 3 THEN concat('brand#1', s_suppkey % 5 + 1) ELSE s_name END AS label FROM {supplier}"
_DENIED = [f"C{k}" for k in (0, 3, 7, 11, 12, 13, 20)]


@query("chased_manufacturers", f"""WITH t AS ({_TRIPLES}), l AS ({_LABELS}), c AS (SELECT subject AS brand, label, CASE property WHEN 'P176' THEN 1 WHEN 'P127' THEN 2 ELSE 3 END AS place FROM t JOIN l ON qid = object WHERE property IN ('P176', 'P127', 'P749')
  AND label <> '' AND NOT starts_with(label, 'http') AND NOT regexp_matches(label, '^Q[0-9]+$') AND object <> subject AND NOT EXISTS (SELECT 1 FROM t k WHERE k.subject = t.object AND k.property = 'P31' AND k.object IN {tuple(_DENIED)}))
SELECT brand, arg_min(label, (place, label)) AS manufacturer FROM c GROUP BY brand""".replace("{lines}", "lineitem").replace("{part}", "part").replace("{supplier}", "supplier"))
def chased_manufacturers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers of brands by manufacturer, owner or parent, without denied classes."""
    tables = {"lines": read(spark, sf_dir, "lineitem"), "part": read(spark, sf_dir, "part"), "supplier": read(spark, sf_dir, "supplier")}
    brands = tables["part"].select(F.col("p_brand").alias("brand"), F.col("p_brand").alias("qid")).distinct()
    return L.chase_manufacturers(brands, spark.sql(_TRIPLES, **tables), spark.sql(_LABELS, supplier=tables["supplier"]), _DENIED)
