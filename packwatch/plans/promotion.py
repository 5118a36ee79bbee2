"""Promotion of made-up claims over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.promote import SUSPECT_BRANDS, SUSPECT_NAMES, promote
from ..session import shared_folder
from ..streaming.promotion import Promotion
from ..streaming.store import Store
from .base import TABLES, query, read
from .views import AS_OF

# Claims with brands in several spellings, missing and implausible sizes, codes, images and products set before, one for each order of a customer whose number is a product's.
_CLAIMS = """SELECT o_orderkey AS claim_id, CAST(o_orderkey AS VARCHAR(20)) AS raw_item_id, o_orderdate AS extracted_at, CASE o_orderkey % 5 WHEN 0 THEN lower(p_brand) WHEN 1 THEN NULL ELSE p_brand END AS brand,
  CASE WHEN o_orderkey % 7 = 0 THEN concat(' ', p_name, ' ') WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN concat('Fresh ', p_name) ELSE p_name END AS product_name, p_type AS category,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(10 + o_custkey % 7 AS DOUBLE) END AS old_size, CASE WHEN o_orderkey % 13 = 0 THEN CAST(900 AS DOUBLE) WHEN o_orderkey % 22 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(8 + o_orderkey % 3 AS DOUBLE) END AS new_size,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'oz' END AS old_unit, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'g' END AS new_unit, o_totalprice AS old_price, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS new_price, o_orderpriority AS retailer,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(p_partkey AS VARCHAR(20)) END AS upc, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS observed_date, o_orderkey % 2 = 0 AS has_image, CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_custkey AS VARCHAR(20)) END AS entity_id
FROM {ord} JOIN {part} ON p_partkey = o_custkey"""
_RAW = "SELECT CAST(event_id AS VARCHAR(20)) AS raw_item_id, CASE WHEN event_type IN ('view', 'click') THEN 'reddit' ELSE event_type END AS source_type, CAST(ts AS DATE) AS source_date, user_id % 5 = 0 AS has_social_image FROM {events}"
_ENTITIES = "SELECT CAST(p_partkey AS VARCHAR(20)) AS entity_id, p_brand AS brand, p_name AS name FROM {part} WHERE p_size > 10"
_VARIANTS = "SELECT concat('v', CAST(p_partkey AS VARCHAR(20))) AS variant_id, CAST(p_partkey AS VARCHAR(20)) AS upc FROM {part} WHERE p_size > 30"
_EVENTS = "SELECT concat('e', CAST(p_partkey AS VARCHAR(20))) AS event_id, CAST(p_partkey AS VARCHAR(20)) AS entity_id, CAST(10 + p_partkey % 7 AS DOUBLE) AS size_before, CAST(9 AS DOUBLE) AS size_after, DATE '1994-01-01' AS observed_date, p_size > 40 AS is_retracted FROM {part} WHERE p_size > 10"


def _outcome(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, events = read(spark, sf_dir, "part"), read(spark, sf_dir, "events")
    frame = lambda sql, **tables: spark.sql(sql, **tables)
    claims = frame(_CLAIMS, ord=TABLES["ord"](spark, sf_dir), part=part)
    return promote(claims, frame(_ENTITIES, part=part), frame(_VARIANTS, part=part), frame(_EVENTS, part=part), frame(_RAW, events=events), AS_OF)


def _streamed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same from batches, the late claims first."""
    part, events, orders = read(spark, sf_dir, "part"), read(spark, sf_dir, "events"), TABLES["ord"](spark, sf_dir)
    frame = lambda sql, **tables: spark.sql(sql, **tables)
    claims = frame(_CLAIMS, ord=orders, part=part)
    live = Promotion(Store(spark, f"{shared_folder(spark)}/promotion-{uuid.uuid4().hex}"), frame(_ENTITIES, part=part), frame(_VARIANTS, part=part), frame(_EVENTS, part=part), frame(_RAW, events=events), AS_OF, ["events", "folded"])
    late = F.year("extracted_at") >= 1998
    for number, rows in enumerate((claims.where(late), claims.where(~late))):
        live.step(rows, number)
    return live.tables()


def _bare(sql: str) -> str:
    return sql.replace("{ord}", "orders").replace("{part}", "part").replace("{events}", "events")


_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: concat(upper(x[1:1]), lower(x[2:]))), '')"
_SUSPECT = f"""length(trim(brand)) < 2 OR brand IN ({", ".join(map(repr, SUSPECT_BRANDS))}) OR name IN ({", ".join(map(repr, SUSPECT_NAMES))})"""
#: The claims one by one, with what each finds when its turn comes.
_STEPS = f"""WITH c0 AS ({_bare(_CLAIMS)}), raw_items AS ({_bare(_RAW)}), known AS (SELECT brand, name, min(entity_id) AS id FROM ({_bare(_ENTITIES)}) GROUP BY 1, 2), codes AS (SELECT upc, min(variant_id) AS id FROM ({_bare(_VARIANTS)}) GROUP BY 1),
known_events AS (SELECT * FROM ({_bare(_EVENTS)}) WHERE NOT is_retracted),
c1 AS (SELECT * REPLACE (CASE WHEN coalesce(brand, '') = '' THEN 'Unknown' ELSE {_TITLE.format("trim(brand)")} END AS brand), CASE WHEN coalesce(product_name, '') = '' THEN 'Unknown Product' ELSE trim(product_name) END AS name, nullif(old_size, 0) AS o, nullif(new_size, 0) AS n, coalesce(new_unit, old_unit, 'oz') AS size_unit FROM c0),
c2 AS (SELECT *, CASE WHEN o IS NULL AND n IS NULL THEN 'no size' WHEN old_size IS NOT NULL AND new_size IS NOT NULL AND NOT (old_size > 0 AND new_size / old_size BETWEEN 0.05 AND 5) THEN 'size ratio' END AS reason FROM c1),
c3 AS (SELECT *, row_number() OVER (ORDER BY extracted_at, claim_id) AS turn, lower(brand) || '|' || lower(name) AS k FROM c2 WHERE reason IS NULL),
c4 AS (SELECT c.*, (SELECT arg_max(p.entity_id, p.turn) FROM c3 p WHERE p.k = c.k AND p.turn <= c.turn AND p.entity_id IS NOT NULL) AS before, f.brand AS fb, f.name AS fn, f.category AS fc FROM c3 c JOIN c3 f ON f.k = c.k AND f.turn = (SELECT min(turn) FROM c3 q WHERE q.k = c.k)),
c5 AS (SELECT c4.* EXCLUDE (entity_id), coalesce(before, known.id, 'new-' || substring(md5(k), 1, 16)) AS entity_id, before IS NULL AND known.id IS NULL AS made, codes.id AS code_id, coalesce(codes.id, 'new-upc-' || nullif(c4.upc, ''), 'new-claim-' || claim_id) AS variant_id
  FROM c4 LEFT JOIN known ON known.brand = fb AND known.name = fn LEFT JOIN codes ON codes.upc = c4.upc),
c6 AS (SELECT c5.*, coalesce(observed_date, r.source_date, DATE '{AS_OF}') AS day, coalesce(r.source_type, '') = 'reddit' AND NOT has_image AND NOT coalesce(r.has_social_image, FALSE) AS blocked,
  (SELECT min(event_id) FROM known_events e WHERE e.entity_id = c5.entity_id AND e.size_before = o AND e.size_after = n) AS known_event FROM c5 LEFT JOIN raw_items r ON r.raw_item_id = c5.raw_item_id),
c7 AS (SELECT *, min(CASE WHEN NOT blocked AND o IS NOT NULL AND n IS NOT NULL THEN turn END) OVER (PARTITION BY entity_id, o, n) AS maker FROM c6),
c8 AS (SELECT *, CASE WHEN o IS NULL OR n IS NULL THEN 'matched' WHEN known_event IS NOT NULL THEN 'evidence' WHEN maker IS NULL OR turn < maker THEN 'discarded' WHEN turn = maker THEN 'matched' ELSE 'evidence' END AS status FROM c7)
"""


@query("promoted_claims", f"""{_STEPS} SELECT claim_id, status, CASE WHEN status = 'discarded' THEN 'no image' END AS reason, CASE WHEN status <> 'discarded' THEN entity_id END AS entity_id, CASE WHEN status <> 'discarded' THEN variant_id END AS variant_id FROM c8
UNION ALL SELECT claim_id, 'discarded', reason, NULL, NULL FROM c2 WHERE reason IS NOT NULL""")
def promoted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every claim."""
    return _outcome(spark, sf_dir)["decided"]


@query("promoted_entities", f"""{_STEPS} SELECT entity_id, any_value(fb) AS brand, any_value(fn) AS name, any_value(fc) AS category, bool_or(flagged) AS flagged FROM (SELECT *, (SELECT {_SUSPECT.replace("brand", "fb").replace("name", "fn")}) AS flagged FROM c5 WHERE made) GROUP BY entity_id""")
def promoted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products made for claims, and which names are suspect."""
    out = _outcome(spark, sf_dir)
    flags = out["flags"].select(F.col("target").alias("entity_id"), F.lit(True).alias("flagged"))
    return out["entities"].join(flags, "entity_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


@query("promoted_variants", f"""{_STEPS} SELECT variant_id, entity_id, substring(concat(name, ' (', coalesce(n, o), size_unit, ')'), 1, 200) AS variant_name, coalesce(n, o) AS current_size, size_unit, upc FROM c5 WHERE code_id IS NULL QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY turn) = 1""")
def promoted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants made for claims: one for each new code, one for each claim without a code."""
    return _outcome(spark, sf_dir)["variants"]


@query("promoted_observations", f"""{_STEPS} SELECT variant_id, day AS observed_date, claim_id, retailer, raw_item_id, 'claim_before' AS source_type, o AS size, coalesce(old_unit, size_unit) AS size_unit, old_price AS price FROM c6 WHERE o IS NOT NULL
UNION ALL SELECT variant_id, day, claim_id, retailer, raw_item_id, 'claim_after', n, coalesce(new_unit, size_unit), new_price FROM c6 WHERE n IS NOT NULL""")
def promoted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation for each size of a claim."""
    return _outcome(spark, sf_dir)["observations"]


_EVENTS_MADE = f"""{_STEPS}, t AS (SELECT * FROM c8 WHERE status <> 'discarded' AND o IS NOT NULL AND n IS NOT NULL),
a AS (SELECT entity_id, o AS size_before, n AS size_after, any_value(known_event) AS known_event, count(*) AS evidence_count, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY turn) AS evidence, arg_min(claim_id, turn) AS claim_id, arg_min(day, turn) AS observed_date, arg_min(brand, turn) AS brand, arg_min(name, turn) AS product_name,
  arg_min(size_unit, turn) AS size_unit, arg_min(variant_id, turn) AS variant_id, round((n - o) / o * 100, 2) AS pct FROM t GROUP BY entity_id, o, n)
SELECT known_event, CASE WHEN known_event IS NULL THEN entity_id END AS entity_id, CASE WHEN known_event IS NULL THEN size_before END AS size_before, CASE WHEN known_event IS NULL THEN size_after END AS size_after, CASE WHEN known_event IS NULL THEN pct END AS size_delta_pct,
  CASE WHEN known_event IS NULL THEN CASE WHEN pct <= 0 THEN 'shrinkflation' WHEN pct > 5 THEN 'upsizing' ELSE 'restoration' END END AS change_type, CASE WHEN known_event IS NULL THEN CASE WHEN pct < -20 THEN 'major' WHEN pct < -5 OR pct > 5 THEN 'moderate' ELSE 'minor' END END AS severity,
  CASE WHEN known_event IS NULL THEN brand END AS brand, CASE WHEN known_event IS NULL THEN product_name END AS product_name, CASE WHEN known_event IS NULL THEN size_unit END AS size_unit, CASE WHEN known_event IS NULL THEN observed_date END AS observed_date, CASE WHEN known_event IS NULL THEN variant_id END AS variant_id,
  CASE WHEN known_event IS NULL THEN claim_id END AS claim_id, evidence_count, evidence FROM a"""


@query("promoted_events", _EVENTS_MADE)
def promoted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events made by claims, and known ones with the evidence that joins them."""
    return _events_of(_outcome(spark, sf_dir))


def _events_of(out: dict[str, DataFrame]) -> DataFrame:
    known = out["folded"].select(F.col("event_id").alias("known_event"), F.col("more_evidence").alias("evidence_count"), "evidence")
    return out["events"].unionByName(known, allowMissingColumns=True).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query("streamed_events", _EVENTS_MADE)
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events from claims that come in batches, the late ones first."""
    return _events_of(_streamed(spark, sf_dir))
