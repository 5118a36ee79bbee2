"""Promotion of claims to products, variants, observations and events, as sets instead of one claim after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import classify_promoted
from ..functions.text import entity_key, title_case

# Names that stand for a missing brand or product, and the bounds of a plausible ratio of sizes.
SUSPECT_BRANDS = ["Unknown", "Various", "Poor", "N/A", "Generic", "Misc"]
SUSPECT_NAMES = ["Unknown Product", "Product", "Item"]
RATIO_MIN, RATIO_MAX = 0.05, 5.0


def brand_of(brand: Column) -> Column:
    return F.when(F.coalesce(brand, F.lit("")) == "", "Unknown").otherwise(title_case(F.trim(brand)))


def name_of(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown Product").otherwise(F.trim(name))


def is_suspect(brand: Column, name: Column) -> Column:
    """Brands that are placeholders or shorter than two characters, and placeholder names."""
    return (F.length(F.trim(F.coalesce(brand, F.lit("")))) < 2) | F.coalesce(brand, F.lit("")).isin(SUSPECT_BRANDS) | name.isin(SUSPECT_NAMES)


def sane_ratio(old: Column, new: Column) -> Column:
    """Whether two sizes can be one product's; true where one is missing."""
    return F.when(old.isNull() | new.isNull(), True).when(old <= 0, False).otherwise((new / old).between(RATIO_MIN, RATIO_MAX))


def prepared(claims: DataFrame) -> DataFrame:
    """Claims with their brand, name, sizes, unit, name key, and why they are refused, if they are."""
    rows = claims.withColumns({"brand": brand_of(F.col("brand")), "name": name_of(F.col("product_name")), "old": F.nullif(F.col("old_size"), F.lit(0.0)), "new": F.nullif(F.col("new_size"), F.lit(0.0))})
    rows = rows.withColumn("size_unit", F.coalesce("new_unit", "old_unit", F.lit("oz")))
    reason = F.when(F.col("old").isNull() & F.col("new").isNull(), "no size").when(~sane_ratio(F.col("old_size"), F.col("new_size")), "size ratio")
    return rows.withColumn("reason", reason).withColumn("key", entity_key(F.trim("brand"), F.trim("name")))


def resolved(live: DataFrame, entities: DataFrame, send: Callable[[DataFrame], DataFrame] = lambda names: names) -> DataFrame:
    """Claims that aren't refused, whole name keys of them, with their product: ``resolved``, ``is_new`` and ``first`` (the key's first claim).

    Only keys with a product set before are read in order; the first claim of a key is an aggregate,
    and known products are looked up for keys.  ``send`` may prepare the keys for their join with the claims.
    """
    at = F.struct("extracted_at", "claim_id")
    first = live.groupBy("key").agg(F.min_by(F.struct("brand", "name", "category", "claim_id"), at).alias("first"), F.count("entity_id").alias("set"))
    known = entities.groupBy(F.col("brand").alias("kb"), F.col("name").alias("kn")).agg(F.min("entity_id").alias("known_id"))
    first = first.join(known, (F.col("first.brand") == F.col("kb")) & (F.col("first.name") == F.col("kn")), "left").drop("kb", "kn")
    live = live.join(send(first), "key")
    so_far = Window.partitionBy("key").orderBy("extracted_at", "claim_id").rowsBetween(Window.unboundedPreceding, 0)
    ordered = live.where("set > 0").withColumn("set_before", F.last("entity_id", ignorenulls=True).over(so_far))
    live = ordered.unionByName(live.where("set = 0").withColumn("set_before", F.lit(None).cast(live.schema["entity_id"].dataType))).drop("set")
    return live.withColumns({"resolved": F.coalesce("set_before", "known_id", F.concat(F.lit("new-"), "key")), "is_new": F.col("set_before").isNull() & F.col("known_id").isNull()})


def made_entities(live: DataFrame) -> DataFrame:
    """Products that claims make: entity_id, brand, name, category, claim_id of the key's first claim."""
    return live.where("is_new").groupBy(F.col("resolved").alias("entity_id")).agg(F.any_value("first.brand").alias("brand"), F.any_value("first.name").alias("name"), F.any_value("first.category").alias("category"), F.any_value("first.claim_id").alias("claim_id"))


def suspect_flags(made: DataFrame) -> DataFrame:
    return made.where(is_suspect(F.col("brand"), F.col("name"))).select(F.lit("short_brand").alias("flag_kind"), F.col("entity_id").alias("target"), F.lit("med").alias("severity"), "claim_id")


def placed(live: DataFrame, variants: DataFrame, raw_items: DataFrame, today: str) -> DataFrame:
    """Claims with their variant, day, and whether they may make an event; those without a code are spread over all tasks."""
    codes = variants.where("upc is not null").groupBy("upc").agg(F.min("variant_id").alias("known_variant")).withColumn("spread", F.hash("upc"))
    live = live.withColumn("spread", F.hash(F.coalesce("upc", F.col("claim_id").cast("string")))).join(codes, ["upc", "spread"], "left").drop("spread").withColumn("variant_id", F.coalesce("known_variant", F.when(F.coalesce("upc", F.lit("")) != "", F.concat(F.lit("new-upc-"), "upc")), F.concat(F.lit("new-claim-"), F.col("claim_id").cast("string"))))
    live = live.join(raw_items, "raw_item_id", "left").withColumn("day", F.coalesce("observed_date", "source_date", F.lit(today).cast("date")))
    blocked = (F.coalesce("source_type", F.lit("")) == "reddit") & ~F.coalesce("has_image", F.lit(False)) & ~F.coalesce("has_social_image", F.lit(False))
    return live.withColumn("blocked", blocked)


def made_variants(live: DataFrame) -> DataFrame:
    """Variants that claims make, whole variants of them: each after its first claim."""
    size = F.coalesce("new", "old")
    label = F.substring(F.concat(F.col("name"), F.lit(" ("), size.cast("string"), F.col("size_unit"), F.lit(")")), 1, 200)
    first_of = F.min_by(F.struct(F.col("resolved").alias("entity_id"), label.alias("variant_name"), size.alias("current_size"), "size_unit", "upc"), F.struct("extracted_at", "claim_id")).alias("r")
    return live.where("known_variant is null").groupBy("variant_id").agg(first_of).select("variant_id", "r.*")


def made_observations(live: DataFrame) -> DataFrame:
    """An observation for each size of a claim."""
    sides = F.array(F.struct(F.lit("claim_before").alias("source_type"), F.col("old").alias("size"), F.coalesce("old_unit", "size_unit").alias("size_unit"), F.col("old_price").alias("price")), F.struct(F.lit("claim_after").alias("source_type"), F.col("new").alias("size"), F.coalesce("new_unit", "size_unit").alias("size_unit"), F.col("new_price").alias("price")))
    return live.select("variant_id", F.col("day").alias("observed_date"), "claim_id", "retailer", "raw_item_id", F.explode(sides).alias("side")).where("side.size is not null").select("variant_id", "observed_date", "claim_id", "retailer", "raw_item_id", "side.*")


def outcomes(sized: DataFrame, events: DataFrame) -> DataFrame:
    """Claims with both sizes, whole events of them, with their ``status`` and the ``known_event`` they join."""
    known_events = events.where("not is_retracted").groupBy(F.col("entity_id").alias("resolved"), F.col("size_before").alias("old"), F.col("size_after").alias("new")).agg(F.min_by("event_id", F.struct("observed_date", "event_id")).alias("known_event"))
    sized = sized.join(known_events, ["resolved", "old", "new"], "left")
    sized = sized.withColumn("at", F.struct("extracted_at", "claim_id")).withColumn("maker", F.min(F.when(~F.col("blocked"), F.col("at"))).over(Window.partitionBy("resolved", "old", "new")))
    outcome = F.when(F.col("known_event").isNotNull(), "evidence").when(F.col("maker").isNull() | (F.col("at") < F.col("maker")), "discarded").when(F.col("at") == F.col("maker"), "matched").otherwise("evidence")
    return sized.withColumn("status", outcome)


def made_events(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New events with their evidence, and known ones with what joins them."""
    first = F.min_by(F.struct(F.col("brand"), F.col("name").alias("product_name"), "size_unit", F.col("day").alias("observed_date"), "variant_id", "claim_id"), "at")
    evidence = F.array_sort(F.collect_list(F.struct("at", "claim_id")))
    taken = sized.where("status <> 'discarded'")
    new_events = taken.where("known_event is null").groupBy(F.col("resolved").alias("entity_id"), F.col("old").alias("size_before"), F.col("new").alias("size_after")).agg(first.alias("r"), F.count("*").alias("evidence_count"), evidence.alias("e"))
    new_events = new_events.withColumn("size_delta_pct", F.round((F.col("size_after") - F.col("size_before")) / F.col("size_before") * 100, 2)).withColumn("c", classify_promoted(F.col("size_delta_pct")))
    new_events = new_events.select("entity_id", "size_before", "size_after", "size_delta_pct", "c.*", "r.*", "evidence_count", F.transform("e", lambda x: x["claim_id"]).alias("evidence"))
    folded = taken.where("known_event is not null").groupBy(F.col("known_event").alias("event_id")).agg(F.count("*").alias("more_evidence"), evidence.alias("e")).select("event_id", "more_evidence", F.transform("e", lambda x: x["claim_id"]).alias("evidence"))
    return new_events, folded


def decisions(live: DataFrame, sized: DataFrame) -> DataFrame:
    """claim_id, status, reason, entity_id, variant_id of resolved claims; ``sized`` holds the outcomes of those with both sizes."""
    statuses = sized.select("claim_id", F.col("status").alias("sized_status"))
    decided = live.join(statuses, "claim_id", "left").select("claim_id", F.coalesce("sized_status", F.lit("matched")).alias("status"), F.when(F.col("sized_status") == "discarded", "no image").alias("reason"), F.col("resolved").alias("entity_id"), "variant_id")
    return decided.withColumns({c: F.when(F.col("status") != "discarded", F.col(c)) for c in ("entity_id", "variant_id")})


def refusals(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("claim_id", F.lit("discarded").alias("status"), "reason", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("variant_id"))


def promote(claims: DataFrame, entities: DataFrame, variants: DataFrame, events: DataFrame, raw_items: DataFrame, today: str) -> dict[str, DataFrame]:
    """What approved claims become, in the order of extracted_at and claim_id.

    claims: claim_id, raw_item_id, extracted_at, brand, product_name, category,
    old_size, new_size, old_unit, new_unit, old_price, new_price, retailer, upc,
    observed_date, has_image, entity_id (set before, or null).
    entities: entity_id, brand, name.  variants: variant_id, upc.  events: event_id,
    entity_id, size_before, size_after, observed_date, is_retracted.  raw_items:
    raw_item_id, source_type, source_date, has_social_image.  Ids are texts.

    Returns ``decided`` (claim_id, status, reason, entity_id, variant_id), ``entities``
    and ``flags`` (new ones; suspect names are flagged), ``variants`` (new ones),
    ``observations`` (one for each size of a claim), ``events`` (new ones, with their
    evidence) and ``folded`` (known events with the evidence that joins them).

    A claim without sizes, or with an implausible ratio, is discarded.  A product is
    the one set before; else that of the last claim of its brand and name, in any
    case, whose product was set before; else one of exactly this brand and name; else
    a new one.  A code has one variant; a claim without a code makes its own.  Equal
    sizes of a product are one event: a live one that is known, else one that the
    first eligible claim makes; the others fold into it.  A forum post without an
    image can't make an event, only join one; before there is one it is discarded.
    """
    rows = prepared(claims)
    live = placed(resolved(rows.where("reason is null"), entities), variants, raw_items, today)
    made = made_entities(live)
    sized = outcomes(live.where("old is not null and new is not null"), events)
    new_events, folded = made_events(sized)
    decided = decisions(live, sized).unionByName(refusals(rows))
    return {"decided": decided, "entities": made.drop("claim_id"), "flags": suspect_flags(made), "variants": made_variants(live), "observations": made_observations(live), "events": new_events, "folded": folded}
