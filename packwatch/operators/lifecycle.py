"""Rewrites of whole tables in place of updates: each returns new frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def merge_entities(rows: DataFrame, mapping: DataFrame, key: str = "entity_id") -> DataFrame:
    """Moves rows from merged products to their targets; ``previous_id`` keeps where a moved row came from.

    mapping: source, target; a source has one target and is no target itself.
    """
    moved = rows.join(mapping.withColumnRenamed("source", key), key, "left")
    return moved.withColumn("previous_id", F.when(F.col("target").isNotNull(), F.col(key))).withColumn(key, F.coalesce("target", key)).drop("target")


def merge_all(claims: DataFrame, events: DataFrame, variants: DataFrame, entities: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Merges products into others: the new claims, events, variants and entities, and a log of what moved.

    pairs: source, target; a source has one target and is no target itself.  Pairs of
    one product, or with an unknown one, change nothing.  Moved rows keep where they
    were as previous_entity_id, events take the target's brand and name, sources are
    retracted.
    """
    named = entities.select(F.col("entity_id").alias("target"), F.col("brand").alias("target_brand"), F.col("name").alias("target_name")).where("target_brand is not null")
    known = pairs.where("source <> target").join(entities.select(F.col("entity_id").alias("source")), "source", "left_semi").join(named, "target")
    moves = known.withColumnRenamed("source", "entity_id")
    moved = F.col("target").isNotNull()

    def rewritten(rows: DataFrame) -> DataFrame:
        joined = rows.drop("previous_entity_id").join(moves, "entity_id", "left")
        return joined.withColumn("previous_entity_id", F.when(moved, F.col("entity_id"))).withColumn("entity_id", F.coalesce("target", "entity_id"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("entity_id").alias("source")).agg(F.count("*").alias(name))

    log = known.select("source", "target")
    for rows, name in ((claims, "claims_moved"), (events, "events_moved"), (variants, "variants_moved")):
        log = log.join(counted(rows, name), "source", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    new_events = rewritten(events).withColumn("brand", F.coalesce("target_brand", "brand")).withColumn("product_name", F.coalesce("target_name", "product_name"))
    gone = known.select(F.col("source").alias("entity_id"), F.lit(True).alias("gone"))
    new_entities = entities.join(gone, "entity_id", "left").withColumn("is_retracted", F.col("is_retracted") | F.coalesce("gone", F.lit(False))).drop("gone")
    drop = ["target", "target_brand", "target_name"]
    return {"claims": rewritten(claims).drop(*drop), "events": new_events.drop(*drop), "variants": rewritten(variants).drop(*drop), "entities": new_entities, "log": log}


def backing_claims(events: DataFrame, links: DataFrame) -> DataFrame:
    """event_id, claim_id of the claims behind events, as originator or as folded evidence, each pair once."""
    return events.select("event_id").join(links.where("claim_id is not null"), "event_id").select("event_id", "claim_id").distinct()


def reassign_by_size(events: DataFrame, claims: DataFrame, links: DataFrame, entities: DataFrame, moves: DataFrame) -> dict[str, DataFrame]:
    """Moves a product's live events of one pair of sizes, and the claims behind them, to another product.

    moves: source, target, size_before, size_after, size_unit, one for each source and
    sizes; a null unit is an empty one.  A claim moves only if it was the source's.
    Returns events, claims and a log of the moved events with their numbers of claims.
    """
    unit = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = entities.select(F.col("entity_id").alias("target"), F.col("brand").alias("target_brand"), F.col("name").alias("target_name")).where("target_brand is not null")
    wanted = moves.where("source <> target").join(named, "target").select(F.col("source").alias("entity_id"), "size_before", "size_after", unit("size_unit").alias("u"), "target", "target_brand", "target_name")
    joined = events.drop("previous_entity_id").withColumn("u", unit("size_unit")).join(wanted, ["entity_id", "size_before", "size_after", "u"], "left")
    moved = F.col("target").isNotNull() & ~F.coalesce("is_retracted", F.lit(False))
    marked = joined.withColumn("moved", moved)
    new_events = marked.withColumns({"previous_entity_id": F.when(F.col("moved"), F.col("entity_id")), "entity_id": F.when(F.col("moved"), F.col("target")).otherwise(F.col("entity_id")), "brand": F.when(F.col("moved"), F.col("target_brand")).otherwise(F.col("brand")), "product_name": F.when(F.col("moved"), F.col("target_name")).otherwise(F.col("product_name"))})
    gone = marked.where("moved").select("event_id", F.col("entity_id").alias("source"), "target")
    behind = gone.join(links.where("claim_id is not null"), "event_id")
    of_claim = behind.groupBy("claim_id", F.col("source").alias("entity_id")).agg(F.min("target").alias("target"))
    new_claims = claims.drop("previous_entity_id").join(of_claim, ["claim_id", "entity_id"], "left").withColumns({"previous_entity_id": F.when(F.col("target").isNotNull(), F.col("entity_id")), "entity_id": F.coalesce("target", "entity_id")}).drop("target")
    log = gone.join(behind.groupBy("event_id").agg(F.countDistinct("claim_id").alias("claims")), "event_id", "left").select("event_id", F.col("source").alias("from_entity_id"), F.col("target").alias("to_entity_id"), F.coalesce("claims", F.lit(0)).alias("claims"))
    return {"events": new_events.drop("u", "target", "target_brand", "target_name", "moved"), "claims": new_claims, "log": log}


def set_field(entities: DataFrame, edits: DataFrame, field: str, edited_by: str) -> tuple[DataFrame, DataFrame]:
    """The products after edits of one field, and an audit row for each that changed.

    edits: entity_id, value, each product once; a value equal to the old one, null
    ones included, is no edit and leaves no trace.
    """
    if field not in ("brand", "name", "category", "manufacturer"):
        raise ValueError(f"unsupported field {field}")
    joined = entities.join(edits.select("entity_id", "value", F.lit(True).alias("edited")), "entity_id", "left")
    changed = F.col("edited").isNotNull() & ~F.col(field).eqNullSafe(F.col("value"))
    log = joined.where(changed).select("entity_id", F.lit(field).alias("field"), F.col(field).alias("old_value"), F.col("value").alias("new_value"), F.lit(edited_by).alias("edited_by"))
    return joined.withColumn(field, F.when(changed, F.col("value")).otherwise(F.col(field))).drop("value", "edited"), log


def merge_brands(entities: DataFrame, events: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Renames brands of products that aren't retracted, spelt exactly so, and of their events: products, events, audit rows.

    brands: source, target; a source has one target.
    """
    edits = entities.where("not is_retracted").join(brands.where("source <> target"), F.col("brand") == F.col("source")).select("entity_id", F.col("target").alias("value"))
    renamed, log = set_field(entities, edits, "brand", "brand_merge")
    new_events = events.join(log.select("entity_id", "new_value"), "entity_id", "left").withColumn("brand", F.coalesce("new_value", "brand")).drop("new_value")
    return renamed, new_events, log


def sync_attribution(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events with the brand and name of their product wherever these differ, and whether they did; events of no known product stay."""
    named = entities.select("entity_id", F.col("brand").alias("own_brand"), F.col("name").alias("own_name"))
    joined = events.join(named, "entity_id", "left")
    differs = F.coalesce((F.col("brand") != F.col("own_brand")) | (F.col("product_name") != F.col("own_name")), F.lit(False))
    out = joined.withColumn("synced", differs)
    return out.withColumns({"brand": F.when(differs, F.col("own_brand")).otherwise(F.col("brand")), "product_name": F.when(differs, F.col("own_name")).otherwise(F.col("product_name"))}).drop("own_brand", "own_name")


def without_live_events(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Products that aren't retracted and have no event that isn't."""
    return entities.where("not is_retracted").join(events.where("not is_retracted").select("entity_id"), "entity_id", "left_anti")


def retract_events(events: DataFrame, claims: DataFrame, links: DataFrame, gone: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Retracts events and sends the claims behind them back to pending, without product and variant.

    gone: event_id; events that are retracted already change nothing.  A claim behind
    several events goes back if one of them is retracted.
    """
    chosen = events.where("not is_retracted").join(gone.select("event_id").distinct(), "event_id", "left_semi").select("event_id")
    mark = chosen.withColumn("gone", F.lit(True))
    new_events = events.join(mark, "event_id", "left").withColumn("is_retracted", F.col("is_retracted") | F.coalesce("gone", F.lit(False))).withColumn("retraction_reason", F.when(F.col("gone"), F.lit(reason))).drop("gone")
    back = backing_claims(chosen, links).select("claim_id").distinct().withColumn("back", F.lit(True))
    joined = claims.join(back, "claim_id", "left")
    keep = F.col("back").isNull()
    new_claims = joined.withColumns({"status": F.when(keep, F.col("status")).otherwise(F.lit("pending")), "entity_id": F.when(keep, F.col("entity_id"))}).drop("back")
    return new_events, new_claims


def without_image(events: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """Live events none of whose claims has an image."""
    seen = backing_claims(events, links).join(claims.where("has_image").select("claim_id"), "claim_id", "left_semi").select("event_id")
    return events.where("not is_retracted").join(seen, "event_id", "left_anti")


def guarded_update(rows: DataFrame, where: Column, values: dict[str, Column], holds: Column) -> DataFrame:
    """Rows after an update of those that meet a condition; a row that would break ``holds`` (a condition on new values) stays as it was.

    A condition that is null isn't met, a rule that is null holds.
    """
    new = rows.withColumns({f"_new_{c}": F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})
    checked = new.select(*[F.col(f"_new_{c}").alias(c) if c in values else F.col(c) for c in rows.columns], F.struct(*[F.col(c) for c in values]).alias("_old"))
    ok = F.coalesce(holds, F.lit(True))
    return checked.withColumn("_ok", ok).select(*[F.when(F.col("_ok"), F.col(c)).otherwise(F.col("_old")[c]).alias(c) if c in values else F.col(c) for c in rows.columns])


def delete_unless(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows left after deleting those whose text doesn't match; a null text stays."""
    return rows.where(F.col(column).rlike(pattern) | F.col(column).isNull())


def find_or_create(rows: DataFrame, entities: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the id of the product of their brand and name, and the products that had to be made for them.

    Equal brand and name, exactly, are one product; of several the smallest id counts.
    ``key`` gives the id of a new one.
    """
    known = entities.groupBy("brand", "name").agg(F.min("entity_id").alias("known_id"))
    joined = rows.join(known, ["brand", "name"], "left").withColumn("entity_id", F.coalesce("known_id", key))
    new = joined.where("known_id is null").select("entity_id", "brand", "name").distinct()
    return joined.drop("known_id"), new


def seed_manufacturers(entities: DataFrame, seeds: DataFrame, force: bool = False) -> DataFrame:
    """Products with the manufacturer of the first seed that fits: the brand in any case, and the seed's category within the product's.

    seeds: place, brand, category (null fits all), manufacturer.  Products that have a
    manufacturer keep it; with ``force`` the last seed that fits wins over it.
    """
    fits = entities.select("entity_id", F.lower("brand").alias("b"), F.lower("category").alias("c"), "manufacturer").join(seeds.select("place", F.lower("brand").alias("b"), F.lower("category").alias("wanted"), F.col("manufacturer").alias("maker")), "b")
    fits = fits.where(F.col("wanted").isNull() | F.coalesce(F.col("c").contains(F.col("wanted")), F.lit(False)))
    pick = F.max_by("maker", "place") if force else F.min_by("maker", "place")
    chosen = (fits if force else fits.where("manufacturer is null")).groupBy("entity_id").agg(pick.alias("maker"))
    return entities.join(chosen, "entity_id", "left").withColumn("seeded", F.col("maker").isNotNull()).withColumn("manufacturer", F.coalesce("maker", "manufacturer")).drop("maker")


# Properties of a brand that lead to its maker, in the order of trial (manufacturer, owner, parent organisation), and the one of an item's class.
MAKER_PROPERTIES = ["P176", "P127", "P749"]
CLASS_PROPERTY = "P31"
# Classes of items that are no makers (people, states, funds, exchanges and what is too general).
DENIED_CLASSES = ["Q5", "Q6256", "Q3624078", "Q484652", "Q1052300", "Q15911314", "Q1330709", "Q4671277", "Q11691", "Q161726", "Q210167", "Q1799794", "Q34770", "Q1063239", "Q15265344", "Q43229"]


def chase_manufacturers(brands: DataFrame, triples: DataFrame, labels: DataFrame, deny: list[str] = DENIED_CLASSES) -> DataFrame:
    """The maker of each brand that landed triples lead to: brand, manufacturer.

    brands: brand, qid; triples: subject, property, object; labels: qid, label.  The
    properties are tried in their order; an object without a label, whose label is an
    address or a bare id, that is the brand itself or of a denied class doesn't count.  Of several of one property the first label counts.  Brands without any
    are left out.
    """
    order = F.array_position(F.array(*map(F.lit, MAKER_PROPERTIES)), F.col("property"))
    leads = triples.where(F.col("property").isin(MAKER_PROPERTIES)).select(F.col("subject").alias("qid"), order.alias("place"), F.col("object").alias("parent"))
    denied = triples.where((F.col("property") == CLASS_PROPERTY) & F.col("object").isin(deny)).select(F.col("subject").alias("parent"))
    named = labels.select(F.col("qid").alias("parent"), F.trim("label").alias("label")).where(r"label <> '' and not startswith(label, 'http') and not rlike(label, '^Q[0-9]+$')")
    # a brand leads to an item at most once for each property, however often the triple landed
    found = brands.select("brand", "qid").join(leads.distinct(), "qid").join(denied, "parent", "left_anti").join(named, "parent").where("parent <> qid")
    return found.groupBy("brand").agg(F.min(F.struct("place", "label")).alias("r")).select("brand", F.col("r.label").alias("manufacturer"))


def retract_cascade(products: DataFrame, events: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Retracts products that meet a condition, and their events."""
    gone = products.where(condition).select("entity_id", F.lit(True).alias("gone"))
    mark = lambda rows, was: rows.join(gone, "entity_id", "left").withColumn("is_retracted", was | F.coalesce("gone", F.lit(False))).drop("gone")
    return mark(products, F.lit(False)), mark(events, F.col("is_retracted"))


def status_changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """An audit row for each key whose status differs between two snapshots, missing ones included."""
    old, new = before.select(key, F.col(status).alias("old_status")), after.select(key, F.col(status).alias("new_status"))
    return old.join(new, key, "full").where(~F.col("old_status").eqNullSafe(F.col("new_status")))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule that is null holds."""
    checks = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return rows.select(key, F.explode(F.array_compact(checks)).alias("rule"))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are new, each key once: what an insert that ignores conflicts adds."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: incoming rows replace those of the same keys."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
