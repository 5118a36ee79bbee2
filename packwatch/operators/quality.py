"""Data-quality flags on products, events and claims, as rows of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fuzzy_name_key, slugify
from ..session import kept
from .fuzzy import greedy_heads
from .search import holding


def flag(rows: DataFrame, kind: str, target: Column, severity: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("flag_kind"), target.cast("string").alias("target"), severity.alias("severity"), detail.cast("string").alias("detail"))


def short_brand(products: DataFrame, placeholders: list[str], least: int = 2) -> DataFrame:
    """Brands that are missing, a placeholder, or shorter than ``least``."""
    brand = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    return flag(products.where((F.length(brand) < least) | brand.isin(placeholders)), "short_brand", F.col("entity_id"), F.lit("med"), F.col("brand"))


def brand_collision(products: DataFrame) -> DataFrame:
    """Products of one slug of brand and name that are spelt differently; the smallest id is the target."""
    rows = products.withColumn("slug", F.concat_ws("|", slugify(F.col("brand")), slugify(F.col("name"))))
    groups = rows.groupBy("slug").agg(F.countDistinct("brand", "name").alias("spellings"), F.min("entity_id").alias("into"), F.count("*").alias("n")).where("spellings > 1 or n > 1")
    return flag(rows.join(groups, "slug").where(F.col("entity_id") != F.col("into")), "fuzzy_brand_collision", F.col("entity_id"), F.lit("low"), F.col("into"))


def size_outlier(events: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Events whose size ratio leaves low..high; severe below 0.1 or above 5."""
    ratio = F.try_divide(F.col("size_after"), F.col("size_before"))
    severe = F.when((ratio < 0.1) | (ratio > 5), "high").otherwise("med")
    return flag(events.where((ratio < low) | (ratio > high)), "size_outlier", F.col("event_id"), severe, F.round(ratio, 3))


def sku_mashup(events: DataFrame, least: float = 3, severe: float = 10) -> DataFrame:
    """Products whose events spread over sizes by a factor of ``least`` or more."""
    spread = events.groupBy("entity_id").agg(F.max(F.greatest("size_before", "size_after")).alias("most"), F.min(F.least("size_before", "size_after")).alias("least"))
    ratio = F.try_divide(F.col("most"), F.col("least"))
    return flag(spread.where(ratio >= least), "sku_mashup", F.col("entity_id"), F.when(ratio >= severe, "high").otherwise("med"), F.round(ratio, 2))


def mixed_units(claims: DataFrame) -> DataFrame:
    """Products with claims in more than one unit; the detail is the commonest."""
    counts = claims.groupBy("entity_id", "size_unit").agg(F.count("*").alias("n"))
    units = counts.groupBy("entity_id").agg(F.count("*").alias("units"), F.min(F.struct((-F.col("n")).alias("minus"), "size_unit")).alias("first")).where("units > 1")
    return flag(units, "mixed_units", F.col("entity_id"), F.lit("low"), F.col("first.size_unit"))


def stuck(claims: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Claims that have waited for more than ``days``."""
    waiting = claims.where((F.col("status") == "pending") & (F.datediff(F.lit(as_of).cast("date"), "extracted_date") > days))
    return flag(waiting, "stuck_approved_claim", F.col("claim_id"), F.lit("med"), F.datediff(F.lit(as_of).cast("date"), "extracted_date"))


def raise_flags(new: DataFrame, open_flags: DataFrame) -> DataFrame:
    """New flags without those already open for their kind and target, each once."""
    return new.dropDuplicates(["flag_kind", "target"]).join(open_flags.select("flag_kind", "target"), ["flag_kind", "target"], "left_anti")


def fold_claims(claims: DataFrame) -> DataFrame:
    """One event for each product and pair of sizes: the earliest claim makes it, the rest are evidence."""
    return claims.groupBy("entity_id", "old_size", "new_size").agg(
        F.min(F.struct("extracted_date", "claim_id")).alias("first"), F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("source_type")).alias("sources"),
    ).select("entity_id", "old_size", "new_size", F.col("first.claim_id").alias("origin_claim"), F.col("first.extracted_date").alias("observed_date"), "evidence_count", F.array_join("sources", ",").alias("sources"))


def cluster_by_days(events: DataFrame, keys: list[str], date: str, order: str, days: int) -> DataFrame:
    """Numbers, per key, clusters that end ``days`` after their first event.

    A cluster's anchor depends on the one before, so the distinct days of a key are
    read in order once; a task holds one row at a time, however long a key's history
    is.  Events without a date make a cluster of their own for each key.
    """
    import pyarrow as pa

    kind = events.schema[date].dataType.simpleString()
    found = events.select(*keys, date).distinct().repartition(*keys).sortWithinPartitions(*keys, date)
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keys) + f", `{date}` {kind}, anchor {kind}"

    def anchored(batches):
        last, anchor = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            anchors = []
            for *key, day in zip(*columns, batch.column(date).to_pylist()):
                if key != last or anchor is None or day is None or (day - anchor).days > days:
                    last, anchor = key, day
                anchors.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anchors, batch.column(date).type)], [*keys, date, "anchor"])

    pairs = found.mapInArrow(anchored, schema)
    same = lambda c: F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}"))
    joined = events.alias("e").join(pairs.alias("p"), reduce(lambda x, y: x & y, [same(c) for c in [*keys, date]])).select("e.*", "p.anchor")
    return joined.withColumn("is_canonical", F.row_number().over(Window.partitionBy(*keys, "anchor").orderBy(date, order)) == 1)


def merge_repeats(events: DataFrame, keys: list[str], date: str, order: str) -> DataFrame:
    """One event for each key: the earliest, with the evidence of all.

    Evidence is the larger of the entries of all and the sum of their counts, a
    missing count being one.  Events with a null in a key are left out.
    """
    rows = events.dropna(subset=keys)
    at = F.struct(date, order)
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(date, order, F.coalesce("evidence", F.array().cast("array<string>")).alias("own")))), lambda x: x["own"]))
    out = rows.groupBy(*keys).agg(F.min(at).alias("first"), F.count("*").alias("merged"), F.sum(F.coalesce("evidence_count", F.lit(1))).alias("counts"), F.sum(F.coalesce(F.size("evidence"), F.lit(0))).alias("entries"), entries.alias("evidence"))
    return out.select(*keys, F.col(f"first.{order}").alias(order), F.col(f"first.{date}").alias(date), "merged", F.greatest("entries", "counts").alias("evidence_count"), "evidence")


def strict_duplicates(products: DataFrame) -> DataFrame:
    """Products that agree in brand and in the letters and digits of their names, with the smallest id as target."""
    key = products.withColumn("key", slugify(F.col("name"))).withColumn("b", F.lower(F.trim("brand"))).where("key <> ''")
    target = key.groupBy("b", "key").agg(F.min("entity_id").alias("into"), F.count("*").alias("n")).where("n > 1")
    return key.join(target, ["b", "key"]).where(F.col("entity_id") != F.col("into")).select("entity_id", "into", F.col("n").alias("group_size"))


def same_change_groups(events: DataFrame) -> DataFrame:
    """Two or more products of one brand with a live event of the same sizes; a product is in a group for each pair of its sizes.

    The target is the product with the most live events, then the smallest id;
    names_match says whether two of them agree in the words of their names.
    """
    live = events.where("not is_retracted and size_before is not null and size_after is not null")
    counts = live.groupBy("entity_id").agg(F.count("*").alias("events"))
    members = live.select("brand", "size_before", "size_after", "entity_id", fuzzy_name_key(F.col("product_name")).alias("key")).distinct().join(counts, "entity_id")
    groups = members.groupBy("brand", "size_before", "size_after").agg(F.countDistinct("entity_id").alias("products"), F.min_by("entity_id", F.struct((-F.col("events")).alias("minus"), "entity_id")).alias("target"), (F.countDistinct("key") < F.count("*")).alias("names_match"))
    return groups.where("products >= 2")


def fuzzy_duplicates(products: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Products of one brand whose names are alike and differ in no word of over two letters, with the first such product.

    Names are compared once each: equal names, and names with the same long words,
    meet in one group (no other pair passes the word rule).
    """
    lower = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 2))), " ")
    names = products.groupBy(F.lower(F.trim("brand")).alias("b"), words.alias("words"), lower.alias("n")).agg(F.min("entity_id").alias("first"))
    names = kept(names.where("b is not null"))
    several = names.groupBy("b", "words").agg(F.count("*").alias("k")).where("k > 1")  # of a group of one nothing is compared
    heads = greedy_heads(names.join(several.drop("k"), ["b", "words"]), ["b", "words"], "first", "n", threshold)
    into = names.join(heads, ["b", "words", "first"], "left").select("b", "n", F.coalesce("head", "first").alias("into"))
    return products.select("entity_id", F.lower(F.trim("brand")).alias("b"), lower.alias("n")).join(into, ["b", "n"]).where(F.col("entity_id") != F.col("into")).select("entity_id", "into")


def match_findings(findings: DataFrame, entities: DataFrame, most: int = 64) -> DataFrame:
    """For each reported brand and product, in small letters, the shortest name of that brand that holds the product.

    findings: brand, product (of which the first ``most`` characters count);
    entities: entity_id, brand, name.  Names are found by the rarest run of three
    characters of a product within its brand.
    """
    wanted = findings.select(F.lower("brand").alias("brand"), F.substring("product", 1, most).alias("wanted")).where("brand <> ''")
    known = entities.select(F.lower("brand").alias("brand"), F.col("entity_id").alias("id"), F.col("name").alias("text"))
    best = holding(wanted, known, ["brand"]).groupBy("brand", "wanted").agg(F.min(F.struct(F.length("text").alias("l"), "id", "text")).alias("r"))
    return best.select("brand", F.col("wanted").alias("product"), F.col("r.id").alias("entity_id"), F.col("r.text").alias("name"))


def passes_audit(units: list[str], brand: float = 0.85, size: float = 0.85, name: float = 0.80) -> Column:
    """Why a claim would not have been approved by itself; null if it would: picture, unit, and three scores."""
    low = lambda c, floor: F.coalesce(F.col(f"confidence_{c}") < floor, F.lit(True))
    return (
        F.when(~F.coalesce("has_image", F.lit(False)), "no image").when(~F.lower(F.trim(F.coalesce("size_unit", F.lit("")))).isin(units), "unit")
        .when(low("brand", brand), "brand score").when(low("size", size), "size score").when(low("name", name), "name score")
    )


def decline_reason() -> Column:
    """Why a pending claim is declined, by its source; null if it isn't."""
    has = lambda *names: reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    article = F.col("source_type").isin("news", "gdelt")
    return (
        F.when(article & (F.coalesce("brand", F.lit("")) == ""), F.concat("source_type", F.lit(": no brand")))
        .when(article & ~has("old_size", "new_size") & ~has("old_price", "new_price"), F.concat("source_type", F.lit(": no size or price change")))
        .when((F.col("source_type") == "reddit") & F.col("image").isNull(), "reddit: no image")
        .when((F.col("source_type") == "openfoodfacts") & ~has("old_size", "new_size"), "openfoodfacts: missing before/after size")
        .when((F.col("source_type") == "kroger_change") & F.coalesce(F.col("extractor_version").rlike("^kroger-change-v(0|1$)"), F.lit(False)), "kroger_change: legacy analyzer")
    )


def claim_groups(claims: DataFrame) -> DataFrame:
    """Claims by brand, name key and bucket of sizes: number, clusters by product ("id:n", the largest first), sources ("source:n"), range of confidence.

    Counted in two steps, so a group's lists hold its products and sources, not its claims.
    """
    keys = ["brand", "name_key", "bucket"]
    total = claims.groupBy(*keys).agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    label = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))

    def listed(column: str, none: str, name: str) -> DataFrame:
        counts = claims.groupBy(*keys, label(column, none).alias("x")).agg(F.count("*").alias("k"))
        items = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("minus"), "x", "k")))
        return counts.groupBy(*keys).agg(items.alias("i")).select(*keys, F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["x"], x["k"].cast("string"))), ",").alias(name))

    return total.join(listed("entity_id", "unmatched", "clusters"), keys).join(listed("source_type", "unknown", "sources"), keys)


def profile_outliers(events: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Events whose ratio of sizes leaves low..high, those with the most evidence first."""
    ratio = F.col("size_after") / F.col("size_before")
    rows = events.where("size_before > 0 and size_after > 0").withColumn("r", ratio).where(~F.col("r").between(low, high))
    return rows.withColumn("ratio", F.round("r", 4)).drop("r").orderBy(F.desc_nulls_last("evidence_count"), "ratio")


def profile_units(events: DataFrame) -> DataFrame:
    """Products with events in several units: the commonest unit, and the others."""
    rows = events.withColumn("unit", F.lower(F.trim(F.coalesce("size_unit", F.lit(""))))).where("unit <> '' and entity_id is not null")
    counts = rows.groupBy("entity_id", "unit").agg(F.count("*").alias("k"))
    units = counts.groupBy("entity_id").agg(F.sum("k").alias("event_count"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("minus"), "unit", "k"))).alias("u")).where(F.size("u") > 1)
    names = lambda a, f: F.array_join(F.transform(a, f), ", ")
    return units.select(
        "entity_id", "event_count", F.size("u").alias("unit_variants"), names("u", lambda x: F.concat_ws("=", x["unit"], x["k"].cast("string"))).alias("units_breakdown"), F.col("u")[0]["unit"].alias("majority_unit"),
        F.col("u")[0]["k"].alias("majority_count"), names(F.slice("u", 2, 1 << 20), lambda x: x["unit"]).alias("minority_units"),
    ).orderBy(F.desc("event_count"), "entity_id")


def profile_sizes(events: DataFrame, wide: float = 3.0, extreme: float = 10.0) -> DataFrame:
    """Products whose events start from very different sizes: likely several packs in one."""
    rows = events.where("size_before > 0 and entity_id is not null").groupBy("entity_id").agg(F.min("size_before").alias("min_size"), F.max("size_before").alias("max_size"), F.count("*").alias("event_count")).where("event_count >= 2")
    spread = F.col("max_size") / F.col("min_size")
    rows = rows.withColumn("s", spread).where(F.col("s") >= wide)
    return rows.select("entity_id", "min_size", "max_size", F.round("s", 2).alias("spread_ratio"), "event_count", F.when(F.col("s") >= extreme, "extreme").otherwise("wide").alias("severity")).orderBy(F.desc("spread_ratio"), "entity_id")


def profile_duplicates(entities: DataFrame) -> DataFrame:
    """Products of one brand and one slug of the name, each but the one with the most events paired with that one."""
    rows = entities.where("brand <> '' and name <> ''").select("entity_id", "name", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.lower(F.trim("brand")).alias("group_brand"), slugify(F.col("name")).alias("group_slug")).where("group_slug <> ''")
    best = rows.groupBy("group_brand", "group_slug").agg(F.min(F.struct((-F.col("event_count")).alias("minus"), "entity_id", "name", "event_count")).alias("t"), F.count("*").alias("group_size")).where("group_size > 1")
    out = rows.join(best, ["group_brand", "group_slug"]).where(F.col("entity_id") != F.col("t.entity_id"))
    return out.select(
        "group_brand", "group_slug", F.col("entity_id").alias("source_id"), F.col("name").alias("source_name"), F.col("event_count").alias("source_events"), F.col("t.entity_id").alias("target_id"), F.col("t.name").alias("target_name"),
        F.col("t.event_count").alias("target_events"), "group_size",
    ).orderBy(F.desc("group_size"), F.desc("target_events"), "source_id")
