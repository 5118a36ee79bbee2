"""Kinds and severities of changes between two observations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pct(before: Column, after: Column) -> Column:
    """Change in percent; null where the base is 0 or missing."""
    return F.try_divide(after - before, before) * 100


def classify_change(size_before: Column, size_after: Column, price_before: Column, price_after: Column) -> Column:
    """Deltas, type and severity on the 15 / 5 scale."""
    size_pct = pct(size_before, size_after)
    kind = (
        F.when(size_after > size_before, "upsizing")
        .when((size_after < size_before) & (price_after < price_before), "downsizing")
        .when(size_after < size_before, "shrinkflation")
        .when((size_after == size_before) & (price_after > price_before), "price_hike")
        .otherwise("downsizing")
    )
    severity = F.when(size_pct <= -15, "major").when(size_pct <= -5, "moderate").otherwise("minor")
    return F.struct(
        F.round(size_pct, 2).alias("size_delta_pct"),
        F.round(pct(price_before, price_after), 2).alias("price_delta_pct"),
        F.round(F.try_divide(price_before, size_before) + 1e-9, 4).alias("ppu_before"),
        F.round(F.try_divide(price_after, size_after) + 1e-9, 4).alias("ppu_after"),
        kind.alias("change_type"),
        severity.alias("severity"),
    )


def classify_published(size_pct: Column) -> Column:
    """Type and severity on the 20 / 5 scale, where a small rise is a restoration."""
    kind = F.when(size_pct.isNull() | (size_pct <= 0), "shrinkflation").when(size_pct > 5, "upsizing").otherwise("restoration")
    severity = F.when(size_pct.isNull(), "moderate").when(size_pct < -20, "major").when(size_pct < -5, "moderate").otherwise("minor")
    return F.struct(kind.alias("change_type"), severity.alias("severity"))


def classify_promoted(size_pct: Column) -> Column:
    """The same for a new event, where a rise of more than 5 percent is moderate."""
    found = classify_published(size_pct)
    return F.struct(found["change_type"].alias("change_type"), F.when(size_pct > 5, "moderate").otherwise(found["severity"]).alias("severity"))


def skimp_severity(score: Column) -> Column:
    """Severity of a nutrition score on the 25 / 12 scale."""
    return F.when(score >= 25, "major").when(score >= 12, "moderate").otherwise("minor")


def flag_action(kind: Column, severity: Column, events: Column, source_retracted: Column, target_retracted: Column) -> Column:
    """What triage does with an open quality flag."""
    return (
        F.when((kind == "fuzzy_brand_collision") & (source_retracted | target_retracted), "skip_already_done")
        .when(kind == "fuzzy_brand_collision", "merge")
        .when((kind == "sku_mashup") & (severity == "high"), "retract_entity")
        .when((kind == "size_outlier") & (severity == "high"), "retract_event")
        .when((kind == "short_brand") & (events == 0), "retract_entity")
        .otherwise("leave")
    )
