"""Changes in ordered ingredient lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def normalize_ingredient(item: Column) -> Column:
    """Capitals, no punctuation, single spaces: "SUGAR." and "Sugar" are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.trim(item)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def _points(ends: DataFrame, key: str, top: int, *keep: str) -> DataFrame:
    """Each of the first ``top`` ingredients of old with its place, its place in new (0 if it is gone) and its points."""
    rows = ends.select(key, "new", *keep, F.posexplode(F.slice("old", 1, top)).alias("at", "item"), F.slice("old", 1, top).alias("first"))
    rows = rows.where(F.array_position("first", F.col("item")) == F.col("at") + 1)
    rows = rows.select(key, *keep, (F.col("at") + 1).alias("place"), F.array_position("new", F.col("item")).alias("now"))
    fall = F.col("now") - F.col("place")
    points = F.when(F.col("now") == 0, F.when(F.col("place") <= 3, 10).otherwise(3)).when(fall >= 2, F.when(F.col("place") <= 3, fall * 5).otherwise(fall)).otherwise(0)
    return rows.withColumn("points", points)


def _sums() -> tuple[Column, Column]:
    return F.sum("points").cast("long").alias("significance"), F.sum((F.col("now") == 0).cast("int")).cast("long").alias("removed")


def reformulations(lists: DataFrame, key: str, release: str, items: str, top: int = 5) -> DataFrame:
    """Significance of what became of the first ``top`` ingredients between a key's first and last release.

    A removed one counts 10 among the first three, else 3; one that fell by two
    places or more counts its fall, five times among the first three.  Items are
    compared normalised.  Keys are left out with one release, with an empty first or
    last list, or if none of the ingredients fell or was removed.  new_at_top has the
    first three of the last list that aren't among the first ten of the first.
    """
    ends = lists.groupBy(key).agg(F.min_by(items, release).alias("old"), F.max_by(items, release).alias("new"), F.min(release).alias("a"), F.max(release).alias("z"))
    ends = ends.where((F.col("a") < F.col("z")) & (F.size("old") > 0) & (F.size("new") > 0)).select(key, *[F.transform(x, normalize_ingredient).alias(x) for x in ("old", "new")])
    new_at_top = F.filter(F.slice("new", 1, 3), lambda x: ~F.array_contains(F.slice("old", 1, 10), x))
    rows = _points(ends.withColumn("new_at_top", new_at_top), key, top, "new_at_top")
    moved = F.max((F.col("now") == 0) | (F.col("now") > F.col("place"))).alias("moved")
    return rows.groupBy(key).agg(*_sums(), F.any_value("new_at_top").alias("new_at_top"), moved).where("moved").drop("moved")
