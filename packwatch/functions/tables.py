"""Table functions of a session: what takes arguments in SQL and returns rows.

``register`` makes them from the frames they read; they are temporary, can be joined
LATERAL with any table, and are planned as part of the query that calls them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Each nutrient with the least figure that counts, and whether it's bad when it falls or rises.
_GATES = {"protein": (1, "fall"), "fiber": (1, "fall"), "sugar": (1, "rise"), "sodium": (10, "rise")}


def _gate(name: str, floor: int, bad: str) -> str:
    """A change for the worse of 5 to 50 percent, in percent; else null."""
    near, far, sign = ("< e.{0} * 0.95", "> e.{0} * 0.5", -1) if bad == "fall" else ("> e.{0} * 1.05", "< e.{0} * 1.5", 1)
    return f"CASE WHEN e.{name} > {floor} AND l.{name} {near.format(name)} AND l.{name} {far.format(name)} THEN round((l.{name} - e.{name}) * {sign} / e.{name} * 100, 1) END AS {name}_{bad}"


def register(observations: DataFrame, figures: DataFrame, items: DataFrame, prefix: str = "pw_") -> None:
    """Registers the functions on the session of the frames, over temporary views with a prefix.

    observations: upc, observed_date, size, price.  figures: upc, y, protein, fiber,
    sugar, sodium.  items: source_type, source_date.

    ``detect_changes_for_product(product)``: observed_date, size_before, size_after,
    pct of each change of size of a product.  ``nutrition_skimpflation(early, late,
    min_score)``: products whose figures worsened between two releases, by 5 in all if
    not said otherwise.  ``pipeline_daily_stats(as_of, days)``: items by source and day
    of so many days up to a day, 14 if not said otherwise.
    """
    spark = observations.sparkSession
    for name, frame in (("observations", observations), ("figures", figures), ("items", items)):
        frame.createOrReplaceTempView(f"{prefix}{name}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION detect_changes_for_product(product BIGINT)
RETURNS TABLE(upc BIGINT, observed_date DATE, size_before DOUBLE, size_after DOUBLE, pct DOUBLE)
RETURN SELECT upc, observed_date, size_before, size, round((size - size_before) / nullif(size_before, 0) * 100, 2) FROM (
  SELECT upc, observed_date, CAST(size AS DOUBLE) AS size, CAST(lag(size) OVER (PARTITION BY upc ORDER BY observed_date) AS DOUBLE) AS size_before FROM {prefix}observations WHERE upc = product) WHERE size <> size_before""")
    names = [f"{n}_{bad}" for n, (_, bad) in _GATES.items()]
    score = " + ".join(f"coalesce({n}, 0)" for n in names)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION nutrition_skimpflation(early INT, late INT, min_score DOUBLE DEFAULT 5.0)
RETURNS TABLE(upc BIGINT, {", ".join(f"{n} DOUBLE" for n in names)}, skimp_score DOUBLE)
RETURN SELECT upc, {", ".join(names)}, round({score}, 1) FROM (SELECT e.upc, {", ".join(_gate(n, *g) for n, g in _GATES.items())} FROM {prefix}figures e JOIN {prefix}figures l ON l.upc = e.upc WHERE e.y = early AND l.y = late) WHERE round({score}, 1) >= min_score""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pipeline_daily_stats(as_of DATE, days INT DEFAULT 14)
RETURNS TABLE(source_type STRING, day DATE, n BIGINT)
RETURN SELECT source_type, source_date, count(*) FROM {prefix}items WHERE source_date > date_sub(as_of, days) AND source_date <= as_of GROUP BY source_type, source_date""")
