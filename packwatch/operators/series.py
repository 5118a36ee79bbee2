"""Time series: spines without gaps, year over year, collapsed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def month_spine(spark: SparkSession, last: str, months: int) -> DataFrame:
    """The ``months`` months up to that of ``last``."""
    end = F.trunc(F.lit(last).cast("date"), "month")
    return spark.range(1).select(F.explode(F.sequence(F.add_months(end, 1 - months), end, F.expr("interval 1 month"))).alias("month"))


def year_over_year(rows: DataFrame, month: str, value: str) -> DataFrame:
    """Each month with the value of the same month a year before; a missing month gives null, not its neighbour."""
    before = rows.select(F.add_months(month, 12).alias(month), F.col(value).alias("year_before"))
    out = rows.join(before, month, "left")
    return out.withColumn("yoy_pct", F.round((F.col(value) - F.col("year_before")) / F.col("year_before") * 100, 2))


def run_summary(rows: DataFrame, key: str, order: str, value: str, tolerance: float) -> DataFrame:
    """Per key how many values are left when runs collapse, and the first and last of them; the fold holds these three alone."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double"))
    state = F.struct(F.lit(0).cast("long").alias("steps"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("last"))

    def fold(kept, v):
        new = kept["last"].isNull() | (F.abs(v - kept["last"]) > tolerance)
        return F.struct((kept["steps"] + F.when(new, 1).otherwise(0)).alias("steps"), F.coalesce(kept["first"], v).alias("first"), F.when(new, v).otherwise(kept["last"]).alias("last"))

    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(sorted_.alias("values")).select(key, F.aggregate("values", state, fold).alias("r")).select(key, "r.*")


def spaced(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key: the first, the last and evenly spaced ones between; all where there are no more; of one only the first."""
    window = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(window.orderBy(order)) - 1, "_n": F.count("*").over(window)})
    if most < 2:
        return placed.where(F.col("_i") < max(most, 0)).drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(most - 1)
    nearest = F.floor(F.try_divide(F.col("_i"), step) + 0.5)  # of the places round(step * k) the one next to this row
    taken = (F.col("_n") <= most) | (F.floor(step * nearest + 0.5) == F.col("_i"))
    return placed.where(taken).drop("_i", "_n")
