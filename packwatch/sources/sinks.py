"""Writers: feeds, reports and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _plain(number: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def _or(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(other))


def headline(brand: Column, name: Column) -> Column:
    """Brand and product, the brand once where the product's name begins with it."""
    brand, name = _or(brand, "Unknown brand"), _or(name, "product")
    leads = lambda text: F.startswith(F.lower(text), F.lower(brand))
    rest = F.trim(F.substr(name, F.length(brand) + 1))
    name = F.when(leads(name) & (rest != ""), rest).otherwise(name)
    return F.when(leads(name), name).otherwise(F.concat_ws(" ", brand, name))


def rss_items(events: DataFrame, site: str, limit: int | None = 50, name: str = "packwatch") -> DataFrame:
    """Feed items of live shrinks of known brands, the last published first (never published ones last, then by id).

    events: event_id, entity_id, brand, product_name, size_before, size_after,
    size_unit, size_delta_pct, evidence_count, observed_date, published_at,
    change_type, is_retracted.  A missing size makes the title say "documented"; the
    date is that of publishing, else of observation, else left out.
    """
    rows = events.where("not is_retracted and change_type = 'shrinkflation' and brand is not null").orderBy(F.desc_nulls_last("published_at"), "event_id")
    rows = rows.limit(limit) if limit else rows
    unit = F.trim(F.coalesce("size_unit", F.lit("")))
    sizes = F.concat(F.lit(" shrank "), _plain(F.col("size_before")), unit, F.lit(" → "), _plain(F.col("size_after")), unit)
    title = F.concat(headline(F.col("brand"), F.col("product_name")), F.coalesce(sizes, F.lit(" documented")))
    brand_page = F.concat(F.lit(f"{site}/brands/"), F.replace(F.url_encode(F.lower("brand")), F.lit("+"), F.lit("%20")))
    link = F.coalesce(F.concat(F.lit(f"{site}/products/"), F.col("entity_id").cast("string")), F.when(F.col("brand") != "", brand_page), F.lit(site))
    said = F.concat_ws(" · ", F.when(F.col("size_delta_pct").isNotNull(), F.concat(F.format_string("%.1f", F.abs("size_delta_pct")), F.lit("% smaller"))), F.when(F.col("evidence_count") > 1, F.concat(F.col("evidence_count").cast("string"), F.lit(" sources"))), F.concat(F.lit("observed "), F.col("observed_date").cast("string")))
    said = F.coalesce(F.nullif(said, F.lit("")), F.lit(f"Shrinkflation event documented by {name}."))
    day = F.date_format(F.coalesce(F.col("published_at").cast("timestamp"), F.col("observed_date").cast("timestamp")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    dated = F.coalesce(F.concat(F.lit("<pubDate>"), day, F.lit("</pubDate>")), F.lit(""))
    return rows.select(F.concat(F.lit("<item><title>"), _escape(title), F.lit("</title><link>"), _escape(link), F.lit('</link><guid isPermaLink="false">'), _escape(F.concat(F.lit(f"{site}/events/"), F.col("event_id").cast("string"))), F.lit("</guid>"), dated, F.lit("<description>"), _escape(said), F.lit("</description></item>")).alias("value"))


def markdown_table(rows: DataFrame) -> DataFrame:
    """Lines of a markdown table, in no order."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def write_xml(rows: DataFrame, path: str, row: str = "item", root: str = "items") -> None:
    rows.write.option("rowTag", row).option("rootTag", root).mode("overwrite").format("xml").save(path)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Parquet by a low-cardinality column; rows are dealt by it and a salt, so a frequent value has many files."""
    rows.repartition(by, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(path)
