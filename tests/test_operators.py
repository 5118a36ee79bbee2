import os
from datetime import date, timedelta

from packwatch.operators import changes, ingredients, lifecycle, quality, series
from packwatch.sources import readers, sinks
from packwatch.streaming import ingest


def days(spark, sizes, key=1, ppu=None):
    rows = [(key, date(2024, 1, 1) + timedelta(k), float(s), float(ppu[k]) if ppu else 1.0) for k, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "upc long, day date, size double, ppu double")


def guarded(spark, sizes, ppu=None):
    return [(r.change_type, r.old_size, r.new_size) for r in changes.flap_guarded(days(spark, sizes, ppu=ppu), ["upc"], "day", "size", "ppu").collect()]


def test_guards_of_a_change(spark):
    assert guarded(spark, [10, 10, 10, 8, 8]) == [("size_decrease", 10.0, 8.0)]
    assert guarded(spark, [10, 10, 10, 8]) == [("size_decrease", 10.0, 8.0)]
    assert guarded(spark, [10, 10, 8, 8]) == []  # not stable before
    assert guarded(spark, [10, 10, 10, 8, 10, 10]) == []  # reverts
    assert guarded(spark, [8, 10, 10, 10, 8]) == []  # seen before
    assert guarded(spark, [10, 10, 10, 9.9, 9.9]) == []  # too small
    assert guarded(spark, [10, 10, 10, 9.9, 9.9], [1, 1, 1, 1.2, 1.2]) == [("price_hike", 10.0, 9.9)]


def test_variance_is_strict_and_latest_drop_is_not(spark):
    rows = days(spark, [100, 98, 98, 100.1])
    assert [(r.pct, r.direction) for r in changes.variance(rows, "upc", "day", "size").collect()] == [(2.14, "increase")]
    assert [(r.size_before, r.size) for r in changes.latest_drop(rows, "upc", "day", "size").collect()] == [(100.0, 98.0)]


def test_turnover_pairs_what_left_with_what_came(spark):
    rows = spark.createDataFrame([("b", 1, 2020, 10.0), ("b", 2, 2020, 5.0), ("b", 2, 2021, 5.0), ("b", 3, 2021, 9.0), ("b", 4, 2021, 2.0)], "brand string, upc long, release int, size double")
    got = changes.turnover(rows, ["brand"], "upc", "release", "size").collect()
    assert [(r.old_key, r.new_key, r.drop_pct) for r in got] == [(1, 3, 10.0)]


def test_runs_compare_with_the_last_kept_value(spark):
    rows = days(spark, [10, 10.005, 10.009, 10.02, 9])
    assert tuple(series.run_summary(rows, "upc", "day", "size", 0.01).first()) == (1, 3, 10.0, 9.0)


def test_year_over_year_goes_by_month(spark):
    rows = spark.createDataFrame([(date(2020, 1, 1), 100.0), (date(2020, 3, 1), 50.0), (date(2021, 1, 1), 110.0), (date(2021, 2, 1), 1.0)], "month date, value double")
    got = {r.month: r.yoy_pct for r in series.year_over_year(rows, "month", "value").collect()}
    assert got[date(2021, 1, 1)] == 10.0 and got[date(2021, 2, 1)] is None


def test_clusters_restart_after_their_window(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, d), d) for d in (1, 5, 9, 12)], "k long, day date, id int")
    got = quality.cluster_by_days(rows, ["k"], "day", "id", 7)
    assert sorted((r.id, r.anchor.day, r.is_canonical) for r in got.collect()) == [(1, 1, True), (5, 1, False), (9, 9, True), (12, 9, False)]


def test_fuzzy_duplicates_need_the_same_long_words(spark):
    rows = spark.createDataFrame([(1, "A", "Mint Chip Bar"), (2, "a", "mint-chip bar"), (3, "A", "Mega Mint Chip Bar"), (4, "B", "Mint Chip Bar")], "entity_id long, brand string, name string")
    assert [(r.entity_id, r.into) for r in quality.fuzzy_duplicates(rows).collect()] == [(2, 1)]


def test_reformulations(spark):
    lists = [
        (1, 1, ["SUGAR.", "SALT", "OIL"]), (1, 2, ["SUGAR", "SALT", "OIL"]),  # the same
        (2, 1, ["A1", "B1", "C1", "D1"]), (2, 2, []),  # no last list
        (3, 1, []), (3, 2, ["A1"]),
        (4, 1, ["A1", "B1", "C1", "D1", "E1", "F1"]), (4, 2, ["X1"]), (4, 3, ["NEW", "B1", "E1", "A  1.", "a1"]),  # A1 falls 4 places, C1 and D1 go
        (5, 1, ["A1"]),
        (6, 1, ["A1", "B1"]), (6, 2, ["B1", "A1"]),  # A1 falls one place
        (7, 1, ["A1"]), (7, 2, ["A1", "Z1"]),  # a new one behind alone
    ]
    got = ingredients.reformulations(spark.createDataFrame(lists, "upc long, release int, items array<string>"), "upc", "release", "items").collect()
    assert sorted((r.upc, r.significance, r.removed, r.new_at_top) for r in got) == [(4, 4 * 5 + 10 + 3, 2, ["NEW"]), (6, 0, 0, [])]


def test_findings_match_within_their_brand(spark):
    entities = spark.createDataFrame([(1, "Tropic", "Premium Orange Juice, no pulp"), (2, "tropic", "Tropic Orange Juice 1 l"), (3, "Other", "Orange Juice"), (4, "Tropic", "Juices"), (5, "Tropic", None), (6, "Oreo", "Oreo-Thins (Mint)"), (7, "Oreo", "Oreo-Thins [Mint]")], "entity_id long, brand string, name string")
    findings = spark.createDataFrame([("TROPIC", "orange juice"), ("Tropic", "Orange Juice"), ("Tropic", "juice"), ("oreo", "thins"), ("Oreo", "50%"), ("None", "juice"), ("Oreo", ""), (None, "juice")], "brand string, product string")
    got = quality.match_findings(findings, entities).collect()
    assert sorted((r.brand, r.product, r.entity_id) for r in got) == [("oreo", "thins", 6), ("tropic", "juice", 4), ("tropic", "orange juice", 2)]


def test_rewrites(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "entity_id long, x string")
    mapping = spark.createDataFrame([(2, 1)], "source long, target long")
    assert sorted(tuple(r) for r in lifecycle.merge_entities(rows, mapping).select("entity_id", "x", "previous_id").collect()) == [(1, "a", None), (1, "b", 2)]
    after = spark.createDataFrame([(1, "a"), (3, "c")], "entity_id long, x string")
    assert sorted((r.entity_id, r.old_status, r.new_status) for r in lifecycle.status_changes(rows, after, "entity_id", "x").collect()) == [(2, "b", None), (3, None, "c")]
    assert lifecycle.upsert(rows, after, ["entity_id"]).count() == 3
    assert [r.entity_id for r in lifecycle.append_new(rows, after, ["entity_id"]).collect()] == [3]


def test_readers(spark, tmp_path):
    (tmp_path / "posts.json").write_text('{"id":"a","title":"t","created_utc":2}\n{"id":"a","title":"u","created_utc":1}\n{"title":"none"}\n')
    assert [(r.id, r.title) for r in readers.posts(spark, str(tmp_path / "posts.json")).collect()] == [("a", "u")]
    (tmp_path / "s.csv").write_text("observation_date,value\n2020-01-01,.\n2020-02-01,1.5\n")
    assert [r.value for r in readers.series_csv(spark, str(tmp_path / "s.csv")).orderBy("observation_date").collect()] == [None, 1.5]
    assert readers.series_csv(spark, str(tmp_path / "s.csv"), since="2020-01-15").count() == 1
    (tmp_path / "p.json").write_text('{"id":1,"product_code":"c","price":2.5,"date":"2024-01-02","location":{"osm_name":"shop"}}\n{"id":2,"price":1}\n')
    assert [(r.store, str(r.date)) for r in readers.prices(spark, str(tmp_path / "p.json")).collect()] == [("shop", "2024-01-02")]
    (tmp_path / "f.csv").write_text("fdc_id,brand_owner,gtin_upc,ingredients,package_weight\n2,B,1,salt,6 oz\n1,A,1,sugar,7 oz\n")
    (tmp_path / "d.csv").write_text("fdc_id,description\n1,Bar\n")
    assert [(r.brand_owner, r.description) for r in readers.branded_foods(spark, str(tmp_path / "f.csv"), str(tmp_path / "d.csv")).collect()] == [("A", "Bar")]
    (tmp_path / "n.xml").write_text("<rss><channel><item><title>Smaller</title><link>http://a/b</link><pubDate>Mon, 06 Sep 2021 16:45:00 GMT</pubDate></item></channel></rss>")
    assert [(r.title, str(r.published)) for r in readers.news(spark, str(tmp_path / "n.xml")).collect()] == [("Smaller", "2021-09-06 16:45:00")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "A&B", "x<y", -10.0)], "event_id string, brand string, product_name string, size_delta_pct double")
    sinks.write_csv(rows, str(tmp_path / "c"))
    sinks.write_xml(rows, str(tmp_path / "x"))
    sinks.write_partitioned(rows, str(tmp_path / "p"), "brand")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_ingest_adds_only_new_keys(spark, tmp_path):
    source, target, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    for more in (rows, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string")):
        more.write.mode("append").parquet(source)
        ingest.ingest(ingest.new_files(spark, source, rows.schema), target, at, ["id"]).awaitTermination()
    assert sorted((r.id, r.x) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_ingest_keeps_old_rows_of_late_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, rows in enumerate([[(1, "2024-06-01"), (1, "2024-06-01")], [(2, "2024-06-02")], [(3, "2024-06-03"), (1, "2024-06-01")], [(4, "2020-01-01"), (5, "2024-06-03"), (2, "2024-06-02")]]):
        spark.createDataFrame(rows, "id long, ts string").coalesce(1).write.mode("append").parquet(source)
        for part in (tmp_path / "in").glob("*.parquet"):
            if not (tmp_path / part.name).exists():  # files are read in the order of their times
                os.utime(part, (1e9 + k, 1e9 + k))
                (tmp_path / part.name).touch()
    got = ingest.run_to_table(spark, source, str(tmp_path / "out"), ["id"], "ts", files_per_batch=1)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5]
