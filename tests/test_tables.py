"""Table functions with several arguments, archives, and known brands."""

import random
import re
import zipfile

from pyspark.sql import functions as F

from packwatch.functions.tables import register
from packwatch.functions.text import KNOWN_BRANDS, known_brand
from packwatch.sources.paging import Pages, write_sorted
from packwatch.sources.zipped import ZippedCsv


def test_archive_gives_the_rows_of_its_plain_files(spark, tmp_path):
    rows = [[(k, f'n"{k}", a', k / 4 if k % 3 else None) for k in range(a, b)] for a, b in ((0, 300), (300, 301), (5, 5))]
    with zipfile.ZipFile(tmp_path / "landed.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for n, part in enumerate(rows):
            text = "size,fdc_id,extra,name\n" + "".join(f'{"" if s is None else s},{k},x,"{name.replace(chr(34), 2 * chr(34))}\nline"\n' for k, name, s in part)
            archive.writestr(f"data/food_{n}.csv", text)
        archive.writestr("data/other.txt", "fdc_id\n9\n")
        archive.writestr("nutrient.csv", "fdc_id,name\n1,salt\n")
    spark.dataSource.register(ZippedCsv)
    read = lambda members: spark.read.format("zipped_csv").schema("fdc_id long, name string, size double, none string").option("members", members).option("block", 1000).load(str(tmp_path / "landed.zip"))
    got = sorted((r.fdc_id, r.name, r.size, r.none) for r in read("food_*.csv").collect())
    assert got == sorted((k, f"{name}\nline", s, None) for part in rows for k, name, s in part)
    assert read("food_*.csv").rdd.getNumPartitions() == 3
    assert [tuple(r) for r in read("nutrient.csv").collect()] == [(1, "salt", None, None)] and read("nothing*").count() == 0


def test_table_functions_take_arguments(spark):
    observations = spark.createDataFrame([(1, "2024-01-01", 10.0, 1.0), (1, "2024-02-01", 8.0, 1.0), (1, "2024-03-01", 8.0, 1.0), (2, "2024-01-01", 5.0, 1.0), (2, "2024-01-09", 6.0, 1.0)], "upc long, observed_date string, size double, price double").withColumn("observed_date", F.to_date("observed_date"))
    figures = spark.createDataFrame([(1, 2020, 10.0, 5.0, 4.0, 100.0), (1, 2021, 9.0, 5.0, 5.0, 100.0), (1, 2022, 4.0, 5.0, 4.0, 101.0), (2, 2020, 0.5, 5.0, 4.0, 9.0), (2, 2021, 0.1, 4.9, 4.0, 12.0)], "upc long, y int, protein double, fiber double, sugar double, sodium double")
    items = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-14"), ("b", "2024-01-14"), ("b", "2024-01-15")], "source_type string, source_date string").withColumn("source_date", F.to_date("source_date"))
    register(observations, figures, items)
    call = lambda text: sorted(tuple(map(str, r)) for r in spark.sql(f"SELECT * FROM {text}").collect())
    assert call("detect_changes_for_product(1)") == [("1", "2024-02-01", "10.0", "8.0", "-20.0")] and call("detect_changes_for_product(9)") == []
    assert len(call("range(3) r, LATERAL detect_changes_for_product(r.id)")) == 2
    assert call("nutrition_skimpflation(2020, 2021)") == [("1", "10.0", "None", "25.0", "None", "35.0")]
    assert call("nutrition_skimpflation(2020, 2021, 36D)") == [] and call("nutrition_skimpflation(2020, 2022, 0D)") == [("1", "None", "None", "None", "None", "0.0")]
    assert call("pipeline_daily_stats(DATE '2024-01-14')") == [("a", "2024-01-01", "1"), ("a", "2024-01-14", "1"), ("b", "2024-01-14", "1")]
    assert call("pipeline_daily_stats(DATE '2024-01-15', 1)") == [("b", "2024-01-15", "1")]


def test_first_known_brand_equals_trying_one_after_the_other(spark):
    rng = random.Random(2)
    glue = [" ", "", "-", "x", "'", "s", "  ", "2"]
    texts = ["".join(rng.choice(KNOWN_BRANDS) + rng.choice(glue) + rng.choice(["", "the ", "ée"]) for _ in range(rng.randint(0, 4))) for _ in range(400)] + ["heinz ketchup", "lay's lays", "small", "all", "thomas' thomas", ""]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", known_brand(F.col("t"), KNOWN_BRANDS).alias("b")).collect()
    for r in got:
        assert r.b == next((b for b in KNOWN_BRANDS if re.search(rf"(?<![a-z]){re.escape(b)}(?![a-z])", texts[r.id])), None), texts[r.id]
    assert spark.range(1).select(known_brand(F.lit("coke"), []).alias("b")).first().b is None


def test_pages_open_the_files_that_hold_them(spark, tmp_path):
    keys = random.Random(1).sample(range(0, 3000, 3), 400)
    write_sorted(spark.createDataFrame([(k, f"x{k}") for k in keys] + [(None, "none")], "id long, x string").repartition(3), "id", str(tmp_path / "t"), rows_per_file=30)
    pages, keys = Pages(spark, str(tmp_path / "t"), "id"), sorted(keys)
    assert pages.index.count() >= 14
    for last, n in ((None, 20), (keys[0], 20), (keys[100], 5), (keys[101] + 1, 10), (keys[250], 70), (keys[-5], 20), (keys[-1], 20), (99999, 20), (-5, 3)):
        page = pages.after(last, n)
        expected = [k for k in keys if last is None or k > last][:n]
        assert [r.id for r in page.collect()] == expected
        assert len(page.inputFiles()) <= 2 + n // 25
    one = pages.after(pages.index.orderBy("first").first()["first"], 5)
    assert len(one.inputFiles()) == 1
    seen, last = [], None
    while page := pages.after(last, 90).collect():
        seen += [r.id for r in page]
        last = seen[-1]
    assert seen == keys
