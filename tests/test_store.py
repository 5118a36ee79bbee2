"""Versioned tables, upserts and promotion as a stream."""

import itertools
import os
import random
from datetime import date, datetime, timedelta

import pytest

from packwatch.operators.promote import promote
from packwatch.streaming import ingest
from packwatch.streaming.promotion import RESULTS, Promotion
from packwatch.streaming.store import Store

ROWS = "k long, x string, at int"


def held(store, name="t"):
    frame = store.read(name)
    return {} if frame is None else {r.k: (r.x, r.at) for r in frame.collect()}


def land(store, spark, number, rows, commit=True):
    batch = store.begin("s", number)
    if batch:
        batch.upsert("t", ["k"], spark.createDataFrame(rows, ROWS), ["at"])
        if commit:
            batch.commit()
    return batch is not None


@pytest.mark.parametrize("part_rows", [1000, 3])
def test_newest_row_of_a_key_stays(spark, tmp_path, part_rows):
    rng, store, expected = random.Random(part_rows), Store(spark, str(tmp_path), part_rows), {}
    for number in range(5):
        rows = [(rng.randrange(25), f"{number}-{k}", rng.randrange(9)) for k in range(12)]
        rows = [(k, x, at) for n, (k, x, at) in enumerate(rows) if (k, at) not in {(a, c) for a, _, c in rows[:n]}]
        assert land(store, spark, number, rows + [(None, "no key", 1)])
        for k, x, at in rows:
            if k not in expected or at >= expected[k][1]:
                expected[k] = (x, at)
        assert held(store) == expected
    parts = store.manifest()["tables"]["t"]["parts"]
    assert len(parts) == 1 if part_rows == 1000 else len(parts) > 4


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path), part_rows=4)
    for number in range(3):
        land(store, spark, number, [(k, "a", number) for k in range(60)])
    before = {p["folder"] for p in store.manifest()["tables"]["t"]["parts"]}
    land(store, spark, 3, [(7, "b", 9)])
    after = {p["folder"] for p in store.manifest()["tables"]["t"]["parts"]}
    assert len(before) >= 8 and len(before - after) == 1 and held(store)[7] == ("b", 9) and len(held(store)) == 60


def test_replayed_and_broken_batches(spark, tmp_path):
    """A batch that was committed is passed over; of one that broke off before its manifest nothing is seen."""
    store = Store(spark, str(tmp_path))
    assert land(store, spark, 0, [(1, "a", 1)])
    assert not land(store, spark, 0, [(1, "again", 5), (2, "again", 5)])
    land(store, spark, 1, [(1, "lost", 7), (3, "lost", 7)], commit=False)
    assert held(store) == {1: ("a", 1)}
    assert land(store, spark, 1, [(3, "c", 2)])
    assert held(store) == {1: ("a", 1), 3: ("c", 2)}
    assert {r.k for r in store.read("t", version=1).collect()} == {1}
    store.vacuum()
    assert held(store) == {1: ("a", 1), 3: ("c", 2)} and len(os.listdir(tmp_path / "manifest")) <= 2
    late = store.begin("s", 2)
    land(store, spark, 2, [(4, "d", 1)])
    late.upsert("t", ["k"], spark.createDataFrame([(5, "e", 1)], ROWS), ["at"])
    with pytest.raises(RuntimeError, match="by another"):
        late.commit()


def test_rows_of_touched_keys_may_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    land(store, spark, 0, [(k, "a", 0) for k in range(4)])
    batch = store.begin("s", 1)
    keys = spark.createDataFrame([(1,), (2,), (9,)], "k long")
    assert sorted(r.k for r in batch.rows_of("t", keys).collect()) == [1, 2]
    batch.replace("t", ["k"], keys, spark.createDataFrame([(2, "b", 1)], ROWS))
    batch.commit()
    assert held(store) == {0: ("a", 0), 2: ("b", 1), 3: ("a", 0)}
    assert store.read("none") is None and store.begin("s", 2).rows_of("none", keys) is None
    everything = spark.createDataFrame([(k,) for k in range(9)], "k long")
    batch = store.begin("s", 2)
    batch.replace("t", ["k"], everything, spark.createDataFrame([], ROWS))
    batch.commit()
    assert held(store) == {}


def test_stream_of_late_files_ends_with_the_newest_rows(spark, tmp_path):
    source = tmp_path / "in"
    for n, rows in enumerate([[(1, "new", 5), (2, "b", 1)], [(1, "old", 2), (3, "c", 1)], [(2, "b2", 4)]]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(source))
        for part in source.glob("*.parquet"):
            if not (tmp_path / part.name).exists():  # files are read in the order of their times
                os.utime(part, (1e9 + n, 1e9 + n))
                (tmp_path / part.name).touch()
    got = ingest.run_to_table(spark, str(source), str(tmp_path / "out"), ["k"], "at", files_per_batch=1, part_rows=1)
    assert {r.k: (r.x, r.at) for r in got.collect()} == {1: ("new", 5), 2: ("b2", 4), 3: ("c", 1)}


CLAIMS = "claim_id long, raw_item_id string, extracted_at timestamp, brand string, product_name string, category string, old_size double, new_size double, old_unit string, new_unit string, old_price double, new_price double, retailer string, upc string, observed_date date, has_image boolean, entity_id string"


def made_up(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = lambda: rng.choice([10.0, 9.0, 8.0, 8.0, 0.0, 900.0, None])
        rows.append((k, f"r{k}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(30)), rng.choice(["acme", "ACME", "Bolt", "", None]), rng.choice(["Bar", "bar ", "Nut", None]), rng.choice(["a", None]), size(), size(), "oz", rng.choice(["g", None]), 1.0, 2.0, "shop", rng.choice(["1", "2", "3", None, None, None]), rng.choice([date(2024, 1, 2), None]), rng.random() < 0.3, rng.choice([None] * 9 + ["p1", "p2"])))
    return rows


def known(spark):
    entities = spark.createDataFrame([("p1", "Acme", "Bar"), ("p3", "Bolt", "Nut")], "entity_id string, brand string, name string")
    variants = spark.createDataFrame([("v1", "1"), ("v0", None)], "variant_id string, upc string")
    events = spark.createDataFrame([("e1", "p3", 10.0, 8.0, date(2023, 1, 1), False), ("e2", "p1", 9.0, 8.0, date(2023, 1, 1), True)], "event_id string, entity_id string, size_before double, size_after double, observed_date date, is_retracted boolean")
    raw = spark.createDataFrame([(f"r{k}", "reddit" if k % 2 else "news", date(2023, 5, 5), k % 5 == 0) for k in range(70)], "raw_item_id string, source_type string, source_date date, has_social_image boolean")
    return entities, variants, events, raw, "2024-06-01"


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("seed, cuts", [(1, [3]), (2, [2, 1])])
def test_streamed_promotion_equals_that_of_all_at_once(spark, tmp_path, seed, cuts):
    """Batches in any order, late claims first, with a batch run twice; the tables are those of all claims together."""
    claims, dims = made_up(seed), known(spark)
    late = sorted(claims, key=lambda r: r[2], reverse=True) if cuts == [3] else random.Random(seed).sample(claims, len(claims))
    sizes = [len(late) // (len(cuts) + 1)] * len(cuts)
    bounds = [0, *itertools.accumulate(sizes), len(late)]
    live = Promotion(Store(spark, str(tmp_path)), *dims)
    for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert live.step(spark.createDataFrame(late[a:b], CLAIMS), number)
    assert not live.step(spark.createDataFrame(late[:9], CLAIMS), 0)
    expected, got = promote(spark.createDataFrame(claims, CLAIMS), *dims), live.tables()
    assert set(got) == set(RESULTS) == set(expected)
    for name in RESULTS:
        assert rows_of(got[name]) == rows_of(expected[name]), name


def test_a_claim_that_comes_again_under_another_name(spark, tmp_path):
    """Its old name, event and variant are done again without it."""
    claims, dims = made_up(5, 12), known(spark)
    claims[3] = (3, "r4", datetime(2023, 1, 1), "Gone", "Thing", "a", 10.0, 9.0, "oz", "oz", 1.0, 2.0, "shop", "77", None, True, None)
    moved = [*claims]
    moved[3] = (3, "r4", datetime(2023, 1, 1), "Bolt", "Nut", "a", 10.0, 8.0, "oz", "oz", 1.0, 2.0, "shop", None, None, True, None)
    live = Promotion(Store(spark, str(tmp_path)), *dims)
    live.step(spark.createDataFrame(claims, CLAIMS), 0)
    live.step(spark.createDataFrame([moved[3]], CLAIMS), 1)
    expected, got = promote(spark.createDataFrame(moved, CLAIMS), *dims), live.tables()
    for name in RESULTS:
        assert rows_of(got[name]) == rows_of(expected[name]), name


def test_only_columns_of_wanted_results_are_kept(spark, tmp_path, monkeypatch):
    """Two results are those of all at once, with names too many to be sent to all tasks, and their state holds no column of the others."""
    monkeypatch.setattr("packwatch.streaming.promotion.FEW", 0)
    claims, dims, store = made_up(7, 30), known(spark), Store(spark, str(tmp_path))
    live = Promotion(store, *dims, ["events", "folded"])
    for number, rows in enumerate((claims[15:], claims[:15] + claims[20:22])):
        live.step(spark.createDataFrame(rows, CLAIMS), number)
    expected, got = promote(spark.createDataFrame(claims, CLAIMS), *dims), live.tables()
    for name in ("events", "folded"):
        assert rows_of(got[name]) == rows_of(expected[name]), name
    assert not {"retailer", "old_price", "raw_item_id", "upc"} & {c for name in ("claims", "by_event") for c in store.read(name).columns}
