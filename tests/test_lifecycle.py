"""Merges, edits, sweeps, promotion and readers, case by case."""

import json
from datetime import date, datetime

import pytest

from packwatch.operators import lifecycle as L, promote as P, quality as Q, series
from packwatch.sources import readers
from pyspark.sql import functions as F


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture
def tables(spark):
    frame = spark.createDataFrame
    return {
        "entities": frame([(1, "A", "One", None, False), (2, "A", "One!", "x", False), (3, "B", "Three", "x", True), (4, None, "Four", None, False)], "entity_id long, brand string, name string, category string, is_retracted boolean"),
        "events": frame([("e1", 1, "A", "One", 10.0, 8.0, "oz", False), ("e2", 2, "A", "One!", 10.0, 8.0, None, False), ("e3", 2, "A", "One!", 10.0, 8.0, "", True), ("e4", 2, "a", "One!", 9.0, 8.0, "oz", False)], "event_id string, entity_id long, brand string, product_name string, size_before double, size_after double, size_unit string, is_retracted boolean"),
        "claims": frame([(1, 1, "matched", True), (2, 2, "matched", False), (3, 2, "matched", None), (4, None, "pending", False)], "claim_id long, entity_id long, status string, has_image boolean"),
        "variants": frame([("v1", 2), ("v2", 3)], "variant_id string, entity_id long"),
        "links": frame([("e1", 1), ("e2", 2), ("e2", 2), ("e2", 1), ("e3", 3), ("e4", None)], "event_id string, claim_id long"),
    }


def test_merges_move_everything_and_log_it(spark, tables):
    pairs = spark.createDataFrame([(2, 1), (9, 1), (3, 3), (3, 4)], "source long, target long")  # unknown, itself, to one without a brand
    out = L.merge_all(tables["claims"], tables["events"], tables["variants"], tables["entities"], pairs)
    assert rows_of(out["log"], "source", "target", "claims_moved", "events_moved", "variants_moved") == [(2, 1, 2, 3, 1)]
    assert rows_of(out["events"], "event_id", "entity_id", "previous_entity_id", "brand", "product_name") == [("e1", 1, None, "A", "One"), *[(e, 1, 2, "A", "One") for e in ("e2", "e3", "e4")]]
    assert rows_of(out["claims"], "claim_id", "entity_id", "previous_entity_id") == [(1, 1, None), (2, 1, 2), (3, 1, 2), (4, None, None)]
    assert rows_of(out["variants"], "variant_id", "entity_id") == [("v1", 1), ("v2", 3)]
    assert rows_of(out["entities"], "entity_id", "is_retracted") == [(1, False), (2, True), (3, True), (4, False)]


def test_events_of_one_size_are_reassigned_with_their_claims(spark, tables):
    moves = spark.createDataFrame([(2, 1, 10.0, 8.0, "")], "source long, target long, size_before double, size_after double, size_unit string")
    out = L.reassign_by_size(tables["events"], tables["claims"], tables["links"], tables["entities"], moves)
    assert rows_of(out["events"], "event_id", "entity_id", "previous_entity_id", "product_name") == [("e1", 1, None, "One"), ("e2", 1, 2, "One"), ("e3", 2, None, "One!"), ("e4", 2, None, "One!")]
    assert rows_of(out["claims"], "claim_id", "entity_id", "previous_entity_id") == [(1, 1, None), (2, 1, 2), (3, 2, None), (4, None, None)]
    assert rows_of(out["log"], "event_id", "from_entity_id", "to_entity_id", "claims") == [("e2", 2, 1, 2)]


def test_edits_brands_and_attribution(spark, tables):
    edits = spark.createDataFrame([(1, None), (2, "y"), (3, "x"), (8, "z")], "entity_id long, value string")
    new, log = L.set_field(tables["entities"], edits, "category", "me")
    assert rows_of(log, "entity_id", "old_value", "new_value", "edited_by") == [(2, "x", "y", "me")] and rows_of(new, "entity_id", "category") == [(1, None), (2, "y"), (3, "x"), (4, None)]
    with pytest.raises(ValueError):
        L.set_field(tables["entities"], edits, "entity_id", "me")
    entities, events, log = L.merge_brands(tables["entities"], tables["events"], spark.createDataFrame([("A", "Z"), ("B", "Z"), ("Z", "Z")], "source string, target string"))
    assert rows_of(entities, "entity_id", "brand") == [(1, "Z"), (2, "Z"), (3, "B"), (4, None)] and {r.brand for r in events.collect()} == {"Z"} and log.count() == 2
    assert rows_of(L.sync_attribution(tables["events"], tables["entities"]), "event_id", "brand", "synced") == [("e1", "A", False), ("e2", "A", False), ("e3", "A", False), ("e4", "A", True)]
    assert rows_of(L.without_live_events(tables["entities"], tables["events"].where("event_id <> 'e1'")), "entity_id") == [(1,), (4,)]


def test_sweeps_send_claims_back(spark, tables):
    events, claims = L.retract_events(tables["events"], tables["claims"], tables["links"], spark.createDataFrame([("e2",), ("e3",), ("e9",)], "event_id string"), "why")
    assert rows_of(events, "event_id", "is_retracted", "retraction_reason") == [("e1", False, None), ("e2", True, "why"), ("e3", True, None), ("e4", False, None)]
    assert rows_of(claims, "claim_id", "status", "entity_id") == [(1, "pending", None), (2, "pending", None), (3, "matched", 2), (4, "pending", None)]
    assert rows_of(L.without_image(tables["events"], tables["links"], tables["claims"]), "event_id") == [("e4",)]


def test_guarded_updates_deletes_and_seeds(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, None)], "k long, x double")
    assert rows_of(L.guarded_update(rows, F.col("k") < 3, {"x": F.col("x") * 2}, F.col("x") < 60), "k", "x") == [(1, 20.0), (2, 50.0), (3, None)]
    texts = spark.createDataFrame([("a1",), ("b",), (None,)], "t string")
    assert rows_of(L.delete_unless(texts, "t", "^a"), "t") == [("a1",), (None,)]
    products = spark.createDataFrame([(1, "Dove", "Soap bars", None), (2, "DOVE", "Chocolate", None), (3, "Dove", None, "Old")], "entity_id long, brand string, category string, manufacturer string")
    seeds = spark.createDataFrame([(1, "dove", "chocolate", "Mars"), (2, "Dove", None, "Unilever")], "place int, brand string, category string, manufacturer string")
    assert rows_of(L.seed_manufacturers(products, seeds), "entity_id", "manufacturer", "seeded") == [(1, "Unilever", True), (2, "Mars", True), (3, "Old", False)]
    assert rows_of(L.seed_manufacturers(products, seeds, force=True), "entity_id", "manufacturer") == [(1, "Unilever"), (2, "Unilever"), (3, "Unilever")]


@pytest.mark.parametrize("old,new,expected", [(10.0, 8.0, True), (1.0, 900.0, False), (100.0, 1.0, False), (100.0, 5.0, True), (100.0, 500.0, True), (0.0, 5.0, False), (None, 5.0, True), (5.0, None, True), (None, None, True)])
def test_ratio_of_sizes(spark, old, new, expected):
    assert spark.createDataFrame([(old, new)], "a double, b double").select(P.sane_ratio(F.col("a"), F.col("b"))).first()[0] is expected


@pytest.mark.parametrize("brand,suspect", [("Unknown", True), ("N/A", True), ("X", True), (" ", True), (None, True), ("3M", False), ("unknown", False), ("Acme", False)])
def test_suspect_brands(spark, brand, suspect):
    assert spark.createDataFrame([(brand,)], "b string").select(P.is_suspect(F.col("b"), F.lit("Bar"))).first()[0] is suspect


def test_promotion_in_turn(spark):
    """A blocked post goes, the first eligible claim makes the event, later ones fold into it, blocked or not."""
    claim = lambda i, raw, brand="acme", name="Bar", old=10.0, new=8.0, image=False, upc=None, entity=None: (i, raw, datetime(2024, 1, i), brand, name, None, old, new, "oz", None, None, None, None, upc, None, image, entity)
    schema = "claim_id long, raw_item_id string, extracted_at timestamp, brand string, product_name string, category string, old_size double, new_size double, old_unit string, new_unit string, old_price double, new_price double, retailer string, upc string, observed_date date, has_image boolean, entity_id string"
    claims = spark.createDataFrame([
        claim(1, "r"), claim(2, "n", upc="7"), claim(3, "r", "ACME", upc="7"), claim(4, "r", image=True), claim(5, "n", old=None, new=0.0), claim(6, "n", new=900.0), claim(7, "n", None, None, new=None), claim(8, "n", "Known", "Cake"), claim(9, "r", "Known", "Cake"),
        claim(10, "r", new=7.0), claim(11, "n", "known", "cake", entity="k9"), claim(12, "n", "KNOWN", "cake"), claim(13, "r", old=3.0, new=2.0),
    ], schema)
    entities = spark.createDataFrame([("k1", "Known", "Cake")], "entity_id string, brand string, name string")
    events = spark.createDataFrame([("old", "k1", 10.0, 8.0, date(2020, 1, 1), False), ("gone", "k9", 10.0, 8.0, date(2020, 1, 1), True)], "event_id string, entity_id string, size_before double, size_after double, observed_date date, is_retracted boolean")
    raw = spark.createDataFrame([("r", "reddit", date(2024, 2, 2), False), ("n", "news", None, True)], "raw_item_id string, source_type string, source_date date, has_social_image boolean")
    out = P.promote(claims, entities, spark.createDataFrame([("v", "8")], "variant_id string, upc string"), events, raw, "2024-12-31")
    decided = {r.claim_id: (r.status, r.reason, r.entity_id) for r in out["decided"].collect()}
    new = next(v[2] for k, v in decided.items() if k == 2)
    assert decided[1] == ("discarded", "no image", None) and decided[2] == ("matched", None, new) and decided[3] == ("evidence", None, new) and decided[4] == ("evidence", None, new)
    assert decided[5] == ("discarded", "no size", None) and decided[6] == ("discarded", "size ratio", None) and decided[7][0] == "matched" and decided[8] == ("evidence", None, "k1") and decided[9] == ("evidence", None, "k1")
    assert decided[10][:2] == ("discarded", "no image") and decided[11] == ("matched", None, "k9") and decided[12] == ("evidence", None, "k9") and decided[13][:2] == ("discarded", "no image")
    made = {(r.entity_id, r.size_before, r.size_after): r for r in out["events"].collect()}
    assert set(made) == {(new, 10.0, 8.0), ("k9", 10.0, 8.0)}
    event = made[(new, 10.0, 8.0)]
    assert (event.claim_id, event.evidence, event.evidence_count, event.change_type, event.severity, str(event.observed_date)) == (2, [2, 3, 4], 3, "shrinkflation", "moderate", "2024-12-31")
    assert rows_of(out["folded"], "event_id", "more_evidence", "evidence") == [("old", 2, [8, 9])]
    assert rows_of(out["flags"], "flag_kind", "claim_id") == [("short_brand", 7)] and {(r.brand, r.name) for r in out["entities"].collect()} == {("Acme", "Bar"), ("Unknown", "Unknown Product")}
    assert out["variants"].where("upc = '7'").count() == 1 and out["observations"].where("claim_id = 7").count() == 1 and out["observations"].count() == 2 * 10 + 1


def test_repeats_and_profiles(spark):
    events = spark.createDataFrame([("b", 1, 10.0, 8.0, date(2024, 1, 5), None, ["x"]), ("a", 1, 10.0, 8.0, date(2024, 1, 9), 1, ["y", "z"]), ("c", 1, None, 8.0, date(2024, 1, 1), 1, [])], "event_id string, entity_id long, size_before double, size_after double, day date, evidence_count int, evidence array<string>")
    assert [tuple(r) for r in Q.merge_repeats(events, ["entity_id", "size_before", "size_after"], "day", "event_id").collect()] == [(1, 10.0, 8.0, "b", date(2024, 1, 5), 2, 3, ["x", "y", "z"])]
    got = Q.cluster_by_days(events.withColumn("day", F.when(F.col("event_id") != "c", F.col("day"))), ["entity_id"], "day", "event_id", 3).collect()
    assert sorted((r.event_id, str(r.anchor), r.is_canonical) for r in got) == [("a", "2024-01-09", True), ("b", "2024-01-05", True), ("c", "None", True)]
    runs = spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.005), (1, 3, 10.02), (1, 4, 9.0), (2, 1, None)], "k long, at int, v double")
    assert [tuple(r) for r in series.run_summary(runs, "k", "at", "v", 0.01).collect()] == [(1, 3, 10.0, 9.0)]


def test_sources(spark, tmp_path):
    posts = lambda *rows: spark.createDataFrame(rows, "id string, created_utc long, title string")
    few, more = posts(("a", 5, "first"), ("", 6, "no id"), ("o", 1, "old")), posts(("a", 7, "second"), ("b", 8, "b"))
    assert rows_of(readers.recent_posts(few, more, after=2), "id", "title") == [("a", "first"), ("b", "b")]
    enough = posts(("a", 5, "x"), ("c", 6, "x"), ("d", 7, "x"))
    assert rows_of(readers.recent_posts(enough, more, after=2), "id") == [("a",), ("c",), ("d",)]
    assert [r.id for r in readers.backfill(enough, 7, page=1, pages=1).collect()] == ["c"] and readers.backfill(enough, None).count() == 3
    lines = [{"_store_id": "1", "_seq": 1, "_product": json.dumps({"productId": "p", "size": "1 oz"})}, {"_store_id": "1", "_seq": 2, "_product": json.dumps({"productId": "p", "size": "2 oz"})}, {"_seq": 3, "_product": json.dumps({"productId": ""})}]
    (tmp_path / "k.json").write_text("\n".join(map(json.dumps, lines)))
    got = readers.kroger_catalog(spark, str(tmp_path / "k.json")).collect()
    assert [(r.store, r.product_id, json.loads(r.payload)["size"]) for r in got] == [("1", "p", "2 oz")]
    html = "<h1>Smaller packs</h1><h2>How to: shop</h2><p>no</p><h2>Acme &amp; Co — Crackers</h2><div><p>Now <b>9 oz</b>.</p></div><h3>acme &amp; co: crackers</h3><h3>Solo</h3>"
    found = readers.report_findings(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [tuple(r) for r in found] == [("u", "Smaller packs", "Acme & Co", "Crackers", "Now 9 oz .")]
    wide = spark.createDataFrame([("All Food ", 1.0, None), (None, 2.0, 3.0)], "`Item` string, `Jan 2024` double, `2024M02` double")
    tall = spark.createDataFrame([("x", "2024-03", 4.0), ("x", "later", 5.0)], "Series string, Period string, n double")
    assert rows_of(readers.series_of_sheet(wide), "series", "period", "value") == [("all food", date(2024, 1, 1), 1.0)] and rows_of(readers.series_of_sheet(tall), "series", "period", "value") == [("x", date(2024, 3, 1), 4.0)]
