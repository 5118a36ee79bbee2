"""Search by rare runs, greedy heads, feed items, spaced rows and canonical JSON."""

import hashlib
import json
import random
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from packwatch.functions.text import content_hash
from packwatch.operators import fuzzy, quality
from packwatch.operators.search import holding
from packwatch.operators.series import spaced
from packwatch.sources.sinks import rss_items


def test_held_texts_by_brute_force(spark):
    rng = random.Random(3)
    say = lambda a, b: "".join(rng.choice("abé A") for _ in range(rng.randint(a, b)))
    texts = [(rng.choice(["x", "y"]), k, rng.choice([say(0, 12), None])) for k in range(150)]
    wanted = [(rng.choice(["x", "y", None]), rng.choice([say(0, 4), None, "zz", "%", "a_"])) for _ in range(60)]
    t, w = spark.createDataFrame(texts, "b string, id int, text string"), spark.createDataFrame(wanted, "b string, wanted string")
    low = lambda s: s.lower()
    expected = {(b, low(q), i) for b, q in wanted if b and q for c, i, x in texts if c == b and x and low(q) in low(x)}
    got = [tuple(r) for r in holding(w, t, ["b"]).select("b", "wanted", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    every = {(low(q), i) for _, q in wanted if q for _, i, x in texts if x and low(q) in low(x)}
    assert {tuple(r) for r in holding(w, t).select("wanted", "id").collect()} == every


def greedy(names, threshold):
    heads, out = [], {}
    for at, name in sorted(names):
        out[at] = next((h for h, n in heads if SequenceMatcher(None, n, name).ratio() >= threshold), at)
        if out[at] == at:
            heads.append((at, name))
    return out


@pytest.mark.parametrize("heads, threshold", [(32, 0.85), (1, 0.85), (2, 0.6)])
def test_greedy_heads_equal_the_sequential_rule(spark, monkeypatch, heads, threshold):
    monkeypatch.setattr(fuzzy, "HEADS", heads)
    monkeypatch.setattr(fuzzy, "MOST_HEADS", max(heads, 4))
    rng = random.Random(heads)
    base = ["large widget 12", "small bolt", "xy"]
    names = {("g", "".join(c if rng.random() > 0.15 else rng.choice("abz 19") for c in rng.choice(base))) for _ in range(90)} | {("h", ""), ("h", "a"), ("i", "alone")}
    rows = [(g, k, n) for k, (g, n) in enumerate(sorted(names, key=lambda x: hashlib.md5(repr(x).encode()).hexdigest()))]
    got = fuzzy.greedy_heads(spark.createDataFrame(rows, "g string, at long, n string"), ["g"], "at", "n", threshold).collect()
    expected = {}
    for group in "ghi":
        expected.update(greedy([(k, n) for g, k, n in rows if g == group], threshold))
    assert len(got) == len(rows) and {r.at: r.head for r in got} == expected


def test_names_that_are_alike_share_a_prefix():
    rng = random.Random(7)
    for _ in range(4000):
        a = "".join(rng.choice("abc1") for _ in range(rng.randint(0, 12)))
        b = "".join(c if rng.random() > 0.2 else rng.choice("abc1") for c in a)
        for t in (0.6, 0.85, 1.0):
            if a and b and fuzzy.alike(a, b, t):
                assert set(fuzzy.prefix(a, t)) & set(fuzzy.prefix(b, t))


def test_products_of_several_changes_are_in_several_groups(spark):
    rows = [(1, "A", "Red Bar", 10.0, 8.0, False), (2, "A", "Bar Red", 10.0, 8.0, False), (2, "A", "Bar Red", 8.0, 7.0, False), (3, "A", "Nut", 8.0, 7.0, False), (4, "B", "Nut", 8.0, 7.0, False), (5, "A", "Nut", 10.0, 8.0, True), (6, "A", None, None, 8.0, False)]
    events = spark.createDataFrame(rows, "entity_id int, brand string, product_name string, size_before double, size_after double, is_retracted boolean")
    assert sorted(tuple(r) for r in quality.same_change_groups(events).collect()) == [("A", 8.0, 7.0, 2, 2, False), ("A", 10.0, 8.0, 2, 2, True)]


def test_feed_items(spark):
    rows = [
        ("1", "7", "Cadbury", "Cadbury Favourites", 16.0, 14.5, "oz", -9.375, 3, date(2024, 1, 5), datetime(2024, 1, 6, 7, 8, 9), "shrinkflation", False),
        ("2", None, "A & B's", " ", None, 2.0, None, None, 1, None, None, "shrinkflation", False),
        ("3", "7", None, "x", 1.0, 1.0, "g", 1.0, 1, None, None, "shrinkflation", False), ("4", "7", "A", "x", 1.0, 1.0, "g", 1.0, 1, None, None, "upsizing", False), ("5", "7", "A", "x", 1.0, 1.0, "g", 1.0, 1, None, None, "shrinkflation", True),
        ("6", "9", "Dot", "Dot", 2.0, 1.0, " g ", -50.0, None, date(2024, 1, 4), None, "shrinkflation", False),
    ]
    events = spark.createDataFrame(rows, "event_id string, entity_id string, brand string, product_name string, size_before double, size_after double, size_unit string, size_delta_pct double, evidence_count int, observed_date date, published_at timestamp, change_type string, is_retracted boolean")
    got = [r.value for r in rss_items(events, "https://s.example").collect()]
    assert sorted(got) == sorted([
        '<item><title>Cadbury Favourites shrank 16oz → 14.5oz</title><link>https://s.example/products/7</link><guid isPermaLink="false">https://s.example/events/1</guid><pubDate>Sat, 06 Jan 2024 07:08:09 GMT</pubDate><description>9.4% smaller · 3 sources · observed 2024-01-05</description></item>',
        '<item><title>A &amp; B&apos;s product documented</title><link>https://s.example/brands/a%20%26%20b%27s</link><guid isPermaLink="false">https://s.example/events/2</guid><description>Shrinkflation event documented by packwatch.</description></item>',
        '<item><title>Dot shrank 2g → 1g</title><link>https://s.example/products/9</link><guid isPermaLink="false">https://s.example/events/6</guid><pubDate>Thu, 04 Jan 2024 00:00:00 GMT</pubDate><description>50.0% smaller · observed 2024-01-04</description></item>',
    ])
    assert [r.value for r in rss_items(events, "https://s.example", limit=1).collect()] == [x for x in got if "Cadbury" in x]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 6, 20])
def test_spaced_rows(spark, most):
    counts = [1, 2, 5, 6, 7, 13, 40]
    rows = spark.createDataFrame([(n, k) for n in counts for k in range(n)], "key int, at int")
    got = {}
    for r in spaced(rows, "key", "at", most).collect():
        got.setdefault(r.key, []).append(r["at"])
    for n in counts:
        step = (n - 1) / (most - 1) if most > 1 else 0
        expected = list(range(n)) if n <= most else [0] * most if most < 2 else [0, *[int(step * i + 0.5) for i in range(1, most - 1)], n - 1]
        assert sorted(got.get(n, [])) == expected


def test_content_hash_of_any_order_of_keys(spark):
    payloads = [{"b": [1, {"z": None, "a": "x, y: \"q\" \\ {"}], "a": {"d": True, "c": 1.5}}, {"k": 69}, [], "text", {"": ""}]
    rows = [(k, json.dumps(p), json.dumps(p, sort_keys=True)) for k, p in enumerate(payloads)]
    rows += [(0, '{"a":{"c":1.5,"d":true},"b":[1,{"a":"x, y: \\"q\\" \\\\ {","z":null}]}', rows[0][2]), (9, "{broken", "{broken"), (10, None, None)]
    got = spark.createDataFrame(rows, "id int, payload string, expected string").select("id", content_hash(F.col("payload")).alias("hash"), "expected").collect()
    for r in got:
        assert r.hash == (None if r.expected is None else hashlib.sha256(r.expected.encode()).hexdigest()), r
