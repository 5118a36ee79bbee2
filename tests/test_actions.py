"""Replayed actions against one after the other, and the cascade of retractions."""

import random

import pytest

from packwatch.operators import lifecycle
from packwatch.operators.actions import effective, merge_ends, replay
from packwatch.streaming.cascade import Catalogue
from packwatch.streaming.store import Store

ACTIONS = "seq long, kind string, claim_id long, value string, entity_id long, source long, target long, undoes long"


def sequential(claims, products, actions):
    by_seq = {a[0]: a for a in actions}
    counts = {}
    for a in sorted(actions, reverse=True):  # later undos decide first
        counts[a[0]] = not any(u[1] == "undo" and u[7] == a[0] and u[0] > a[0] and counts[u[0]] for u in actions)
    state = {c[0]: dict(zip(("status", "entity_id", "brand", "product_name"), c[1:])) | {"previous": None} for c in claims}
    gone = {p[0]: p[1] for p in products}
    for seq in sorted(by_seq):
        _, kind, claim, value, entity, source, target, _ = by_seq[seq]
        if not counts[seq] or kind == "undo":
            continue
        row = state.get(claim)
        if kind == "merge" and source != target:
            for r in state.values():
                if r["entity_id"] == source:
                    r.update(entity_id=target, previous=source)
            if source in gone:
                gone[source] = True
        elif kind == "approve" and row:
            row.update(status="matched", entity_id=entity, previous=None)
        elif kind in ("evidence", "discard") and row:
            row["status"] = {"evidence": "evidence", "discard": "discarded"}[kind]
        elif kind.startswith("edit_") and row:
            row[kind[5:]] = value
    return sorted(((c, r["status"], r["entity_id"], r["previous"], r["brand"], r["product_name"]) for c, r in state.items()), key=repr), sorted(gone.items())


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_one_action_after_the_other(spark, seed):
    rng = random.Random(seed)
    claims = [(c, "pending", rng.choice([*range(8), None]), "b", "n") for c in range(30)]
    products = [(p, p == 7) for p in range(8)]
    actions = []
    for seq in range(160):
        kind = rng.choice(["approve", "evidence", "discard", "edit_brand", "edit_product_name", "merge", "merge", "undo", "undo"])
        actions.append((seq, kind, rng.randrange(32), rng.choice(["x", "y", None]), rng.randrange(8), rng.randrange(9), rng.randrange(9), rng.randrange(170)))
    out, after = replay(spark.createDataFrame(claims, "claim_id long, status string, entity_id long, brand string, product_name string"), spark.createDataFrame(products, "entity_id long, is_retracted boolean"), spark.createDataFrame(actions, ACTIONS).repartition(3))
    expected, gone = sequential(claims, products, actions)
    assert sorted(map(tuple, out.collect()), key=repr) == expected
    assert sorted((r.entity_id, r.is_retracted) for r in after.collect()) == gone


def test_undos_of_undos(spark):
    rows = [(0, "discard", 1, None, None, None, None, None), *[(k, "undo", None, None, None, None, None, k - 1) for k in range(1, 6)], (6, "discard", 2, None, None, None, None, None), (7, "undo", None, None, None, None, None, 9), (8, "undo", None, None, None, None, None, 8)]
    got = effective(spark.createDataFrame(rows, ACTIONS))
    assert [r.seq for r in got.orderBy("seq").collect()] == [6]
    assert effective(spark.createDataFrame([], ACTIONS)).count() == 0


def test_chains_of_merges_are_doubled(spark):
    """A chain of 100 products, and a cycle that time unwinds."""
    chain = [(k, k, k + 1) for k in range(100)] + [(200, 100, 0)]
    got = {r.seq: (r.end, r["last"]) for r in merge_ends(spark.createDataFrame(chain, "seq long, source long, target long")).collect()}
    assert got[0] == (0, 100) and got[99] == (0, 100) and got[200] == (0, 100) and len(got) == 101


def test_cascade_equals_rules_applied_until_nothing_changes(spark, tmp_path):
    """Three batches of discarded claims, retracted events and products; the store's small parts show that others aren't touched."""
    rng = random.Random(4)
    claims = {c: rng.choice(["matched", "evidence", "discarded"]) for c in range(60)}
    events = {f"e{k}": (rng.randrange(15), rng.random() < 0.2) for k in range(40)}
    links = {(rng.choice(sorted(events)), rng.randrange(60)) for _ in range(70)}
    products = {p: p == 3 for p in range(16)}
    store = Store(spark, str(tmp_path), part_rows=3)
    catalogue = Catalogue(store)
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    catalogue.load(frame(claims.items(), "claim_id long, status string"), frame([(e, p, r) for e, (p, r) in events.items()], "event_id string, entity_id long, is_retracted boolean"), frame(links, "event_id string, claim_id long"), frame(products.items(), "entity_id long, is_retracted boolean"))
    for number in range(3):
        changed = {c: "discarded" for c in rng.sample(sorted(claims), 20)} | {0: "matched"}
        gone = rng.sample(sorted(events), 2) if number == 1 else []
        taken = [5, 99] if number == 2 else []
        before = store.manifest()
        catalogue.step(number, frame(changed.items(), "claim_id long, status string"), frame([(e, events[e][0]) for e in gone], "event_id string, entity_id long") if gone else None, frame([(p,) for p in taken], "entity_id long") if taken else None)
        assert not catalogue.step(number, frame(changed.items(), "claim_id long, status string"))
        claims.update(changed)
        touched = {e for e, c in links if c in changed}
        goes = {e for e in touched if all(claims[c] == "discarded" for x, c in links if x == e)} | set(gone) | {e for e, (p, _) in events.items() if p in taken}
        goes = {e for e in goes if not events[e][1]}
        for e in goes:
            events[e] = (events[e][0], True)
        for p in products:
            mine = [(e, r) for e, (q, r) in events.items() if q == p]
            if p in taken or any(e in goes for e, _ in mine) and all(r for _, r in mine):
                products[p] = True
        assert {r.event_id: (r.entity_id, r.is_retracted) for r in store.read("events").collect()} == events
        assert {r.entity_id: r.is_retracted for r in store.read("products").collect()} == products
        feed = store.changes("events", ["event_id"], before["version"]).collect()
        assert {r.event_id for r in feed} == goes and all(r.kind == "update" and r.after.is_retracted and not r.before.is_retracted for r in feed)
    assert store.changes("products", ["entity_id"], 0).where("kind <> 'insert'").count() == 0


def test_change_feed_of_inserts_updates_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame(rows, "k long, x string")
    for number, (keys, rows) in enumerate([([1, 2, 3], [(1, "a"), (2, "b"), (3, None)]), ([1, 2, 4], [(1, "a"), (4, "d")]), ([3], [(3, "c")])]):
        batch = store.begin("s", number)
        batch.replace("t", ["k"], frame([(k, "") for k in keys]), frame(rows))
        batch.commit()
    feed = {r.k: (r.kind, r.before and r.before.x, r.after and r.after.x) for r in store.changes("t", ["k"], 1, 3).collect()}
    assert feed == {2: ("delete", "b", None), 3: ("update", None, "c"), 4: ("insert", None, "d")}
    with pytest.raises(ValueError, match="no table"):
        store.changes("none", ["k"], 1)


def test_makers_by_property_label_and_class(spark):
    triples = [("b1", "P749", "big"), ("b1", "P127", "fund"), ("b1", "P127", "own"), ("b1", "P127", "own"), ("fund", "P31", "c9"), ("b2", "P176", "b2"), ("b2", "P176", "url"), ("b2", "P176", "bare"), ("b2", "P176", "none"), ("b2", "P749", "big"), ("b2", "P17", "own"), ("b3", "P176", "fund"), ("b4", "P176", "z"), ("b4", "P176", "a")]
    labels = [("big", " Big Co "), ("fund", "A Fund"), ("own", "Owner"), ("b2", "TWO"), ("url", "http://x"), ("bare", "Q12"), ("none", ""), ("z", "Zed"), ("a", "Abe")]
    brands = spark.createDataFrame([("One", "b1"), ("Two", "b2"), ("Three", "b3"), ("Four", "b4"), ("Five", "b5"), ("Six", None)], "brand string, qid string")
    got = lifecycle.chase_manufacturers(brands, spark.createDataFrame(triples, "subject string, property string, object string"), spark.createDataFrame(labels, "qid string, label string"), ["c9"])
    assert sorted(tuple(r) for r in got.collect()) == [("Four", "Abe"), ("One", "Owner"), ("Two", "Big Co")]
