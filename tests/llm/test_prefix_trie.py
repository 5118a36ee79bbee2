"""The prefix trie against one built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from packwatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos long, depth int, node string, n int, bytes string, digest int, top int, base int, length int"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    built = {}
    for c, turns in own.items():
        turns.sort()
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = [x[3:] for x in own.get(base, [])[:h]] + [x[3:] for x in turns[h:]]
    members, below = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        m, sub = members[path], [out[p] for p in below[path]]
        ends = ",".join(str(c) for c in m if len(built[c]) == len(path))
        saved = (len(m) - 1) * len(path[-1][1].encode()) if path else 0
        out[path] = (m[0], len(path), members[path[:-1]][0] if path else None, len(m), len(sub), sum(s[5] for s in sub) or 1, saved + sum(s[6] for s in sub), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def check(spark, rows, partitions=5):
    frame = spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA).repartition(partitions)
    got = prefix_trie.conversation_trie(frame)
    assert got.columns == prefix_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def talk(rng, ids, most, texts="xyz"):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in ids for t in range(rng.randint(1, most))]


def test_many_conversations(spark):
    check(spark, talk(random.Random(1), range(-13, 90), 12))


def test_nulls_ties_repeats_and_negative_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([*range(-9, 30), None]), rng.choice([0, 1, 1, None, 7]), rng.choice(["a", "", None]), rng.choice(["é", "", None, "x\ny"])) for _ in range(260)]
    check(spark, rows + rows[:30])


def test_small_tables(spark):
    check(spark, [])
    check(spark, [(None, 1, "a", "b")])
    check(spark, [(0, None, None, None)])
    check(spark, [(k, 0, "a", "b") for k in range(8)])  # some are left without turns


def test_roles_and_texts_that_join_alike_are_told_apart(spark):
    check(spark, [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "a", "bc"), (15, 0, "2", ":ab"), (20, 0, "", "12:ab")])


@pytest.mark.parametrize("block", [4096, 3])
def test_long_shared_beginnings(spark, monkeypatch, block):
    """Many turns in common, parted at every depth; jobs of 1, 2, 4, ... turns and of a bounded number."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(3)
    base = [(rng.choice("ua"), rng.choice("xyzé")) for _ in range(45)]
    rows = []
    for c in range(0, 150, 5):
        cut = rng.choice([45, 45, 40, 17, 16, 3])
        rows += [(c, t, *turn) for t, turn in enumerate(base[:cut])] + [(c, 100 + t, "u", rng.choice("pq")) for t in range(rng.randint(0, 3))]
    check(spark, rows + talk(rng, range(1, 150, 7), 5))


def test_jobs_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    blocks = []
    chained = prefix_trie._chained
    monkeypatch.setattr(prefix_trie, "_chained", lambda rows: blocks.append(1) or chained(rows))
    check(spark, [(c, t, "u", "same") for c in (0, 5) for t in range(100)])
    assert len(blocks) <= 7


def test_ids_are_packed_in_order(spark, monkeypatch):
    """Ends of many members, in several packed rows."""
    monkeypatch.setattr(prefix_trie, "PACKED_BITS", 2)
    check(spark, [(c, t, "u", "hello") for c in range(-40, 60) for t in range(3)])


def test_long_conversation_over_many_ranges(spark):
    """One conversation holds most of all turns."""
    rng = random.Random(5)
    check(spark, [(10, t, "u", str(t % 7)) for t in range(2500)] + talk(rng, range(20), 4), partitions=9)
