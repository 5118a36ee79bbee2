"""Vector codes: searches and whole tables against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from packwatch.llm import vector_codes


@pytest.mark.parametrize("n, width, most", [(256, 16, 1000), (256, 4, 3), (40, 3, 2), (300, 2, 5), (1, 5, 9), (200, 1, 1), (17, 6, 1)])
def test_search_finds_the_lowest_of_the_nearest(n, width, most):
    rng = np.random.default_rng(n + width)
    entries, queries = rng.integers(-most, most + 1, (n, width)), rng.integers(-2 * most, 2 * most + 1, (400, width))
    index, distance = vector_codes.Balls(entries).nearest(queries)
    all_ = ((queries[:, None] - entries) ** 2).sum(2)
    assert (index == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_search_of_equal_entries_and_exact_hits():
    entries = np.array([[5, 5]] * 30 + [[0, 0]] * 30 + [[5, 5]] * 3)
    index, distance = vector_codes.Balls(entries).nearest(np.array([[5, 5], [0, 1], [2, 3]]))
    assert index.tolist() == [0, 30, 0] and distance.tolist() == [0, 1, 13]


def test_search_leaves_balls_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    entries = np.concatenate([c + rng.integers(-5, 6, (16, 8)) for c in centres])
    tree, seen = vector_codes.Balls(entries), []
    tree._reach = lambda best: seen.append(len(best)) or np.sqrt(best.astype(float)) * (1 + vector_codes._SLACK)
    index, _ = tree.nearest(entries)
    assert (index == ((entries[:, None] - entries) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 0.8 * len(entries) * 2 * 31  # visits of both sides of each of 31 nodes by every query would be that many


def brute(rows, entries=256, rounds=4):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max([len(v) for _, v, _ in kept], default=0) // 4) * 4
    x = [[math.floor(1024 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // 4
    parts = [[tuple(v[k * size : (k + 1) * size]) for v in x] for k in range(4)]
    books = [list(p[:entries]) for p in parts]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            of = [near(q, books[k])[1] for q in parts[k]]
            for e in range(len(books[k])):
                mine = [q for q, at in zip(parts[k], of) if at == e]
                if mine:
                    books[k][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    found = [[near(p[r], b) for p, b in zip(parts, books)] for r in range(len(kept))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, l), error in zip(kept, errors):
        by_label[l] = by_label.get(l, 0) + error
    return [(i, "".join(f"{e:02x}" for _, e in f), error, by_label[l], digest) for (i, _, l), f, error in zip(kept, found, errors)]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, code int, error string, x int, of int, entry int, part int"


def check(spark, rows, partitions=5, **kwargs):
    frame = spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA).repartition(partitions)
    got = vector_codes.compress(frame, **kwargs)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, [tuple(r)[:5] for r in got.collect()])) == sorted(map(repr, brute(rows, **kwargs)))


def vectors(n, width, seed, grain=None):
    rng = random.Random(seed)
    draw = lambda: round(rng.gauss(0, 1), grain) if grain is not None else rng.gauss(0, 1)
    return [(k, [draw() for _ in range(width)], rng.choice([0, 1, None])) for k in range(n)]


def test_more_vectors_than_entries(spark):
    check(spark, vectors(400, 8, 1))


def test_ties_repeats_and_unused_entries(spark):
    rows = vectors(300, 8, 2, grain=0)
    check(spark, rows + rows[:40] + [(7, rows[3][1], 1), (None, rows[5][1], None), (None, rows[6][1], 0)], rounds=2)


def test_nulls_lengths_and_extremes(spark):
    odd = [(1, None, 0), (2, [1.0, None, 0.0, 0.0], 0), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("inf")] * 4, 1), (5, [-float("inf")] * 4, None)]
    check(spark, odd + vectors(30, 4, 3) + [(100, [0.5], 3), (101, [], 3), (102, [-0.0001] * 6, None)])
    check(spark, odd)
    check(spark, [])
    check(spark, [(1, [], None), (2, [], 1)])
    with pytest.raises(ValueError, match="beyond exact sums"):
        vector_codes.compress(spark.createDataFrame([(1, [3e30] * 4, 1)], "vec_id long, embedding array<float>, label int"))


def test_partitions_do_not_matter(spark):
    frame = spark.createDataFrame(vectors(500, 12, 6), "vec_id long, embedding array<float>, label int")
    out = [sorted(map(tuple, vector_codes.compress(frame.repartition(n)).collect()), key=repr) for n in (1, 7)]
    assert out[0] == out[1]
