"""Near, substring and suffix dedup against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from packwatch.llm import minhash_dedup, substring_dedup, suffix_dedup
from packwatch.llm.suffix_array import suffix_array, suffix_arrays


def words_of(text):
    return (text or "").encode().split()


def order(row):
    return (row[0] is not None, row[0] or 0, (row[1] is not None, (row[1] or "").encode()))


def near_groups(rows, size, percent):
    """Expected (doc_id, n_shingles, component_id, kept) of every row."""
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        component = i if not sets[k] else min(ids, default=None)
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    got = minhash_dedup.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_groups(rows, size, percent)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Blocks far smaller than the groups give the same components."""
    monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "TEXT_BLOCK", 3)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 8)):
            own[k] = f"v{i}{k}"
        rows.append((i, " ".join(own), None))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(frame, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_groups(rows, 3, 85)


@pytest.fixture
def sent_by_value():
    """Modules whose functions, as patched here, also run on the workers."""
    from pyspark import cloudpickle

    modules = [minhash_dedup, suffix_dedup]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    yield
    for module in modules:
        cloudpickle.unregister_pickle_by_value(module)


def test_variants_without_a_common_flank_are_not_sorted(spark, monkeypatch, sent_by_value):
    """Whole copies leave one variant to a group, whose strings all differ; only its neighbours are compared."""

    def refused(*_):
        raise AssertionError("sorted")

    monkeypatch.setattr(suffix_dedup, "suffix_array", refused)
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", refused)
    texts = [" ".join(f"w{(k + 1) * (i + 3) * 7919 % 10007}" for k in range(60)) for i in range(5)]
    rows = spark.createDataFrame([(n, texts[n % 5]) for n in range(15)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.duplicates(rows).select("doc_id", "n_removed").collect()}
    assert got == {n: 0 if n < 5 else len(texts[n % 5]) for n in range(15)}


def test_groups_follow_equal_flanks_over_several_steps():
    left, right = np.array([5, 5, 0, 7, 0, 9], np.uint64), np.array([0, 3, 3, 0, 8, 0], np.uint64)
    assert suffix_dedup._by_flank(left, right).tolist() == [0, 0, 0, 3, 4, 5]
    n = 200  # a chain
    steps = np.arange(n, dtype=np.uint64)
    assert set(suffix_dedup._by_flank(steps // np.uint64(2) + np.uint64(1), (steps + np.uint64(1)) // np.uint64(2)).tolist()) == {0}


def test_every_removed_byte_is_decided_by_neighbours_in_a_suffix_array(docs, monkeypatch, sent_by_value):
    """Without the runs of neighbours nothing is removed, whichever hashes agree."""
    assert suffix_dedup.duplicates(docs).where("n_removed > 0").count() > 5
    monkeypatch.setattr(suffix_dedup, "_equal_neighbours", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert suffix_dedup.duplicates(docs).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("piece", [60, 1000])
def test_long_texts_are_looked_through_in_pieces(docs, rows, monkeypatch, sent_by_value, piece):
    from pyspark.sql import functions as F

    whole = suffix_dedup.duplicates(docs).select("doc_id", "n_removed", F.md5("kept")).collect()
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert sorted(map(tuple, suffix_dedup.duplicates(docs).select("doc_id", "n_removed", F.md5("kept")).collect()), key=repr) == sorted(map(tuple, whole), key=repr)


def test_sets_of_one_hash_are_told_apart(docs, rows, monkeypatch, sent_by_value):
    """With a first hash of two values the second one keeps all classes apart."""
    plain = minhash_dedup._nodes

    def weak(h, first, n):
        node, check = plain(h, first, n)
        return (node & 1) + 1, check

    monkeypatch.setattr(minhash_dedup, "_nodes", weak)
    got = minhash_dedup.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_groups(rows, 3, 85)


def test_rows_without_id_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text, "a"), (None, text + " x", "b"), (5, text + " x", "c"), (5, text + " x", "c"), (None, None, "d"), (7, " ", "e")], "doc_id long, text string, key string")
    kept = minhash_dedup.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.key) for r in kept.collect()) == [(-1, "d"), (5, "c"), (7, "e")]
    got = minhash_dedup.near_duplicates(docs.where("doc_id is null"), 5, 80)
    assert [(r.doc_id, r.component_id, r.kept) for r in got.collect()] == [(None, None, True)] * 3


def test_one_of_each_keeps_one_row_of_a_group(docs, rows):
    kept = minhash_dedup.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = near_groups(rows, 5, 80)
    alone = sum(n == 0 for _, n, _, _ in {g if g[1] else (g[0], 0, 0, 0) for g in groups})
    components = minhash_dedup.near_duplicates(docs, 5, 80).where("component is not null").select("component").distinct().count()
    blanks = len({(r[0], r[1]) for r in rows if not words_of(r[1])})
    assert kept.count() == components + blanks and alone <= blanks


def test_least_matches_bounds_the_misses():
    from math import comb

    t = minhash_dedup.least_matches(0.85)
    assert sum(comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t)) <= 1e-6 < sum(comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t + 1))


@pytest.mark.parametrize("window,slice_bytes", [(20, 1 << 22), (20, 2000), (5, 3000), (50, 2000)])
def test_repeated_passages(docs, rows, window, slice_bytes, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", slice_bytes)
    seen, expected = set(), []
    for i, text, _ in sorted(rows, key=order):
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            passage = tuple(w[k : k + window])
            if passage in seen:
                gone[k : k + window] = [True] * window
            seen.add(passage)
        expected.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = substring_dedup.repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_layout_of_what_stays(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"a\n\nb  {passage}\nend"), (2, f"x\ty\n{passage}\n\nlast  word"), (3, "un\n touched ")]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, layout=True)
    assert {r.doc_id: r.kept_text for r in got.collect()} == {1: rows[0][1], 2: "x\ty last  word", 3: rows[2][1]}


@pytest.mark.parametrize("window,slice_bytes", [(50, 1 << 22), (50, 3000), (12, 2000)])
def test_repeated_bytes(docs, rows, window, slice_bytes, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", slice_bytes)
    first, expected = {}, []
    for rank, (i, text, _) in sorted([(-1 if r[0] is None else r[0], r) for r in rows], key=lambda x: x[0]):
        b = (text or "").encode()
        for k in range(len(b) - window + 1):
            first.setdefault(b[k : k + window], rank)
    for i, text, _ in rows:
        b, rank = (text or "").encode(), -1 if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < rank:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    from pyspark.sql import functions as F

    got = suffix_dedup.duplicates(docs, window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), max_size=6))
def test_suffix_arrays(texts):
    expected = [sorted(range(len(t)), key=lambda k, t=t: t[k:]) for t in texts]
    assert [suffix_array(t) for t in texts] == expected
    bounds = np.cumsum([0, *map(len, texts)])
    got = suffix_arrays(np.array([x for t in texts for x in t], dtype=np.int64), bounds)
    assert [(got[a:b] - a).tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expected


def test_empty_tables(empty):
    assert minhash_dedup.near_duplicates(empty).collect() == []
    assert substring_dedup.repeats(empty, 20).collect() == []
    assert suffix_dedup.duplicates(empty).collect() == []
    assert minhash_dedup.one_of_each(empty).collect() == []
