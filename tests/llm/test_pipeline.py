"""Every stage of the pipeline, and all of them in a row, against brute force."""

import math
import zlib

import numpy as np
import pytest
from conftest import corpus
from pyspark.sql import functions as F
from test_dedup import near_groups, order, words_of
from test_text_operators import contaminated, naive_seats, naive_shapes

import corpus_pipeline as P
from packwatch.llm import mixing, quality_pu

ROWS = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in corpus(seed=11, n=70)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    long = ROWS[6][1].split(" ")
    items = [(1, " ".join(long[100:125]).upper()), (2, None), (3, "one two"), (None, "of"), (4, " ".join(long[300:312]))]
    spark.createDataFrame([(i, int(len(t or "") > 40), 0) for i, t, *_ in ROWS if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in ROWS], SCHEMA + ", key string, slice int, score double").repartition(4)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def naive_quality(spark, rows, folder):
    frame = spark.createDataFrame(rows, SCHEMA)
    model = quality_pu.Model.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    first = np.cumsum([0, *[len(e) + 1 for e in model.edges[:-1]]])
    score = lambda t: model.offset + sum(model.weights[first[k] + sum(v >= e for e in model.edges[k])] for k, v in enumerate(naive_shapes(t or "")))
    return [r for r in rows if 1 / (1 + math.exp(-score(r[1]))) >= 0.3]


def naive_near(rows):
    left, seen = [], set()
    groups = near_groups([(r[0], r[1], None) for r in rows], 5, 80)
    component = {(g[0], g[1]): g[2] for g in groups}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        n = len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
        key = (r[0], r[1]) if not n else ("group", component[(r[0], n)])
        if (not n or r[0] == component[(r[0], n)]) and key not in seen:
            seen.add(key)
            left.append(r)
    return left


def naive_passages(rows):
    seen, left = set(), []
    for i, t, lang, source, n in sorted(rows, key=order):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in seen:
                gone[k : k + 50] = [True] * 50
            seen.add(tuple(w[k : k + 50]))
        if w and all(gone):
            continue
        left.append((i, [x.decode() for x, g in zip(w, gone) if not g], lang, source, any(gone), t, n))
    return left


def naive_clean(rows, items):
    bad = {(i, n) for i, n, hit, *_ in contaminated([(r[0], r[1], None) for r in rows], items, 10) if hit}
    import re

    size = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    return [r for r in rows if (r[0], size(r[1])) not in bad]


def naive_mix(spark, rows, shard_docs, block=16, seed=0):
    """Blocks by highest quotient, one at a time, and every word's block looked up."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(words_of(r[1])) for r in rows if r[3] == s) for s in sources}
    goal = dict(zip(sources, mixing.targets([size[s] for s in sources], [1 + k % 3 for k in range(len(sources))], 3)))
    quota = dict(zip(sources, naive_seats([goal[s] for s in sources], round(sum(goal.values()) / block), [3 * math.ceil(size[s] / block) for s in sources])))
    n_shards = max(1, math.ceil(len(rows) / shard_docs))
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    shard_of = {r.doc_id: r.s for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)).cast("int").alias("s")).collect()}
    out = []
    for number, s in enumerate(sources):
        shards = sorted({shard_of[r[0]] for r in rows if r[3] == s})
        own = {h: sorted(((r[0] is not None, r[0] or 0, len(words_of(r[1]))) for r in rows if r[3] == s and shard_of[r[0]] == h)) for h in shards}
        words = [sum(x[2] for x in own[h]) for h in shards]
        seats = naive_seats(words, quota[s], [3 * math.ceil(n / block) for n in words])
        for h, n, q in zip(shards, words, seats):
            blocks = max(1, math.ceil(n / block))
            step, first = mixing._stride(max(1, math.ceil(n / block))), zlib.crc32(f"{seed}/{number}/{h}".encode())
            at = 0
            for known, i, k in own[h]:
                times = [q // blocks + ((b * step + first) % blocks < q % blocks) for b in (w // block for w in range(at, at + k))]
                at += k
                out.append((i if known else None, k, size[s], goal[s], sum(times)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_docs", [20_000, 9])
def test_mix_takes_the_blocks_of_the_quotas(spark, docs, monkeypatch, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    got = P.mix(spark, docs, "").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == naive_mix(spark, ROWS, shard_docs)


def test_quality(spark, docs, folder):
    assert rows_of(P.quality(spark, docs, folder)) == sorted(naive_quality(spark, ROWS, folder), key=repr)


def test_near_dedup(spark, docs, folder):
    assert rows_of(P.near_dedup(spark, docs, folder)) == sorted(naive_near(ROWS), key=repr)


def test_repeated_passages(spark, docs, folder):
    got = P.repeated_passages(spark, docs, folder).collect()
    expected = naive_passages(ROWS)
    assert sorted([(r.doc_id, words_of(r.text), r.lang, r.source) for r in got], key=repr) == sorted([(i, [x.encode() for x in w], lang, s) for i, w, lang, s, *_ in expected], key=repr)
    cut = {(i, len(w)): c for i, w, _, _, c, *_ in expected}
    for r in got:  # what isn't cut stays as it was
        if not cut[(r.doc_id, len(words_of(r.text)))]:
            assert any(r.doc_id == i and r.text == (t or "") and r.n_chars == n for i, t, _, _, n in ROWS)
        else:
            assert r.n_chars == len(r.text)


def test_benchmark_leaks(spark, docs, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = naive_clean(ROWS, items)
    assert 0 < len(left) < len(ROWS)
    assert rows_of(P.benchmark_leaks(spark, docs, folder)) == sorted(left, key=repr)


def test_all_stages(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = naive_near(naive_quality(spark, ROWS, folder))
    cut = P.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()  # held against brute force above
    rows = naive_clean([tuple(r) for r in cut], items)
    got = P.run(spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == naive_mix(spark, rows, 20_000)


def test_stages_of_empty_and_lean_tables(spark, folder):
    empty, lean = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a few words of text here")], "doc_id long, text string")
    for name, stage in P.STAGES:
        assert stage(spark, empty, folder).collect() == []
        got = stage(spark, lean, folder).collect()
        assert len(got) <= 1 and (name == "mixing" or all(list(r.asDict()) == list(P.COLUMNS) for r in got))
