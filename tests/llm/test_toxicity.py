"""Toxicity: n-grams against brute force, ratios and scores by hand, held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from packwatch.llm import toxicity


def naive_grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {text[k : k + n] for n in toxicity.GRAMS for k in range(len(text) - n + 1)}


def buckets(texts):
    out = [set() for _ in texts]
    for text, bucket in toxicity.distinct(pa.array(texts, pa.string())):
        for t, b in zip(text.tolist(), bucket.tolist()):
            assert b not in out[t]
            out[t].add(b)
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 40, 7])
def test_grams_are_those_of_each_text_alone(rows, monkeypatch, chunk):
    """Equal n-grams share a bucket in any text and piece; different ones hardly ever do."""
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", chunk)
    texts = [t for _, t, _ in rows][:25] + ["ÀB", "abC", "Abc", "日本語x", "日本語xyzß日本"]
    got, of = buckets(texts), {}
    for gram in sorted(set().union(*map(naive_grams, texts)), key=len):
        of[gram] = buckets([gram])[0] - set().union(*[of[g] for g in naive_grams(gram) - {gram}])
    for text, have in zip(texts, got):
        assert have == set().union(*[of[g] for g in naive_grams(text)])


def test_ratios_by_hand():
    ratio, tells = toxicity.ratios(np.array([8.0, 2, 0]), np.array([0.0, 2, 9]), 10, 20)
    assert ratio[0] == pytest.approx(np.log((9 / 12) / (1 / 22))) and ratio[2] == pytest.approx(np.log((1 / 12) / (10 / 22)))
    assert tells.argmax() == 0 and tells.argmin() == 1


def test_logistic_loss_is_least():
    rng = np.random.default_rng(2)
    x, weight = rng.normal(size=(300, 3)).astype(np.float32), rng.random(300)
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    w, b = toxicity.logistic(x, y, weight, 1e-2, steps=3000, rate=0.02)
    risk = lambda w, b: (weight / weight.sum() * np.log1p(np.exp(-(2 * y - 1) * (x @ w + b)))).sum() + 0.5e-2 * (w**2).sum()
    least = risk(w, b)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert risk(w + step * np.eye(3)[k], b) > least and risk(w, b + step) > least


def made_up(seed=4, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = k % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Zzgrub!", "pfuiqx", "zzgrubs"])
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_scores_of_held_out_rows(spark):
    rows = made_up()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    right = 0
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    for i, y in held:
        assert got[i].held_out and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3)
        right += got[i].predicted == y
    assert right >= 0.95 * len(held) and sum(r.held_out for r in got.values()) == len(held)


def test_held_out_labels_and_other_columns_are_not_read(spark):
    rows = made_up(n=120)
    docs = spark.createDataFrame([(*r[:2], "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    out = []
    for turn in (False, True):
        labels = [(i, 1 - y if turn and zlib.crc32(str(i).encode()) % 4 == 2 else y, k % 2 if turn else 0) for k, (i, _, y) in enumerate(rows)]
        frame = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
        out.append(sorted((r.doc_id, r.score) for r in toxicity.scored(docs.withColumn("lang", docs["source" if turn else "lang"]).repartition(3 + turn), frame).collect()))
    assert out[0] == out[1]


def test_nulls_ties_empty_tables_and_clashing_names(spark, docs, rows, empty):
    """docs holds null ids and texts, blanks, repeats and columns named like those made here; a null text scores like an empty one."""
    labels = spark.createDataFrame([*[(k, k % 3 == 0) for k in range(60)], (None, True), (5, None), (12, True), (12, False)], "doc_id long, t boolean").selectExpr("doc_id", "cast(t as int) as toxic", "1 as score", "'x' as text")
    out = toxicity.scored(docs, labels, keep=["source", "score", "rest"])
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "text", "source", "score", "rest"]
    got = out.toDF("doc_id", "held_out", "score", "predicted", "text", "source", "old", "rest").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    blank = {round(r.score, 12) for r in got if not r.text}
    assert len(blank) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    same = {}
    for r in got:
        assert same.setdefault(r.text, r.score) == r.score
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.99 for r in toxicity.scored(docs, labels.where("toxic = 1")).collect())
    assert toxicity.scored(empty, labels).count() == 0


def test_long_text_in_pieces_scores_like_one(spark, monkeypatch):
    place = np.full(toxicity.BUCKETS, -1)
    place[::7] = np.arange(len(place[::7]))
    text = "".join(random.Random(1).choice("abc déé") for _ in range(5000))
    whole = [m for _, _, m in toxicity.marks(pa.array([text, "x", text[:50]]), place, len(place[::7]))]
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 64)
    parts = [m for _, _, m in toxicity.marks(pa.array([text, "x", text[:50]]), place, len(place[::7]))]
    assert (np.concatenate(whole) == np.concatenate(parts)).all()
