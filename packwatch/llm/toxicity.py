"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of characters, times the logarithm of
how much likelier toxic texts of the fitting rows hold it than others.  The n-grams
that tell the classes apart best get weights by logistic regression; scores of rows
that a fit hasn't seen turn them into chances.  Counting the n-grams is a Spark
aggregate with one row for each bucket, a fitting row reaches the driver as a bitmap
of the chosen n-grams, and scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import _BYTES, _Q, CHUNK_BYTES, LOWER, U64, Prefixes, chunks, mix, utf8

#: Labelled ids that the classifier is fitted on at most: toxic ones and others.
TOXIC, CLEAN = 3000, 6000
BUCKETS, GRAMS, FEATURES, FOLDS = 1 << 18, (3, 4, 5), 4096, 3
#: Bytes that a run of the longest n-gram takes at most.
_OVERLAP = 4 * max(GRAMS)


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of texts, then text (from 0 in the range) and bucket of each n-gram; A-Z lower-cased.

    A text above CHUNK_BYTES comes in several pieces of the same range, which between
    them hold every n-gram of it, so that memory doesn't grow with a text.
    """
    data, offsets = utf8(column)
    for i, j in chunks(offsets, CHUNK_BYTES):
        first, end = int(offsets[i]), int(offsets[j])
        for at in range(first, max(end, first + 1), CHUNK_BYTES if j == i + 1 else max(end - first, 1)):
            until = end if j > i + 1 else min(end, at + CHUNK_BYTES + _OVERLAP)
            part, own = LOWER[data[at:until]], np.clip(offsets[i : j + 1] - at, 0, until - at)
            starts = (part & 0xC0) != 0x80
            begins = offsets[i:j][(offsets[i:j] >= at) & (offsets[i:j] < until)] - at
            starts[begins] = True
            starts = np.flatnonzero(starts)
            text = np.searchsorted(own, starts, side="right") - 1
            ends = np.r_[starts, len(part)]
            prefixes = Prefixes(_BYTES[part], _Q)
            texts, buckets = [], []
            for n in GRAMS:
                k = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
                if until < end:  # what starts in the overlap comes with the next piece
                    k = k[starts[k] < CHUNK_BYTES]
                texts.append(text[k])
                buckets.append((mix(prefixes.runs(starts[k], ends[k + n]) + U64(n)) % U64(BUCKETS)).astype(np.int64))
            yield i, j, np.concatenate(texts), np.concatenate(buckets)


def marks(column: pa.Array, place: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Which of the chosen n-grams each text holds: range of texts and a matrix of booleans; place gives a bucket's column or -1."""
    for (i, j), pieces in groupby(grams(column), key=lambda piece: piece[:2]):
        held = np.zeros((j - i, size), dtype=bool)
        for _, _, text, bucket in pieces:
            at = place[bucket]
            held[text[at >= 0], at[at >= 0]] = True
        yield i, j, held


def distinct(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the text and bucket of each n-gram, once for each text."""
    for (i, _), pieces in groupby(grams(column), key=lambda piece: piece[:2]):
        once = np.zeros(0, np.int64)
        for _, _, text, bucket in pieces:
            once = np.union1d(once, text * BUCKETS + bucket)
        yield i + once // BUCKETS, once % BUCKETS


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each n-gram from the numbers of texts that hold it, and how well it tells the classes apart (squared difference of shares over its variance)."""
    p, q = (toxic + 1) / (n_toxic + 2), (clean + 1) / (n_clean + 2)
    share = (toxic + clean + 2) / (n_toxic + n_clean + 4)
    return np.log(p / q), (p - q) ** 2 / (share * (1 - share) * (1 / (n_toxic + 2) + 1 / (n_clean + 2)))


def scaled(held: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Presence times ratio, over the root of how many of the n-grams the text holds."""
    x = held.astype(np.float32)  # in place from here on: this is the driver's largest array
    x *= ratio.astype(np.float32)
    x /= np.sqrt(np.maximum(held.sum(1), 1)).astype(np.float32)[:, None]
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and offset of least weighted logistic loss plus ridge, by Adam."""
    d = x.shape[1]
    w, moment, square = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    weight = weight / weight.sum()
    base = np.clip((weight * y).sum(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(base / (1 - base))
    for step in range(1, steps + 1):
        z = x @ w[:-1].astype(np.float32) + w[-1]
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.r_[miss.astype(np.float32) @ x + ridge * w[:-1], miss.sum()]
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def is_held_out(doc_id: str) -> Column:
    """Whether crc32 of the id's text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Model:
    """A fitted classifier; ``score`` applies it to any documents."""

    def __init__(self, place: np.ndarray, weights: np.ndarray, offset: float):
        self.place, self.weights, self.offset = place, weights, offset

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TOXIC, clean: int = CLEAN, features: int = FEATURES, ridge: float = 1e-4) -> "Model":
        """Fits on at most ``toxic`` ids with label 1 and ``clean`` ids with label 0, chosen by a hash of the id.

        Rows that are held out, whose label is neither, or whose id is null are never
        read; an id with both labels counts as toxic; an id with several texts gives
        the least of them.  Classes weigh as often as they are labelled.
        """
        by_id = labels.where(~is_held_out(doc_id) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
        by_hash = F.xxhash64("id")
        chosen = by_id.where("y = 1").orderBy(by_hash, "id").limit(toxic).union(by_id.where("y = 0").orderBy(by_hash, "id").limit(clean))
        texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        # at most toxic + clean rows are broadcast
        sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
        totals = {r.y: r.n for r in by_id.groupBy("y").agg(F.count("*").alias("n")).collect()}

        def counted(batches):
            sums = np.zeros((2 * FOLDS, BUCKETS), dtype=np.int64)
            for batch in batches:
                group = batch.column("y").to_numpy(zero_copy_only=False) * FOLDS + batch.column("fold").to_numpy(zero_copy_only=False)
                for text, bucket in distinct(batch.column("text")):
                    sums += np.bincount(group[text] * BUCKETS + bucket, minlength=sums.size).reshape(sums.shape)
            some = np.flatnonzero(sums.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(s[some]) for s in sums]], ["bucket", *[f"n{k}" for k in range(2 * FOLDS)]])

        names = [f"n{k}" for k in range(2 * FOLDS)]
        table = sample.mapInArrow(counted, "bucket long, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most BUCKETS rows
        counts = np.zeros((2, FOLDS, BUCKETS))
        counts[:, :, table["bucket"].to_numpy(dtype=np.int64)] = table[names].to_numpy(dtype=float).T.reshape(2, FOLDS, -1)
        sizes = np.zeros((2, FOLDS))
        for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect():
            sizes[r.y, r.fold] = r.n
        if not sizes[1].sum() or not sizes[0].sum():
            return cls(np.full(BUCKETS, -1), np.zeros(1), 30.0 if sizes[1].sum() else -30.0 if sizes[0].sum() else 0.0)

        def best(without: int | None) -> tuple[np.ndarray, np.ndarray]:
            use = [k for k in range(FOLDS) if k != without]
            ratio, tells = ratios(counts[1][use].sum(0), counts[0][use].sum(0), sizes[1][use].sum(), sizes[0][use].sum())
            tells[counts[:, use].sum((0, 1)) == 0] = 0
            at = np.sort(np.argsort(-tells, kind="stable")[:features])
            return at, ratio[at]

        fits = {k: best(k) for k in [None, *range(FOLDS)]}
        union = np.unique(np.concatenate([at for at, _ in fits.values()]))
        place = np.full(BUCKETS, -1)
        place[union] = np.arange(len(union))

        def bitmaps(batches):
            for batch in batches:
                for i, j, held in marks(batch.column("text"), place, len(union)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(np.packbits(held, axis=1)), pa.list_(pa.uint8())).cast(pa.list_(pa.int16())), batch.column("y").slice(i, j - i), batch.column("fold").slice(i, j - i), batch.column("id").slice(i, j - i)], ["bits", "y", "fold", "id"])

        rows = sample.mapInArrow(bitmaps, "bits array<smallint>, y int, fold int, id long").toPandas().sort_values("id")
        held = np.unpackbits(np.stack(rows["bits"].to_numpy()).astype(np.uint8), axis=1)[:, : len(union)].astype(bool)
        y, fold = rows["y"].to_numpy(), rows["fold"].to_numpy()
        weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())

        def fit(without, use):
            at, ratio = fits[without]
            columns = np.searchsorted(union, at)
            w, b = logistic(scaled(held[np.ix_(use, columns)], ratio), y[use], weight[use], ridge)
            return columns, ratio, w, b

        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            use = np.flatnonzero(fold != k)
            if len(np.unique(y[use])) == 2:
                columns, ratio, w, b = fit(k, use)
                unseen[fold == k] = scaled(held[np.ix_(fold == k, columns)], ratio) @ w + b
        columns, ratio, w, b = fit(None, np.arange(len(y)))
        spread = max(float(unseen.std()), 1e-9)
        slope, shift = logistic((unseen / spread)[:, None].astype(np.float32), y, weight, 1e-4, steps=2000)  # of scores of rows that weren't fitted
        slope = max(float(slope[0]), 0.0) / spread
        place = np.full(BUCKETS, -1)
        place[union[columns]] = np.arange(len(columns))
        return cls(place, ratio * w * slope, float(b * slope + shift))

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """The rows with a column between 0 and 1; a null text counts as empty."""
        place, weights, offset = self.place, self.weights, self.offset

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts))
            for i, j, held in marks(texts, place, len(weights)):
                row, at = np.nonzero(held)
                total = np.bincount(row, weights=weights[at], minlength=j - i)  # summed in order, so that a score depends on its text alone
                out[i:j] = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(held.sum(1), 1)) + offset, -30, 30)))
            return pa.array(out)

        return docs.withColumn(name, scored(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Scores every document's whole text for toxicity.

    docs, labels: frames with a common id; labels has 1 for toxic texts and 0 for
    others in ``label``; other columns, language and source among them, are never read.
    Returns doc_id, held_out (crc32 of the id's text mod 4 is 2; false for a null id),
    score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold), text,
    and the columns in ``keep``.  Null and empty texts get the score of a text without
    n-grams; without labels every score is 0.5, with one label alone all are next to 0
    or 1; rows that share an id keep their own rows; an empty table gives an empty table.
    """
    model = Model.train(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep or []]).alias("rest"))
    out = model.score(rows)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "text", *[F.col(f"rest.`{c}`").alias(c) for c in keep or [] if c not in ("doc_id", "text")])
