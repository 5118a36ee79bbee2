"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text fit a logistic score that minimises the
non-negative unbiased risk  pi * R+(positives) + max(0, R-(unlabelled) - pi *
R-(positives)),  with a share pi of positives that is estimated from these two kinds
of rows alone: among texts that rank above a threshold, positives are so many times
rarer in unlabelled text as their share says, and the purest threshold tells it.
Labels other than trusted positives are never read.  Features are shapes of
the whole text (how words repeat, cases, symbols, punctuation, lines), cut into
bins whose edges come from the fitting rows; the weights are a small table, and
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U64, hashed_words
from .minhash_dedup import shingle_sets

#: Rows that the classifier is fitted on at most, of each kind.
POSITIVES, UNLABELLED = 10_000, 20_000
NAMES = ["words", "word_length", "distinct_words", "repeated_next", "upper", "digits", "symbols", "exclamations", "bars", "stops", "lines", "distinct_lines", "longest_word", "non_ascii", "distinct_triples"]
_CLASSES = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"upper": range(65, 91), "letters": [*range(65, 91), *range(97, 123), *range(128, 256)], "digits": range(48, 58), "symbols": b"#*$%&|<>{}[]\\^~=+_@", "exclamations": b"!?", "bars": b"|", "stops": b".,;:", "lines": b"\n", "non_ascii": range(128, 256)}.items()}


def shapes(column: pa.Array):
    """The features of each text, for bounded runs of texts; all are 0 for an empty text."""
    for i, j, data, offsets, w in hashed_words(column):
        out = np.zeros((j - i, len(NAMES)))
        n, size = np.maximum(w.count, 1), np.maximum(np.diff(offsets), 1)

        def count(name):
            sums = np.r_[0, np.cumsum(_CLASSES[name][data])]
            return sums[offsets[1:]] - sums[offsets[:-1]]

        def per_text(text, values=None):
            return np.bincount(text, weights=values, minlength=j - i)[: j - i]

        length = (w.end - w.start).astype(float)
        same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        triples = np.maximum(w.count - 2, 1)
        lines = count("lines") + 1
        firsts = np.r_[0, np.flatnonzero(data == 10) + 1] if len(data) else np.zeros(0, np.int64)
        values = {
            "words": np.log1p(w.count),
            "word_length": per_text(w.text, length) / n,
            "distinct_words": per_text(shingle_sets(w, 1)[0]) / n,
            "repeated_next": per_text(w.text[1:][same]) / n,
            "upper": count("upper") / np.maximum(count("letters"), 1),
            "digits": count("digits") / size,
            "symbols": count("symbols") / n,
            "exclamations": count("exclamations") / n,
            "bars": count("bars") / n,
            "stops": count("stops") / n,
            "lines": np.log1p(w.count / lines),
            "distinct_lines": _distinct_lines(data, offsets, firsts) / lines,
            "longest_word": np.zeros(j - i),
            "non_ascii": count("non_ascii") / size,
            "distinct_triples": np.minimum(1, per_text(shingle_sets(w, 3)[0]) / triples),
        }
        some = np.flatnonzero(w.count)
        if len(some):
            values["longest_word"][some] = np.log1p(np.maximum.reduceat(length, w.bounds[some]))
        for k, name in enumerate(NAMES):
            out[:, k] = np.where(w.count > 0, values[name], 0)
        yield i, j, out


def _distinct_lines(data: np.ndarray, offsets: np.ndarray, after_breaks: np.ndarray) -> np.ndarray:
    from .kernels import _BYTES, _P, _runs

    start = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], after_breaks[np.searchsorted(offsets, after_breaks, side="right") - 1 >= 0]])
    start = start[start < len(data)]
    end = np.r_[start[1:], len(data)]
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(data) else end
    text = np.searchsorted(offsets, start, side="right") - 1
    h = _runs(_BYTES[data], start, end, _P)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(text[new], minlength=len(offsets) - 1)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column numbers of the bins that each row falls in."""
    first = np.cumsum([0, *[len(e) + 1 for e in edges[:-1]]])
    return np.stack([np.searchsorted(e, x[:, k], side="right") + first[k] for k, e in enumerate(edges)], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 16, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Bin edges, weights and offset that minimise the non-negative risk, by Adam.

    The loss of a score z is 1 / (1 + exp(z)) for a positive and 1 / (1 + exp(-z)) for
    a negative.  It is bounded, so an error of the prior counts for no more than itself;
    with the logarithm as loss, sure positives would multiply it.
    """
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(both.shape[1])]
    size = sum(len(e) + 1 for e in edges)
    bp, bu = binned(positive, edges), binned(unlabelled, edges)
    w, moment, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def pulled(rows, by):
        return np.r_[np.bincount(rows.ravel(), weights=np.repeat(by, rows.shape[1]), minlength=size), by.sum()]

    for step in range(1, steps + 1):
        sp, su = sigmoid(w[bp].sum(1) + w[-1]), sigmoid(w[bu].sum(1) + w[-1])
        of_p = pulled(bp, sp * (1 - sp) / len(sp))
        negative = su.mean() - prior * sp.mean()
        grad_negative = pulled(bu, su * (1 - su) / len(su)) - prior * of_p
        grad = grad_negative - prior * of_p if negative >= 0 else -grad_negative
        grad[:-1] += ridge * w[:-1]
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return edges, w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5, rounds: int = 2, doubt: float = 0.1, **fitting) -> float:
    """Share of positives in unlabelled rows.

    Each fold is ranked by a score fitted on the others.  Of the rows above a
    threshold, the share among unlabelled rows over the share among positives is an
    upper bound of the prior, and a tight one where negatives are rare; of all
    thresholds the one counts whose bound, with the doubt of shares of so few rows
    added, is the least.  Scores of a round are fitted with the prior of the one before.
    """
    prior = 0.5
    for _ in range(rounds):
        prior = _bound(positive, unlabelled, prior, folds, doubt, **fitting)
    return prior


def _bound(positive: np.ndarray, unlabelled: np.ndarray, prior: float, folds: int, doubt: float, **fitting) -> float:
    p, u = np.arange(len(positive)) % folds, np.arange(len(unlabelled)) % folds
    zp, zu = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(folds):
        if not (p != k).any() or not (u != k).any():
            continue
        edges, w, b = fit(positive[p != k], unlabelled[u != k], prior, **fitting)
        zp[p == k] = w[binned(positive[p == k], edges)].sum(1) + b
        zu[u == k] = w[binned(unlabelled[u == k], edges)].sum(1) + b
    at = np.unique(np.r_[zp, zu])
    above = lambda z: 1 - np.searchsorted(np.sort(z), at, side="left") / len(z)
    of_p, of_u = above(zp), above(zu)
    wide = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    use = of_p > 0
    best = int(np.argmin((of_u[use] + wide) / of_p[use]))
    return float(np.clip(of_u[use][best] / of_p[use][best], 0.01, 0.99))


def is_held_out(doc_id: str):
    """Whether crc32 of the id's text mod 5 is 0; true for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) == 0


class Model:
    """A fitted classifier; ``score`` applies it to any documents."""

    def __init__(self, edges, weights, offset, prior):
        self.edges, self.weights, self.offset, self.prior = edges, weights, offset, prior

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> "Model":
        """Fits on at most ``positives`` trusted ids (label 1) and ``unlabelled`` ids of any kind, chosen by a hash of the id.

        An id with several rows gives one, so at most positives + unlabelled rows of
        features reach the driver.  Labels of held-out ids (crc32 of the id mod 5 = 0)
        are not read, nor are labels other than 1.
        """
        ids = lambda rows: rows.where(~is_held_out(doc_id)).select(F.col(doc_id).cast("long").alias("id")).distinct()
        by_hash = F.xxhash64("id")
        chosen = ids(labels.where(F.col(label) == 1)).orderBy(by_hash).limit(positives).select("id", F.lit(1).alias("role"))
        rest = ids(docs).orderBy(by_hash).limit(unlabelled).select("id", F.lit(0).alias("role"))
        roles = chosen.union(rest).groupBy("id").agg(F.max("role").alias("positive"), F.min("role").alias("least"))  # at most positives + unlabelled rows
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(roles), "id")

        def features(batches):
            for batch in batches:
                for i, j, x in shapes(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64())), batch.column("positive").slice(i, j - i), batch.column("least").slice(i, j - i)], ["id", "x", "positive", "least"])

        one = F.min(F.struct("x", "positive", "least")).alias("r")
        table = rows.mapInArrow(features, "id long, x array<double>, positive int, least int").groupBy("id").agg(one).select("r.*").toPandas()
        x = np.stack(table["x"].to_numpy()) if len(table) else np.zeros((0, len(NAMES)))
        of = np.lexsort(x.T)  # rows come in any order
        x, table = x[of], table.iloc[of]
        trusted, web = x[table["positive"].to_numpy() == 1], x[table["least"].to_numpy() == 0]
        if not len(trusted) or not len(web):
            return cls([np.zeros(0)] * len(NAMES), np.zeros(len(NAMES)), 0.0, 0.5)
        prior = estimate_prior(trusted, web, steps=200)
        return cls(*fit(trusted, web, prior), prior)

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """The rows with a column between 0 and 1; a null text counts as empty."""
        edges, weights, offset = self.edges, self.weights, self.offset

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts))
            for i, j, x in shapes(texts):
                out[i:j] = 1 / (1 + np.exp(-np.clip(weights[binned(x, edges)].sum(1) + offset, -30, 30)))
            return pa.array(out)

        return docs.withColumn(name, scored(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Scores every document's whole text for quality.

    docs, labels: frames with a common id; labels has 1 in ``label`` for trusted
    positives (other values, nulls and other columns are ignored; an id counts once).
    Returns doc_id, held_out (crc32 of the id's text mod 5 is 0; true for a null
    id), score (0 to 1, higher: label 1 likelier), predicted (1 if score >=
    threshold), and the columns in ``keep``.  Null and empty texts are scored like
    any other; without positives every score is 0.5; rows that share an id keep their
    own rows; an empty table gives an empty table.
    """
    model = Model.train(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep or []]).alias("rest"))
    out = model.score(rows)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "text", *[F.col(f"rest.`{c}`").alias(c) for c in keep or [] if c not in ("doc_id", "text")])
