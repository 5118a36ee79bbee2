"""Compressing vectors to short codes: each of four parts gets the nearest of 256 codebook entries.

All arithmetic is on integers, so codes and codebooks are the same on any machine
and for any split of the rows.  The entries of a part position stand in a ball tree;
a search visits the nearer ball first and leaves a ball out only if its lower bound,
rounded down, is above the best distance.  Each round is one pass over the vectors
that sends sums per entry, not vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import Kept

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 4, 256, 4, 1024, 16
#: Beyond the rounding errors of a square root of an integer below 2**53 and of a difference.
_SLACK = 2.0**-40


class Balls:
    """A ball tree over the rows of an integer matrix.

    Every node has an integer centre and a radius that is rounded up; leaves hold at
    most LEAF rows, in ascending order.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, rows: np.ndarray) -> dict:
        own = self.entries[rows]
        centre = own.sum(0) // len(rows)
        radius = np.sqrt(((own - centre) ** 2).sum(1).max()) * (1 + _SLACK)
        node = {"centre": centre, "radius": radius, "rows": rows, "below": ()}
        spread = own.max(0) - own.min(0) if own.shape[1] else np.zeros(0)
        if len(rows) > LEAF and spread.size and spread.max() > 0:
            order = np.argsort(own[:, int(spread.argmax())], kind="stable")
            half = len(rows) // 2
            node["below"] = tuple(self._node(np.sort(rows[part])) for part in (order[:half], order[half:]))
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest entry for each query (the lowest of equally near ones) and the squared distance, as integers."""
        n = len(queries)
        index, best = np.full(n, len(self.entries)), np.full(n, np.iinfo(np.int64).max)
        floats = queries.astype(float)
        norms = (queries * queries).sum(1)

        def least(node: dict, at: np.ndarray) -> np.ndarray:
            """Lower bound of the distance to anything in a ball, rounded down."""
            away = queries[at] - node["centre"]
            return np.sqrt((away * away).sum(1).astype(float)) * (1 - _SLACK) - node["radius"]

        def visit(node: dict, at: np.ndarray) -> None:
            if not node["below"]:
                rows = node["rows"]
                entries = self.entries[rows]
                # below 2**53 (checked by ``compress``) the products are integers that doubles hold exactly
                d = norms[at, None] - 2 * (floats[at] @ entries.T.astype(float)).astype(np.int64) + (entries * entries).sum(1)
                k = d.argmin(1)  # the first of equal ones: rows ascend
                found, of = d[np.arange(len(at)), k], rows[k]
                better = (found < best[at]) | ((found == best[at]) & (of < index[at]))
                best[at[better]], index[at[better]] = found[better], of[better]
                return
            a, b = node["below"]
            to_a, to_b = least(a, at), least(b, at)
            a_first = to_a <= to_b
            for near, far, bound, these in ((a, b, to_b, a_first), (b, a, to_a, ~a_first)):
                if these.any():
                    mine, bound = at[these], bound[these]
                    open_ = (to_a if near is a else to_b)[these] <= self._reach(best[mine])
                    if open_.any():
                        visit(near, mine[open_])
                    open_ = bound <= self._reach(best[mine])
                    if open_.any():
                        visit(far, mine[open_])

        if n:
            visit(self.root, np.arange(n))
        return index, best

    @staticmethod
    def _reach(best: np.ndarray) -> np.ndarray:
        """The best distances, rounded up; a ball at just that distance may hold a tie and is visited."""
        return np.sqrt(best.astype(float)) * (1 + _SLACK)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component; shorter vectors are filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def is_whole(vector: Column) -> Column:
    """Whether a vector is neither null nor holds a null, NaN or infinite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


class Codes:
    """Codebooks of all part positions: ``entries[part]`` is a matrix of integers."""

    def __init__(self, entries: list[np.ndarray], width: int):
        self.entries, self.width = entries, width

    def sha256(self) -> str:
        """Hash of all entries' components as decimal text, by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def coded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Each batch with its integer vectors, the entries of their parts and the squared distances."""
        trees, size = [], self.width // PARTS
        for batch in batches:
            trees = trees or [Balls(e) for e in self.entries]
            x = integers(batch.column("x"), self.width)
            found = [tree.nearest(x[:, k * size : (k + 1) * size]) for k, tree in enumerate(trees)]
            yield batch, x, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)

    def moved(self, vectors: DataFrame) -> "Codes":
        """The codebooks after one round: every entry becomes the mean, rounded down, of the parts it is nearest to; unused ones stay."""
        size, shapes = self.width // PARTS, [len(e) for e in self.entries]

        def sums(batches):
            total = [np.zeros((n, size + 1), dtype=np.int64) for n in shapes]
            for _, x, index, _ in self.coded(batches):
                for k in range(PARTS):
                    part = np.c_[x[:, k * size : (k + 1) * size], np.ones(len(x), np.int64)]
                    order = np.argsort(index[:, k], kind="stable")
                    at, first = np.unique(index[order, k], return_index=True)
                    if len(at):
                        total[k][at] += np.add.reduceat(part[order], first, axis=0)
            for k in range(PARTS):
                used, place = np.flatnonzero(total[k][:, -1]), np.arange(size + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used) * (size + 1), k)), pa.array(np.repeat(used, size + 1)), pa.array(np.tile(place, len(used))), pa.array(total[k][used].ravel())], ["part", "entry", "place", "total"])

        rows = vectors.mapInArrow(sums, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toPandas()  # at most a row for each component of the codebooks and each entry
        out = []
        for k, before in enumerate(self.entries):
            own, total = rows[rows["part"] == k], np.zeros((len(before), size + 1), dtype=np.int64)
            total[own["entry"].to_numpy(np.int64), own["place"].to_numpy(np.int64)] = own["total"].to_numpy(np.int64)
            count = total[:, -1:]
            out.append(np.where(count > 0, total[:, :-1] // np.maximum(count, 1), before))
        return Codes(out, self.width)


def compress(embeddings: DataFrame, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of all vectors, with their errors.

    Rows whose vector is null or holds a null, NaN or infinite component are left
    out.  Components become floor(1024 * x); vectors are cut in four parts, shorter
    ones filled up with 0 to the longest, that to a multiple of four.  The codebooks
    start as the parts of the 256 rows with the smallest ids (null last; rows of one
    id by their vectors; all rows if fewer) and move ``rounds`` times.
    Returns vec_id, code (two hex digits a part), error (squared distances summed over
    the parts), label_error (errors summed over equal labels, nulls together),
    codebooks_sha256, label.  Repeated rows keep their own rows; other columns aren't
    read; an empty table gives an empty table.  Components of 2**16 and more in vectors
    of 64 are an error (the bound falls with the root of the width), as sums might no
    longer be exact.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("x")).where(is_whole(F.col("x")))
    kinds = dict(vectors.dtypes)
    bounds = vectors.agg(F.max(F.size("x")).alias("width"), F.max(F.abs(F.array_max("x"))).alias("most"), F.max(F.abs(F.array_min("x"))).alias("least")).first()
    width = -(-(bounds["width"] or 0) // PARTS) * PARTS
    most = SCALE * max(bounds["most"] or 0, bounds["least"] or 0) + 1
    if 4 * most**2 * max(width // PARTS, 1) >= 2**53:
        raise ValueError(f"components up to {most / SCALE:g} in vectors of {width} are beyond exact sums")
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).toArrow()  # ENTRIES vectors at most
    x = integers(first["x"], width)
    size = width // PARTS
    codes = Codes([x[:, k * size : (k + 1) * size] for k in range(PARTS)], width)
    for _ in range(rounds if len(x) else 0):
        codes = codes.moved(vectors.select("x"))

    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def coded(batches):
        for batch, _, index, d in codes.coded(batches):
            text = digits[index[:, 0]]
            for k in range(1, PARTS):
                text = np.char.add(text, digits[index[:, k]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(d.sum(1))], ["id", "label", "code", "error"])

    kept = Kept(spark)
    rows = kept.keep(vectors.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    # a table, so that a join with it can be split where a label has very many rows
    by_label = kept.keep(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels").withColumnRenamed("label", "of")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"), "label")
