"""Whole groups from sorted streams, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import Kept

#: Rounds within which components settle; a path of n nodes takes about the logarithm of n.
ROUNDS = 63


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups of a column by which the stream is sorted, with the bounds of each group."""
    held: list[pa.Table] = []
    n = 0

    def cut(last: bool):
        nonlocal held, n
        table = pa.concat_tables(held)
        keys = table[key].to_numpy()
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        if last:
            held, n = [], 0
            return table, bounds
        done = int(bounds[-2])
        held, n = [table.slice(done)], 0
        return table.slice(0, done), bounds[:-1]

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(pa.Table.from_batches([batch.slice(at, rows)]))
            n += held[-1].num_rows
            if n >= rows:
                table, bounds = cut(False)
                if table.num_rows:
                    yield table, bounds
    if held and sum(t.num_rows for t in held):
        yield cut(True)


def spanning(linked, size: int) -> list[tuple[int, int]]:
    """Links of a forest over rows 0..size-1; linked(i) gives the later rows that row i is linked with."""
    label, out = np.arange(size), []
    for i in range(size - 1):
        others = linked(i)
        labels, first = np.unique(label[others], return_index=True)
        for x, j in zip(labels.tolist(), others[first].tolist()):
            if x != label[i]:
                out.append((i, j))
                label[label == x] = label[i]
    return out


def components(links: DataFrame, kept: Kept, name: str) -> DataFrame:
    """node and root (the smallest node of its component) for every node of a frame of links (a, b).

    Alternates the large-star and small-star steps, whose rounds grow with the
    logarithm of the number of nodes; each round is a table in the shared folder.
    The minima are tables too, so that a join with them reads shuffles of its own,
    which Spark can split or replace by a broadcast where a node has very many links.
    Raises an error if ROUNDS rounds don't settle all components.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = kept.keep(now, f"{name}-0"), None
    for turn in range(1, ROUNDS + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = kept.keep(large, f"{name}-large")
        low = kept.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        joined = large.join(low, "a")
        small = joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()
        now = kept.keep(small, f"{name}-{turn}")
        kept.drop(f"{name}-{turn - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components of {name} aren't settled after {ROUNDS} rounds")
    for left in ("least", "large", "low"):
        kept.drop(f"{name}-{left}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
