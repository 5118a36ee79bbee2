"""Names that are alike, each put under the first head it resembles, without one task for a group."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import kept

#: Names of a group that are tried as heads in the first round; each later round tries twice as many.
HEADS, MOST_HEADS = 32, 2048


def alike(first: str, later: str, threshold: float) -> bool:
    return SequenceMatcher(None, first, later).ratio() >= threshold


def prefix(name: str, threshold: float) -> list[str]:
    """Characters with their occurrence numbers, of which names that are alike share one.

    Matching blocks hold no more than the characters two names have in common.  For a
    ratio of t these are l * t / (2 - t) of the l of either name at least, so the first
    l minus that plus one of the characters, in any order fixed for all, hold one in common.
    """
    seen: Counter[str] = Counter()
    marks = []
    for c in name:
        seen[c] += 1
        marks.append((-seen[c], c))  # later occurrences are rarer
    common = ceil(len(name) * threshold / (2 - threshold) - 1e-9)
    return [f"{c}{-k}" for k, c in sorted(marks)[: len(name) - common + 1]]


def greedy_heads(names: DataFrame, group: list[str], order: str, name: str, threshold: float) -> DataFrame:
    """For each name the head it belongs to: the first of the names before it, in order, that are heads and alike; else it is a head itself.

    names: group, order (distinct within a group), name.  Returns group, order, head.
    In each round the first open names of every group are settled among themselves;
    their heads then take the open names that are alike, which they meet by shared
    characters.  A group's names never gather in one task, but for those tried.
    """
    columns = [*group, order, name]
    types = ", ".join(f"`{c}` {names.schema[c].dataType.simpleString()}" for c in columns)
    as_prefix = F.pandas_udf(lambda s: s.map(lambda x: prefix(x, threshold)), "array<string>")
    same = F.pandas_udf(lambda a, b: pd.Series([alike(x, y, threshold) for x, y in zip(a, b)]), "boolean")
    kind = names.schema[order].dataType.simpleString()

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[str, int]] = []
        out = []
        for text, at in rows.sort_values(order)[[name, order]].itertuples(index=False):
            head = next((h for n, h in heads if alike(n, text, threshold)), None)
            if head is None:
                heads.append((text, at))
            out.append((text, at, at if head is None else head))
        found = pd.DataFrame(out, columns=[name, order, "head"])
        return found.assign(**{c: rows[c].iloc[0] for c in group})[[*columns, "head"]]

    open_, done, tried = kept(names.select(*columns)), None, HEADS
    while not open_.isEmpty():
        ranked = open_.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_r") <= tried).drop("_r")
        settled = kept(ranked.groupBy(*group).applyInPandas(settle, f"{types}, head {kind}"))
        heads = settled.where(F.col("head") == F.col(order)).select(*group, F.col(order).alias("head"), F.col(name).alias("_head"))
        rest = open_.join(settled.select(*group, order), [*group, order], "left_anti")
        marks = rest.select(*columns, F.explode(F.array_distinct(as_prefix(name))).alias("_mark"))
        pairs = marks.join(heads.select(*group, "head", "_head", F.explode(F.array_distinct(as_prefix("_head"))).alias("_mark")), [*group, "_mark"]).select(*columns, "head", "_head").distinct()
        taken = kept(pairs.where(same("_head", name)).groupBy(*group, order).agg(F.min("head").alias("head")))
        found = settled.select(*group, order, "head").union(taken)
        done = found if done is None else done.union(found)
        open_ = kept(rest.join(taken.select(*group, order), [*group, order], "left_anti"))
        tried = min(2 * tried, MOST_HEADS)
    return names.select(*group, order, F.col(order).alias("head")) if done is None else done
