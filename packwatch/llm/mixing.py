"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into blocks of equal size.  Blocks go to sources by the highest
quotient target / (2 * blocks so far + 1), and each source's blocks to its
shards by the same rule, which gives an integer quota for each shard.  Within a
shard, documents stand one after the other; a quota of q out of b blocks takes
every block q // b times and q % b of them, picked by a seeded permutation, once
more.  Only sums for each source and shard reach the driver or one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .tables import Kept

#: Documents in a shard on average.
SHARD_DOCS = 20_000


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess reshared by weight."""
    capped, left = set(), float(sum(sizes))
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        rest = left - sum(most * sizes[i] for i in capped)
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            return [float(most * sizes[i]) if i in capped else rest * weights[i] / weight for i in range(len(sizes))]
        capped |= set(over)


def sainte_lague(votes, seats: int, most=None) -> np.ndarray:
    """Seats by highest quotient votes / (2s + 1); ties go to the first; none gets more than ``most``."""
    votes = np.asarray(votes, dtype=float)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, dtype=np.int64)
    usable = np.where(votes > 0, most, 0)
    seats = int(min(seats, sum(int(x) for x in usable)))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    at = lambda d: np.minimum(np.floor(votes / d + 0.5), usable).astype(np.int64)
    low = high = max(votes.sum() / seats, 1e-300)
    while at(low).sum() < seats:
        low /= 2
    while at(high).sum() > seats:
        high *= 2
    for _ in range(100):
        d = (low + high) / 2
        low, high = (d, high) if at(d).sum() > seats else (low, d)
    out = at(high * (1 + 1e-9))  # a little too few, so that ties are left to the exact quotients
    while out.sum() < seats:
        quotient = np.where(out < usable, votes / (2 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
    return out


def _stride(blocks: int) -> int:
    """A step near the golden section of the blocks and prime to their number."""
    step = max(1, int(blocks * 0.6180339887))
    while math.gcd(step, blocks) != 1:
        step += 1
    return step


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: int = 3, block_words: int = 16, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document a mix of the sources takes.

    docs: any frame with an id, a text and a source; other columns are ignored.
    A document's size is its number of words between ASCII white space (null: 0).
    Sources in code point order, null last, have the weights in turn, repeating,
    and share all sizes by them; a target stops at ``most`` times its source's
    size and the excess is reshared by weight.
    Returns a row per document: doc_id, source, size, source_size, target (of the
    source), taken (words the mix takes, repeats counted, at most ``most`` times
    the size).  Equal input gives equal output; documents with the same id keep
    their own rows and are ordered by size.  Sources without words get nothing.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    sized = kept.keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")), "sized")

    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    goal = targets([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    blocks = [math.ceil(r.n / block_words) for r in rows]
    quota = sainte_lague(goal, round(sum(goal) / block_words), [most * b for b in blocks]).tolist()
    plan = spark.createDataFrame([(i, r.source, r.n, float(goal[i])) for i, r in enumerate(rows)], "number int, name string, source_size long, target double")
    n_shards = max(1, math.ceil(sum(r.docs for r in rows) / SHARD_DOCS))

    placed = sized.join(F.broadcast(plan) if len(rows) <= 100_000 else plan, sized["source"].eqNullSafe(plan["name"])).drop("name")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)).cast("int"))
    own = Window.partitionBy("number", "shard")
    upto = own.orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.sum("size").over(upto) - F.col("size"))

    def apportion(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        n = np.ceil(shards["words"].to_numpy() / block_words).astype(np.int64)
        q = sainte_lague(shards["words"], quota[int(shards["number"].iloc[0])], most * n)
        step = [_stride(max(1, int(x))) for x in n]
        first = [zlib.crc32(f"{seed}/{a}/{b}".encode()) for a, b in zip(shards["number"], shards["shard"])]
        return pd.DataFrame({"number": shards["number"], "shard": shards["shard"], "n_blocks": np.maximum(n, 1), "rounds": q // np.maximum(n, 1), "more": q % np.maximum(n, 1), "step": step, "first": first})

    sums = placed.groupBy("number", "shard").agg(F.sum("size").alias("words"))
    quotas = sums.groupBy("number").applyInPandas(apportion, "number int, shard int, n_blocks long, rounds long, more long, step long, first long")
    out = placed.join(quotas, ["number", "shard"])
    B = F.lit(block_words)
    end = F.col("start") + F.col("size")
    picked = lambda k: (k * F.col("step") + F.col("first")) % F.col("n_blocks") < F.col("more")
    part = lambda k: F.least(end, (k + 1) * B) - F.greatest(F.col("start"), k * B)
    hit = F.aggregate(
        F.sequence(F.floor(F.col("start") / B), F.floor((end - 1) / B)),
        F.lit(0).cast("long"),
        lambda total, k: total + F.when(picked(k), part(k)).otherwise(F.lit(0)).cast("long"),
    )
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("rounds") * F.col("size") + hit)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
