"""MinHash near-dedup by a signature-coordinate inverted join.

Texts with the same shingle set are one class, so copies cost nothing further.
Each class has a signature of COORDINATES minima.  Classes are posted under
their (coordinate, value) pairs; a pair of classes collides once for each list
they share, and a pair as similar as the threshold collides ``least_matches``
times but for a chance of under MISS.

Prefix: values that one class alone has can't collide.  Of a class with m other
values, ordered from the rarest, any partner with t collisions shares one of
the first m-t+1; only these are posted, and a class with m < t nowhere.
Skip: the other lists are not read.  A class has one value for each coordinate, so a
pair's postings meet in a list exactly once for each coordinate on which their
signatures agree; a pair that meets in a prefix list therefore has its collisions
counted by comparing the two signatures, which stand for all the lists it skips.

Long lists are cut into blocks, each pair of blocks is one bounded task, and
only links that join parts of a list are passed on; so groups of thousands of
variants yield no table of all their pairs.  The resulting coarse groups hold
every pair that can be linked; inside them the links are confirmed on full
shingle sets, again block by block, and components are built from these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .groups import components, spanning, whole_groups
from .kernels import U64, Words, chunks, hashed_words, mix, utf8
from .tables import Kept

COORDINATES, MISS = 64, 1e-6
LIST_BLOCK, TEXT_BLOCK = 512, 128
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def least_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest t such that a pair at the threshold has fewer than t equal coordinates with a chance of at most ``miss``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash), sorted; a text of fewer words has its whole sequence as one."""
    at, h = w.windows(size)
    texts, hashes = [w.text[at]], [h]
    for k in range(1, size):
        if (short := np.flatnonzero(w.count == k)).size:
            at, h = w.windows(k)
            own = np.searchsorted(at, w.bounds[short])
            texts.append(short)
            hashes.append(h[own])
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def _nodes(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identity of each set: two hashes of 64 bits that know nothing of each other."""
    lanes = [np.add.reduceat(mix(h + U64(seed)), first) if len(first) else np.zeros(0, np.uint64) for seed in (0x51ED27, 0xA3C59AC2F1)]
    return tuple(mix(total + n.astype(np.uint64)).view(np.int64) for total in lanes)


def _signed(batches, size: int):
    for batch in batches:
        for i, j, _, _, w in hashed_words(batch.column("text"), lower=True):
            text, h = shingle_sets(w, size)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
            have, n = text[first], np.diff(np.r_[first, len(text)])
            sig = np.empty((len(first), COORDINATES), dtype=np.uint32)
            if len(first):
                low = h.astype(np.uint32)
                for k in range(COORDINATES):
                    sig[:, k] = np.minimum.reduceat(low * _A[k] + _B[k], first)
            count = np.zeros(j - i, dtype=np.int64)
            count[have] = n
            node, check = np.zeros((2, j - i), dtype=np.int64)
            node[have], check[have] = _nodes(h, first, n)
            blobs = np.full(j - i, None, dtype=object)
            blobs[have] = [x.tobytes() for x in sig]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i), pa.array(count), pa.array(node, mask=count == 0), pa.array(check, mask=count == 0), pa.array(blobs.tolist(), pa.binary())], ["doc_id", "row_key", "n_shingles", "node", "check", "sig"])


def _posted(batches):
    """A row for each coordinate of each class."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token = mix(sig.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << U64(32))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), COORDINATES))], ["token", "node"])


def _collide(batches, least: int):
    """Links between classes of one list (or pair of blocks) with enough equal coordinates."""
    for table, bounds in whole_groups(batches, "key", 8192):
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        node = table["node"].to_numpy()
        a, b = [], []
        sizes = np.diff(bounds)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
            rows = bounds[:-1][sizes == size][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            left, right = rows[:, i].ravel(), rows[:, j].ravel()
            for k in range(0, len(left), 65536):
                x, y = left[k : k + 65536], right[k : k + 65536]
                ok = (sig[x] == sig[y]).sum(1) >= least
                a.append(x[ok])
                b.append(y[ok])
        for g in np.flatnonzero(sizes > 32):
            own = sig[bounds[g] : bounds[g + 1]]
            pairs = spanning(lambda i: i + 1 + np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= least), len(own))
            a.append(np.array([p[0] for p in pairs], dtype=np.int64) + bounds[g])
            b.append(np.array([p[1] for p in pairs], dtype=np.int64) + bounds[g])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _confirmed(batches, size: int, percent: int):
    """Links between classes of one coarse group (or pair of blocks) on their full sets."""
    for table, bounds in whole_groups(batches, "key", 256):
        sets: list[np.ndarray] = []
        own: list[np.ndarray] = []
        for i, j, _, _, w in hashed_words(table["text"], lower=True):
            text, h = shingle_sets(w, size)
            cut = np.searchsorted(text, np.arange(j - i + 1))
            first = cut[:-1][np.diff(cut) > 0]
            found = np.zeros((2, j - i), dtype=np.int64)
            found[:, np.diff(cut) > 0] = _nodes(h, first, np.diff(cut)[np.diff(cut) > 0])
            own.append(found)
            sets += [h[cut[k] : cut[k + 1]] for k in range(j - i)]
        ids, said = table["node"].to_numpy(), np.concatenate(own, axis=1)
        fits = (said[0] == table["hash"].to_numpy()) & (said[1] == table["check"].to_numpy())
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            rows = [r for r in range(lo, hi) if fits[r]]  # another row may have the same key
            rows = [rows[k] for k in np.unique(ids[rows], return_index=True)[1]] if rows else rows
            if len(rows) < 2:
                continue
            n = np.array([len(sets[r]) for r in rows])
            both = _intersections([sets[r] for r in rows])
            linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            for i, j in spanning(lambda i: i + 1 + np.flatnonzero(linked[i, i + 1 :]), len(rows)):
                a.append(ids[rows[i]])
                b.append(ids[rows[j]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _block_pairs(frame: DataFrame, count: str, most: int, *group: str) -> DataFrame:
    """A copy of each row for each pair of blocks of its group that it is part of; one, where the group is one block."""
    n = F.ceil(F.col(count) / most).cast("int")
    return (
        frame.withColumn("n_blocks", n)
        .withColumn("own_block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("key", F.xxhash64(*group, F.least("own_block", "other_block"), F.greatest("own_block", "other_block")))
        .drop("n_blocks", "own_block", "other_block")
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by near-equal sets of word shingles.

    docs: any frame with an integer id and a text; other columns are ignored.
    A document's set holds its distinct runs of ``shingle`` words (lower-cased A-Z,
    split at ASCII white space), or its whole sequence if it has fewer words.
    Documents with 100 * |both| >= percent * |either| are linked.
    Returns doc_id, n_shingles, component_id (the smallest id reachable, its own
    included), kept (doc_id equals component_id), component (an opaque key of the
    component; null without words), row_key (a hash of id and text).  A text that is null, empty or blank has an
    empty set and stays alone.  A null id is larger than all others; a component
    of nulls alone has a null component_id, equal to its doc_ids.  Rows that
    share an id are told apart by their sets.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kept, least = Kept(spark), least_matches(percent / 100)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.withColumn("row_key", _row_key(doc_id="doc_id", text="text"))
    signed = kept.keep(keyed.mapInArrow(lambda b: _signed(b, shingle), "doc_id long, row_key long, n_shingles long, node long, check long, sig binary"), "signed")
    one = lambda frame: frame.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "hash", "check")).alias("first"), F.first("sig").alias("sig"), (F.min("check") < F.max("check")).alias("mixed"))
    signed = signed.withColumn("hash", F.col("node"))
    classes = kept.keep(one(signed), "classes")
    if classes.where("mixed").take(1):  # sets of one hash that the other tells apart: all but one get a node of their own
        least_check = signed.groupBy("node").agg(F.min("check").alias("m"), F.max("check").alias("most")).where("m < most").drop("most")
        apart = F.when(F.col("check") > F.col("m"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        signed = kept.keep(signed.join(least_check, "node", "left").withColumn("node", apart).drop("m"), "told-apart")
        classes = kept.keep(one(signed), "classes")
    classes = classes.select("node", "sig", "first.*")

    posted = classes.select("sig", "node").mapInArrow(_posted, "token long, node long")
    lists = posted.groupBy("token").count().where("count > 1")
    shared = posted.join(lists, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("values"))
    prefix = (
        shared.where(F.size("values") >= least)
        .select("node", F.explode(F.slice("values", F.lit(1), F.size("values") - least + 1)).alias("value"))
        .select("node", "value.token", "value.count")
        .join(classes.select("node", "sig"), "node")
    )
    met = _block_pairs(prefix, "count", LIST_BLOCK, "token").select("key", "node", "sig")
    collided = met.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _collide(b, least), "a long, b long")
    coarse = kept.keep(components(collided, kept, "coarse"), "groups")

    sized = coarse.join(coarse.groupBy("root").agg(F.count("*").alias("count")), "root")
    members = _block_pairs(sized, "count", TEXT_BLOCK, "root").join(classes.select("node", "row_key", "hash", "check"), "node").select("key", "node", "row_key", "hash", "check")
    texts = keyed.select("row_key", "text").join(members, "row_key").select("key", "node", "hash", "check", "text")
    links = texts.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: _confirmed(b, shingle, percent), "a long, b long")
    roots = components(links, kept, "exact")

    named = classes.select("node", "doc_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "doc_id")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.select("node", "component").join(smallest, "component")
    out = signed.select("doc_id", "row_key", "n_shingles", "node").join(of_class, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"), "component", "row_key")


def _row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near dedup keeps: of each component the one of the smallest id, and every text without words.

    Of rows with equal id and text one stays; of a component's rows that share its
    smallest id the one with the smallest key.  A row without an id stays only where
    its component has none with one.  All columns of docs come back, whatever their
    names; null and empty texts stay; an empty table gives an empty table.
    """
    name = "key"
    while name in docs.columns:
        name += "_"
    found = near_duplicates(docs, shingle, percent, doc_id, text)
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best")).select(F.col("best.row_key").alias(name))
    keys = best.union(found.where("component is null").select(F.col("row_key").alias(name)))
    return docs.withColumn(name, _row_key(doc_id, text)).join(keys, name, "left_semi").dropDuplicates([name]).drop(name)
