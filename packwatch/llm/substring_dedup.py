"""Substring dedup by fixed-block anchors.

Every run of 2B-1 words holds one whole block of B words that starts at a
multiple of B, so a passage of ``window`` words that also stands elsewhere is
found by indexing only the non-overlapping blocks and probing the index with
every rolling window of B words.  Hits are then extended to maximal exact
repeats: every passage around a hit is compared as a whole and overlapping
repeats run together.

Documents are dealt to slices: ranges of doc_id of about SLICE_BYTES of text.
What a slice sends is packed, one row for each slice and index part, holding
each distinct hash once; so neither windows nor copies become rows, and a
passage that stands in a third of all documents costs one entry a slice.

1. probe: blocks and rolling windows of each slice, by hash to index parts;
2. index: a hash that belongs to a block somewhere and stands twice is a hit;
3. extend: each slice hashes the passages around its hits, again to parts;
4. first: per passage the earliest slice keeps it, later slices get it back;
5. each slice marks passages seen in an earlier slice or earlier in itself.

The texts are shuffled once; the three passes over them read the same exchange.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .kernels import U64, Words, covered, hashed_words, member

#: Text in one slice and in the windows that meet in one index part.
SLICE_BYTES, PART_BYTES = 4 << 20, 8 << 20
_BLOB = "part int, slice int, blob binary"


#: Ranges of ids whose bytes are counted, and ids drawn to bound them; both reach the driver, at any size of the input.
RANGES, DRAWN = 4096, 65_536


def slice_bounds(docs: DataFrame, doc_id: str, text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Bytes of all texts; and, in order, ranges of ids: first id, last id, number of their first slice, slices in them.

    Ranges of about equal numbers of ids come from ids drawn by their hash; the bytes
    of each say into how many slices of equal steps of the id it is cut.  Results
    don't depend on the bounds, only the sizes of slices do.
    """
    ids = F.col(doc_id).cast("long")
    size, rows, least, most = docs.agg(F.sum(F.octet_length(text)), F.count(doc_id), F.min(ids), F.max(ids)).first()
    size, least, most = size or 0, least or 0, most or 0
    if size <= SLICE_BYTES:
        return size, [(least, most, 0, 1)]
    drawn = docs.select(ids.alias("id")).where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // DRAWN))) == 0).distinct()
    drawn = np.sort(np.array([r.id for r in drawn.collect() if r.id is not None], dtype=np.int64))
    n = min(RANGES, math.ceil(size / SLICE_BYTES))
    edges = np.unique(np.r_[least, drawn[(np.arange(1, n) * len(drawn)) // n] if len(drawn) else []]).astype(np.int64)
    in_range = _in_range(edges)
    bytes_of = {r.range: r.bytes or 0 for r in docs.groupBy(in_range(ids).alias("range")).agg(F.sum(F.octet_length(text)).alias("bytes")).collect()}
    out, number = [], 0
    for k, first in enumerate(edges.tolist()):
        last = int(edges[k + 1]) - 1 if k + 1 < len(edges) else most
        slices = min(max(1, math.ceil(bytes_of.get(k, 0) / SLICE_BYTES)), last - first + 1)
        out.append((first, last, number, slices))
        number += slices
    return size, out


def _in_range(edges: np.ndarray):
    @F.pandas_udf("int")
    def in_range(ids: pd.Series) -> pd.Series:
        return pd.Series((np.maximum(np.searchsorted(edges, ids.fillna(edges[0]).to_numpy(dtype="int64"), side="right"), 1) - 1).astype("int32"))

    return in_range


def sliced(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> tuple[DataFrame, int]:
    """slice, doc_id, text and the struct rest of the kept columns of each row; and the number of index parts.

    Slices follow the ids; rows without an id are in the first one.
    """
    size, ranges = slice_bounds(docs, doc_id, text)
    first, last, number, slices = (np.array(x, dtype=np.int64) for x in zip(*ranges))

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(first[0]).to_numpy(dtype="int64")
        k = np.maximum(np.searchsorted(first, known, side="right"), 1) - 1
        step = (known - first[k]) / (last[k].astype(float) - first[k] + 1)  # rises with the id
        return pd.Series((number[k] + np.minimum((step * slices[k]).astype(np.int64), slices[k] - 1)).astype("int32"))

    rest = F.struct(F.lit(None).cast("int").alias("_"), *[F.col(c) for c in keep])
    rest = rest.cast(docs.select(rest.alias("rest")).schema["rest"].dataType.simpleString())  # all fields may be null
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), rest.alias("rest"))
    return rows.select(slice_of("doc_id").alias("slice"), "*"), max(1, math.ceil(size / PART_BYTES))


def _ordered(table: pa.Table) -> pa.Table:
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def _packed(keys: np.ndarray, parts: np.ndarray, slice_: int, n_parts: int) -> pa.Table:
    """keys sorted by part, cut into a row for each part that has any."""
    cut = np.r_[_runs(parts), len(parts)]
    return pa.table({"part": pa.array(parts[cut[:-1]], pa.int32()), "slice": pa.array([slice_] * (len(cut) - 1), pa.int32()), "blob": pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _fingerprint(h: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Index part, and 30 bits within it: enough to find candidates, which are compared in full later."""
    return ((h >> U64(34)) % U64(n_parts)).astype(np.int64), (h & U64(0x3FFFFFFF)).astype(np.uint32)


def _blobs(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(x.as_py(), dtype) for x in table["blob"]]
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype), np.array([len(a) for a in arrays], dtype=np.int64)


def _returned(table: pa.Table, values: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> pa.Table:
    """The chosen values of each row, under its part and slice."""
    ends = np.cumsum(sizes)
    found = [values[e - k : e][chosen[e - k : e]] for e, k in zip(ends, sizes)]
    some = pa.array([i for i, f in enumerate(found) if len(f)], pa.int64())
    return pa.table({"part": table["part"].take(some), "slice": table["slice"].take(some), "blob": pa.array([f.tobytes() for f in found if len(f)], pa.binary())})


def _stretches(raw: bytes, w: Words, gone: np.ndarray, first: int) -> bytes:
    edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    return b" ".join(raw[w.start[first + a] : w.end[first + b - 1]] for a, b in edges.reshape(-1, 2))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def repeats(docs: DataFrame, window: int, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, layout: bool = False) -> DataFrame:
    """Marks, in each document, the words inside passages that stand earlier.

    docs: any frame with an integer id and a text; further columns are ignored,
    but for those in ``keep``, which come back in the struct ``rest``.
    window: words of a passage, at least 3.
    Returns doc_id, n_words, n_removed, kept_text (the other words, joined by one
    space; with ``layout`` the text as it was where nothing goes, and else its kept
    stretches as they were, joined by one space), rest.  A passage stands earlier if it starts in a smaller doc_id or
    further left in the same text; it is judged on the input.  Null text has no
    words.  Rows with a null id come first; rows that share an id are ordered by
    text.  An empty table gives an empty table.
    """
    if window < 3:
        raise ValueError("a passage has at least 3 words")
    keep, block = keep or [], (window + 1) // 2
    rows, n_parts = sliced(docs, doc_id, text, keep)
    rest_type = rows.schema["rest"].dataType.simpleString()

    def texts_of(table: pa.Table):
        for _, _, _, _, w in hashed_words(table["text"]):
            yield w

    def probe(table: pa.Table) -> pa.Table:
        hashes, aligned = [], []
        for w in texts_of(_ordered(table)):
            at, h = w.windows(block)
            hashes.append(h)
            aligned.append((at - w.bounds[w.text[at]]) % block == 0)
        h, is_block = np.concatenate(hashes), np.concatenate(aligned)
        part, fp = _fingerprint(h, n_parts)
        key = (part.astype(np.uint64) << U64(32)) | (fp.astype(np.uint64) << U64(1)) | is_block
        key.sort()
        both = key >> U64(1)
        run = _runs(both)
        n = np.diff(np.r_[run, len(both)])
        last = key[run + n - 1] if len(run) else key
        out = ((last & U64(0xFFFFFFFF)).astype(np.uint32) << np.uint32(1)) | (n > 1)
        return _packed(out, (last >> U64(32)).astype(np.int64), int(table["slice"][0].as_py()), n_parts)

    def index(table: pa.Table) -> pa.Table:
        values, sizes = _blobs(table, np.uint32)
        order = np.argsort(values >> np.uint32(2), kind="stable")
        fp = (values >> np.uint32(2))[order]
        run = _runs(fp)
        n = np.diff(np.r_[run, len(fp)])
        flags = np.bitwise_or.reduceat(values[order] & np.uint32(3), run)
        live = fp[run[((flags & 2) > 0) & ((n > 1) | ((flags & 1) > 0))]]
        hit = member(values >> np.uint32(2), live)
        return _returned(table, values >> np.uint32(2), sizes, hit)

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return _packed(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, n_parts)
        fps, sizes = _blobs(hits, np.uint32)
        live = np.sort((np.repeat(hits["part"].to_numpy().astype(np.uint64), sizes) << U64(30)) | fps)
        passages, parts = [], []
        for w in texts_of(_ordered(table)):
            at, h = w.windows(block)
            part, fp = _fingerprint(h, n_parts)
            is_hit = np.zeros(len(w) + 1, dtype=np.int64)
            is_hit[1:][at] = member((part.astype(np.uint64) << U64(30)) | fp, live)
            upto = np.cumsum(is_hit)
            start, whole = w.windows(window)
            near = upto[start + window - block + 1] > upto[start]
            lane = w.windows(window, lane=1)[1]
            passages.append(whole[near])
            parts.append((lane[near] % U64(n_parts)).astype(np.int64))
        passages, parts = np.concatenate(passages), np.concatenate(parts)
        order = np.lexsort((passages, parts))
        passages, parts = passages[order], parts[order]
        first = np.r_[True, (passages[1:] != passages[:-1]) | (parts[1:] != parts[:-1])] if len(parts) else np.zeros(0, bool)
        return _packed(passages[first], parts[first], int(table["slice"][0].as_py()), n_parts)

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        values, sizes = _blobs(table, np.uint64)
        order = np.argsort(values, kind="stable")
        v = values[order]
        later = np.zeros(len(v), dtype=bool)
        later[order[1:]] = v[1:] == v[:-1]
        return _returned(table, values, sizes, later)

    def mark(table: pa.Table, seen: pa.Table) -> pa.Table:
        table = _ordered(table)
        part, sizes = _blobs(seen, np.uint64)
        lanes = np.repeat(seen["part"].to_numpy().astype(np.int64), sizes)
        earlier = {}
        keys = np.sort(part)
        doubt = len(keys) > 1 and bool((keys[1:] == keys[:-1]).any())
        if doubt:
            earlier = set(zip(part.tolist(), lanes.tolist()))
        words, starts, whole, bad, base = [], [], [], [], 0
        texts = list(hashed_words(table["text"]))
        for *_, w in texts:
            at, h = w.windows(window)
            lane = (w.windows(window, lane=1)[1] % U64(n_parts)).astype(np.int64)
            is_bad = member(h, keys)
            if doubt and is_bad.any():
                is_bad[is_bad] = [x in earlier for x in zip(h[is_bad].tolist(), lane[is_bad].tolist())]
            starts.append(at + base)
            whole.append(h)
            bad.append(is_bad)
            words.append(len(w))
            base += len(w)
        starts, whole, bad = np.concatenate(starts), np.concatenate(whole), np.concatenate(bad)
        order = np.argsort(whole, kind="stable")
        v = whole[order]
        bad[order[1:]] |= v[1:] == v[:-1]
        gone = covered(base, starts[bad], window)
        n_words, n_removed, kept, done = [], [], [], 0
        for _, _, data, offsets, w in texts:
            raw = data.tobytes()
            for k in range(len(offsets) - 1):
                own = gone[done + w.bounds[k] : done + w.bounds[k + 1]]
                here = raw[offsets[k] : offsets[k + 1]].split()
                n = int(own.sum())
                n_words.append(len(here))
                n_removed.append(n)
                if layout:
                    kept.append(_stretches(raw, w, own, int(w.bounds[k])) if n else raw[offsets[k] : offsets[k + 1]])
                else:
                    kept.append(b" ".join(compress(here, (~own).tolist()) if n else here))
            done += len(w)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "rest": table["rest"]})

    by_slice = rows.groupBy("slice")
    hits = by_slice.applyInArrow(probe, _BLOB).groupBy("part").applyInArrow(index, _BLOB)
    seen = by_slice.cogroup(hits.groupBy("slice")).applyInArrow(extend, _BLOB).groupBy("part").applyInArrow(first, _BLOB)
    out = f"doc_id long, n_words long, n_removed long, kept_text string, rest {rest_type}"

    return by_slice.cogroup(seen.groupBy("slice")).applyInArrow(mark, out)
