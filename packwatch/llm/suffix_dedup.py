"""Suffix-array dedup of byte strings.

A string of ``window`` bytes stands under its minimizer: of the runs of k bytes
in it the one with the smallest hash.  Equal strings have the same one, so the
windows of the corpus fall into buckets that meet in full.  The windows that share
one minimizer's place form a segment.  Equal windows agree in half of what is left
of a window on one side of the minimizer at least; a segment whose two such flanks
one document alone has holds no repeat and isn't sent.  So far hashes only route:
they bring together what may be equal.  In a bucket, segments of the same bytes are
one variant with its earliest document, and variants that equal flanks link form a
group.  The suffix array of a group's variants, built by linear grouping, puts equal
strings side by side, and each run of neighbours that agree in ``window`` bytes
belongs to its earliest document: no window is removed but by such a run.  The
strings of one variant all differ, so one that is a group alone needs no sorting.

As in substring dedup, documents are dealt to slices by ranges of doc_id, and a
slice sends a packed row to each part of the buckets, with each distinct
flank or segment once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import U64, _BYTES, _P, Prefixes, chunks, covered, member, mix, utf8
from .substring_dedup import _BLOB, _blobs, _ordered, _packed, _returned, sliced
from .suffix_array import _spans, suffix_array, suffix_arrays

#: Bytes of bucket text sorted in step at a time; a longer text than LONG is sorted alone.
STEP_BYTES, LONG = 1 << 20, 4096
#: Windows looked through at a time; a longer text is cut, its pieces overlapping by a window. Places within a piece have 28 bits.
PIECE = 1 << 26
_PLACE = U64((1 << 28) - 1)


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n values in a row."""
    have = 1
    while 2 * have <= n:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = n - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Hash of each minimizer, first window and window after the last that it stands for, text, its place, hash of its segment, and hashes of its left and right flanks (0 for none); in order."""
    if len(data) < window:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)
    prefixes = Prefixes(_BYTES[data], _P)
    h = prefixes.rolling(k)
    small = _smallest((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - k + 1)  # the high bits of h, then the place
    place = (small & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: len(place)] == text[window - 1 :][: len(place)]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1 : len(place)] != text[: len(place) - 1])]
    first = np.flatnonzero(new & whole)
    # windows of one text are consecutive, and those of one minimizer too
    last = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) + 1
    p = place[first]
    key = mix(h[p])
    return key, first, last, text[first], p, mix(prefixes.runs(first, last - 1 + window) ^ key), *flanks(prefixes, p, first, last - 1 + window, k, (window - k) // 2)


def flanks(prefixes: Prefixes, place: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k bytes at each place with ``half`` bytes before or behind them; 0 where they aren't within start and end."""
    left, right = place - start >= half, end - place - k >= half
    out = np.zeros((2, len(place)), dtype=np.uint64)
    out[0, left] = mix(prefixes.runs(place[left] - half, place[left] + k))
    out[1, right] = mix(prefixes.runs(place[right], place[right] + k + half) ^ U64(1))
    return out[0], out[1]


def _parts(h: np.ndarray, n_parts: int) -> np.ndarray:
    return ((h >> U64(34)) % U64(n_parts)).astype(np.int64)


def duplicates(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes byte strings that also start in a document with a smaller id.

    docs: any frame with an integer id and a text; other columns are ignored.
    window: bytes of a string, from 9 to 90.
    Returns doc_id, n_bytes, n_removed (bytes covered by such strings), n_spans
    (maximal runs of removed bytes), kept (the other bytes; they may split a
    character), spans (start and end of each removed run).  Texts are UTF-8; a
    string lies within one text and is judged on the input.  Null text is empty; a
    null id is smaller than all others; rows that share an id count as one document,
    so they don't remove from each other.  An empty table gives an empty table.
    """
    if not 9 <= window <= 90:
        raise ValueError("window must be from 9 to 90")
    k = max(8, window - 34) if window > 8 else window
    rows, n_parts = sliced(docs, doc_id, text, [])
    rows = rows.drop("rest")

    def of_slice(table: pa.Table):
        """Texts in order of their ids, ordinal of each row's id, and runs of texts with their minimizers."""
        table = _ordered(table)
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        values = ids.fill_null(0).to_numpy()
        nulls = np.asarray(ids.is_null())
        ordinal = np.cumsum(np.r_[0, (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])]) if len(values) else np.zeros(0, np.int64)
        data, offsets = utf8(table["text"])
        found = []
        for i, j in chunks(offsets):
            for at in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j])), PIECE):
                to = min(int(offsets[j]), at + PIECE + window - 1)
                own = np.clip(offsets[i : j + 1], at, to) - at
                h, first, last, of, place, *hashes = minimizers(data[at:to], own, window, k)
                found.append((h, first + at, last + at, of + i, place - first, *hashes))
        return table, data, offsets, ordinal, *(np.concatenate(x) for x in zip(*found))

    def probe(table: pa.Table) -> pa.Table:
        *_, ordinal, _, _, _, of, _, _, left, right = of_slice(table)
        h, of = np.r_[left[left > 0], right[right > 0]], np.r_[of[left > 0], of[right > 0]]
        part = _parts(h, n_parts)
        key = (part.astype(np.uint64) << U64(32)) | (h & U64(0x3FFFFFFF))
        by = np.lexsort((ordinal[of], key))
        key, own = key[by], ordinal[of][by]
        run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        end = np.r_[run[1:], len(key)]
        several = own[run] != own[end - 1] if len(run) else np.zeros(0, bool)
        out = ((key[run] & U64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(1)) | several
        return _packed(out, (key[run] >> U64(32)).astype(np.int64), int(table["slice"][0].as_py()), n_parts)

    def index(table: pa.Table) -> pa.Table:
        values, sizes = _blobs(table, np.uint32)
        ordered = np.sort(values)
        fp = ordered >> np.uint32(1)
        run = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        n = np.diff(np.r_[run, len(fp)])
        live = fp[run[(n > 1) | ((ordered[run + n - 1] & np.uint32(1)) > 0)]]
        return _returned(table, values >> np.uint32(1), sizes, member(values >> np.uint32(1), live))

    def segments_of(table: pa.Table, hits: pa.Table):
        """Live segments of a slice: key, identity, windows, row and place of the minimizer."""
        table, data, offsets, ordinal, h, first, last, of, at, identity, left, right = of_slice(table)
        fps, sizes = _blobs(hits, np.uint32)
        live = np.sort((np.repeat(hits["part"].to_numpy().astype(np.uint64), sizes) << U64(30)) | fps)
        known = lambda flank: (flank > 0) & member((_parts(flank, n_parts).astype(np.uint64) << U64(30)) | (flank & U64(0x3FFFFFFF)), live)
        use = known(left) | known(right)
        return table, data, offsets, ordinal, h[use], identity[use], first[use], last[use], of[use], at[use]

    def send(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("part", pa.int32()), ("slice", pa.int32()), ("blob", pa.binary()), ("text", pa.binary()))})
        slice_ = int(table["slice"][0].as_py())
        _, data, _, ordinal, h, identity, first, last, of, at = segments_of(table, hits)
        part = _parts(h, n_parts)
        by = np.lexsort((ordinal[of], identity, part))
        if len(by):
            new = np.r_[True, (identity[by][1:] != identity[by][:-1]) | (part[by][1:] != part[by][:-1])]
            new[1:] |= ~_same_bytes(data, first[by], (last - first - 1 + window)[by], ~new[1:])
            run = np.flatnonzero(new)
        else:
            run = np.zeros(0, np.int64)
        end = np.r_[run[1:], len(by)]
        one = by[run]
        several = ordinal[of[one]] != ordinal[of[by[end - 1]]] if len(run) else np.zeros(0, bool)
        sent = np.empty(len(one), dtype=_SENT)
        sent["key"], sent["ordinal"], sent["several"], sent["length"], sent["at"] = h[one], ordinal[of[one]], several, last[one] - first[one] - 1 + window, at[one]
        own, out = part[one], []
        cut = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)] if len(own) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:]):
            out.append((own[lo], slice_, sent[lo:hi].tobytes(), data[_spans(first[one[lo:hi]], sent["length"][lo:hi].astype(np.int64))].tobytes()))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("part", pa.int32()), ("slice", pa.int32()), ("blob", pa.binary()), ("text", pa.binary())), columns)})

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        sent, sizes = _blobs(table, _SENT)
        slices = np.repeat(table["slice"].to_numpy().astype(np.int64), sizes)
        data = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8)
        length = sent["length"].astype(np.int64)
        start = np.cumsum(length) - length
        hashes = [np.zeros((3, 0), np.uint64)]
        for i, j in chunks(np.r_[start, len(data)]):
            own = start[i:j] - start[i]
            prefixes = Prefixes(_BYTES[data[start[i] : start[j - 1] + length[j - 1]]], _P)
            sides = flanks(prefixes, own + sent["at"][i:j], own, own + length[i:j], k, (window - k) // 2)
            hashes.append(np.stack([mix(prefixes.runs(own, own + length[i:j]) ^ sent["key"][i:j]), *sides]))
        identity, left, right = np.concatenate(hashes, axis=1)
        when = (slices << 32) | sent["ordinal"].astype(np.int64)
        by = np.lexsort((when, identity, sent["key"]))
        key, ident = sent["key"][by], identity[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]
        new[1:] |= ~_same_bytes(data, start[by], length[by], ~new[1:])
        variant = np.cumsum(new) - 1  # of the entries in this order
        lead = by[new]  # the earliest entry of each variant
        earliest = when[lead]
        # which windows of each variant belong to which time
        group = _by_flank(left[lead], right[lead])
        members = np.argsort(group, kind="stable")
        bucket = np.flatnonzero(np.r_[True, group[members][1:] != group[members][:-1]])
        many = np.diff(np.r_[bucket, len(lead)])
        owner, mask, time = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        # a variant that no other can share a string with holds a repeat only where several documents hold it whole
        lone = (many == 1) & ((np.bincount(variant, minlength=len(lead)) > 1) | (np.bincount(variant, sent["several"][by], len(lead)) > 0))[members[bucket]]
        for chosen in (many > 1, lone):
            for text, bounds, where in _bucket_texts(bucket[chosen], many[chosen], members, lead, start, length, data):
                if chosen is lone:
                    order = np.arange(len(text))  # strings of one segment all differ, as each has the minimizer in another place
                elif len(text) > LONG and len(bounds) == 2:
                    order = bounds[0] + np.array(suffix_array(text.tolist()), dtype=np.int64)
                else:
                    order = suffix_arrays(text, bounds)
                o, m, t = _equal_neighbours(text, order, where, earliest, window)
                owner.append(o)
                mask.append(m)
                time.append(t)
        owner, mask, time = np.concatenate(owner), np.concatenate(mask), np.concatenate(time)
        sort = np.argsort(owner, kind="stable")
        owner, mask, time = owner[sort], mask[sort], time[sort]
        lo = np.searchsorted(owner, variant)
        n = np.searchsorted(owner, variant, side="right") - lo
        entry, which = np.repeat(by, n), _spans(lo, n)
        before = time[which] >> 32 < slices[entry]
        local = (time[which] & 0xFFFFFFFF).astype(np.int64)
        useful = before | (local < sent["ordinal"][entry]) | (sent["several"][entry] > 0)
        entry, which, before, local = entry[useful], which[useful], before[useful], local[useful]
        got = np.empty(len(entry), dtype=_GOT)
        got["identity"], got["mask"], got["ordinal"] = identity[entry], mask[which], np.where(before, -1, local)
        row = slices[entry]
        back = np.argsort(row, kind="stable")
        got, row = got[back], row[back]
        out = [(s, got[np.searchsorted(row, s) : np.searchsorted(row, s, side="right")].tobytes()) for s in np.unique(row).tolist()]
        return pa.table({"part": pa.array([int(table["part"][0].as_py())] * len(out), pa.int32()), "slice": pa.array([s for s, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    def mark(table: pa.Table, both: pa.Table) -> pa.Table:
        answers = both.filter(pa.array(np.asarray(both["kind"]) == 1)) if both.num_rows else both
        hits = both.filter(pa.array(np.asarray(both["kind"]) == 0)) if both.num_rows else both
        table, data, offsets, ordinal, _, identity, first, last, of, _ = segments_of(table, hits)
        got, _ = _blobs(answers, _GOT)
        got = got[np.argsort(got["identity"], kind="stable")]
        lo = np.searchsorted(got["identity"], identity)
        n = np.searchsorted(got["identity"], identity, side="right") - lo
        seg, which = np.repeat(np.arange(len(identity)), n), _spans(lo, n)
        late = got["ordinal"][which] < ordinal[of[seg]]
        seg, which = seg[late], which[late]
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        for at in range(0, len(seg), 1 << 16):
            s, m = seg[at : at + (1 << 16)], got["mask"][which[at : at + (1 << 16)]]
            bits = (m[:, None] >> np.arange(window - k + 1, dtype=np.uint64)) & U64(1)
            i, o = np.nonzero(bits)
            starts = first[s][i] + o
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        head = gone & np.r_[True, ~gone[:-1]] if len(gone) else gone
        head[offsets[:-1][np.diff(offsets) > 0]] |= gone[offsets[:-1][np.diff(offsets) > 0]]
        tail = gone & np.r_[~gone[1:], True] if len(gone) else gone
        tail[offsets[1:][np.diff(offsets) > 0] - 1] |= gone[offsets[1:][np.diff(offsets) > 0] - 1]
        removed = np.r_[0, np.cumsum(gone)]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        cut = np.searchsorted(heads, offsets)
        text_of = np.searchsorted(offsets, heads, side="right") - 1
        kept_offsets = offsets - removed[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(kept_offsets.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())])
        spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(heads - offsets[text_of]), pa.array(tails - offsets[text_of])], ["start", "end"]))
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), "n_spans": pa.array(np.diff(cut).astype(np.int64)), "kept": kept.cast(pa.binary()), "spans": spans})

    from pyspark.sql import functions as F

    by_slice = rows.groupBy("slice")
    hits = by_slice.applyInArrow(probe, _BLOB).groupBy("part").applyInArrow(index, _BLOB)
    sent = by_slice.cogroup(hits.groupBy("slice")).applyInArrow(send, _BLOB + ", text binary")
    answers = sent.groupBy("part").applyInArrow(resolve, _BLOB)
    both = hits.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    return by_slice.cogroup(both.groupBy("slice")).applyInArrow(mark, out)


_SENT = np.dtype([("key", np.uint64), ("ordinal", np.uint32), ("length", np.uint16), ("several", np.uint8), ("at", np.uint8)])
_GOT = np.dtype([("identity", np.uint64), ("mask", np.uint64), ("ordinal", np.int32)])


def _same_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each piece of data holds the same bytes as the one behind it, where this is asked."""
    same = asked & (length[1:] == length[:-1])
    at = np.flatnonzero(same)
    for lo in range(0, len(at), 1 << 14):
        i = at[lo : lo + (1 << 14)]
        n = length[i]
        differ = data[_spans(start[i], n)] != data[_spans(start[i + 1], n)]
        same[i] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    return same


def _by_flank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each variant, the same for those that are linked by equal flanks (0 for none), however many steps apart.

    Equal strings agree in one flank, so variants with other numbers have no string in
    common; equal hashes of unequal flanks only bring more variants together.
    """
    group = np.arange(len(left))
    sides = []
    for flank in (left, right):
        by = np.argsort(flank, kind="stable")
        by = by[flank[by] > 0]
        if len(by):
            run = np.flatnonzero(np.r_[True, flank[by][1:] != flank[by][:-1]])
            sides.append((by, run, np.diff(np.r_[run, len(by)])))
    while True:
        before = group
        for by, run, many in sides:
            least = np.repeat(np.minimum.reduceat(group[by], run), many)
            lower = group.copy()
            np.minimum.at(lower, group[by], least)  # what a number stood for moves along with it
            lower[by] = np.minimum(lower[by], least)
            group = lower[lower]
        if np.array_equal(before, group):
            return group


def _bucket_texts(bucket, many, members, lead, start, length, data):
    """Texts of groups of variants: symbols, bounds of the texts, and the variant at each place.

    ``bucket``: where the groups begin in ``members``; ``many``: their variants.  These
    stand one after another with a 1 behind each; bytes are 2 and up.
    """
    bounds = np.r_[0, np.cumsum(length[lead[members]] + 1)]
    total = bounds[bucket + many] - bounds[bucket]
    by = np.argsort(-total, kind="stable")  # of like lengths, so that a step has work in most texts
    at = 0
    while at < len(by):
        to = at + 1
        if total[by[at]] <= LONG:
            to = at + max(1, int(np.searchsorted(np.cumsum(total[by[at:]]), STEP_BYTES, side="right")))
        chosen = by[at:to]
        at = to
        variants = members[_spans(bucket[chosen], many[chosen])]
        entries = lead[variants]
        n = length[entries]
        symbols = np.ones(int((n + 1).sum()), dtype=np.int64)
        ends = np.cumsum(n + 1)
        symbols[_spans(ends - n - 1, n)] = data[_spans(start[entries], n)].astype(np.int64) + 2
        bounds = np.r_[0, np.cumsum(total[chosen])]
        where = np.stack([np.repeat(variants, n + 1), np.arange(len(symbols)) - np.repeat(ends - n - 1, n + 1), np.repeat(n, n + 1)])
        yield symbols, bounds, where


def _equal_neighbours(symbols, order, where, earliest, window):
    """Runs of suffixes that agree in their first ``window`` symbols: variant, mask of its windows, earliest time of the run."""
    variant, offset, n = where
    order = order[offset[order] + window <= n[order]]  # starts of whole strings
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    differ = np.ones(len(order), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint16), window)
    for at in range(1, len(order), 1 << 15):
        to = min(len(order), at + (1 << 15))
        differ[at:to] = (views[order[at:to]] != views[order[at - 1 : to - 1]]).any(1)
    run = np.flatnonzero(differ)
    first = np.minimum.reduceat(earliest[variant[order]], run)
    time = np.repeat(first, np.diff(np.r_[run, len(order)]))
    by = np.lexsort((time, variant[order]))
    v, t, bit = variant[order][by], time[by], U64(1) << offset[order][by].astype(np.uint64)
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])])
    return v[new], np.bitwise_or.reduceat(bit, new), t[new]
