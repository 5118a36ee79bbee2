"""Suffix arrays by linear grouping.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix.  Groups start
as first symbols and are processed from the highest down: each member finds its
previous smaller suffix by pointers over what has been processed, and those
targets move, by how many members chose them, into new groups just above their
old one.  Phase 2 emits the order: behind each emitted suffix, the chain of
previous smaller suffixes of its left neighbour takes the next places of their
groups.  No text is renamed and nothing recurses.  Groups are formed by counting
alone, never by comparing, so each member costs a constant number of steps.

``suffix_array`` does one text.  ``suffix_arrays`` does many short texts in step:
each pass takes the highest group left in every text, so the work of a pass is
one set of array operations.
"""

from __future__ import annotations

import numpy as np


def _buckets(items, numbers) -> list[list[int]]:
    """The items by their numbers, the smallest first; counts of one group add up to its members, so the buckets are no more than these."""
    buckets: list[list[int]] = [[] for _ in range(max((numbers[i] for i in items), default=-1) + 1)]
    for i in items:
        buckets[numbers[i]].append(i)
    return [b for b in buckets if b]


def counting_order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by several keys of non-negative integers, the last the most significant, by counting digits of 16 bits."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, max(1, int(key.max()).bit_length()) if len(key) else 0, 16):
            order = order[np.argsort(((key[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]  # a radix sort for 16 bits
    return order


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of one text of positive integers in order; a suffix that begins another stands before it."""
    n = len(text) + 1
    symbols = [*text, 0]
    order = [s for bucket in _buckets(range(n), symbols) for s in bucket]
    place, group, size, start_of = [0] * n, [0] * n, [0] * n, [0] * n
    start = 0
    for slot, s in enumerate(order):
        if symbols[order[start]] != symbols[s]:
            start = slot
        place[s], group[s], start_of[slot] = slot, start, start
        size[start] += 1
    previous = [-1] * n
    end = n
    while end > 1:
        start = start_of[end - 1]
        members = order[start:end]
        for s in members:
            previous[s] = s - 1
        found, chosen = [], {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            found.append(p)
            if p >= 0:
                chosen[p] = chosen.get(p, 0) + 1
        by_group: dict[int, list[int]] = {}
        for s, p in zip(members, found):
            previous[s] = p
        for p in chosen:
            by_group.setdefault(group[p], []).append(p)
        for old, own in by_group.items():  # the most chosen go to the end of their old group's range
            size[old] -= len(own)
            slot = old + size[old]
            for bucket in _buckets(own, chosen):
                first = slot
                size[first] = len(bucket)
                for p in bucket:
                    other, was = order[slot], place[p]
                    order[was], place[other] = other, was
                    order[slot], place[p] = p, slot
                    group[p], start_of[slot] = first, first
                    slot += 1
        end = start
    out, free, placed = [n - 1] + [0] * (n - 1), list(range(n)), [False] * n
    placed[n - 1] = True
    for slot in range(n):
        s = out[slot] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out[1:]


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] places, then the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The order of the suffixes of each text symbols[bounds[k]:bounds[k+1]], one text after the other.

    Symbols are positive; the result holds places in ``symbols``.  Cells: in front
    of each text one that ends every search to the left, behind it the sentinel.
    """
    length = np.diff(bounds)
    texts = len(length)
    if not texts:
        return np.zeros(0, dtype=np.int64)
    base = bounds[:-1] + 2 * np.arange(texts)
    cells = int(bounds[-1]) + 2 * texts
    value = np.zeros(cells, dtype=np.int64)
    inner = _spans(base + 1, length)
    value[inner] = symbols[_spans(bounds[:-1], length)]
    body = _spans(base + 1, length + 1)
    of = np.repeat(np.arange(texts), length + 1)
    sorted_ = body[counting_order(value[body], of)]
    order, place, group = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.full(cells, -1, np.int64)
    order[body], place[sorted_] = sorted_, body
    new = np.r_[True, (value[sorted_[1:]] != value[sorted_[:-1]]) | (of[1:] != of[:-1])]
    first = body[new]
    counts = np.diff(np.r_[np.flatnonzero(new), len(body)])
    start_of, size = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    start_of[body] = np.repeat(first, counts)
    size[first] = counts
    group[sorted_] = start_of[body]
    previous, moving, times, seen = np.zeros(cells, np.int64), np.zeros(cells, bool), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    end = base + length + 2
    live = np.flatnonzero(end > base + 2)
    while len(live):
        top = end[live]
        start = start_of[top - 1]
        members = order[_spans(start, top - start)]
        own = np.repeat(start, top - start)
        p = members - 1
        previous[members] = p
        todo = np.flatnonzero(group[p] >= own)
        while len(todo):
            p[todo] = previous[p[todo]]
            todo = todo[group[p[todo]] >= own[todo]]
        previous[members] = p
        chosen = p[group[p] >= 0]
        if len(chosen):
            times[chosen] = 0
            np.add.at(times, chosen, 1)
            each = np.arange(len(chosen))
            seen[chosen] = each
            chosen = chosen[seen[chosen] == each]  # each once
            count, old = times[chosen], group[chosen]
            by = counting_order(count, old)
            chosen, count, old = chosen[by], count[by], old[by]
            run = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            many = np.diff(np.r_[run, len(old)])
            size[old[run]] -= many
            low = old + size[old]
            slot = low + np.arange(len(old)) - np.repeat(run, many)
            was, there = place[chosen], order[slot]
            moving[chosen] = True
            there = there[~moving[there]]
            moving[chosen] = False
            vacated = was[was < low]
            order[vacated], place[there] = there, vacated
            order[slot], place[chosen] = chosen, slot
            new = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])])
            many = np.diff(np.r_[new, len(old)])
            size[slot[new]] = many
            group[chosen] = np.repeat(slot[new], many)
            start_of[slot] = group[chosen]
        end[live] = start
        live = live[start > base[live] + 2]
    out, free, placed = np.zeros(cells, np.int64), np.arange(cells), np.zeros(cells, bool)
    sentinel = base + length + 1
    out[base + 1] = sentinel
    placed[base], placed[sentinel] = True, True
    longest = counting_order(int(length.max()) - length)
    sizes = -length[longest]
    for k in range(int(length.max()) + 1 if texts else 0):
        s = out[base[longest[: np.searchsorted(sizes, -k, side="right")]] + 1 + k] - 1
        while True:
            s = s[~placed[s]]
            if not len(s):
                break
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out[_spans(base + 2, length)] - 1 - 2 * np.repeat(np.arange(texts), length)
