"""Suffix arrays by linear grouping, for one text or for many small texts in lockstep.

Suffixes are first grouped by their first symbol.  Groups are processed in descending order: every suffix of
the group points to the nearest suffix on its left that lies in a smaller group, and the suffixes so pointed
at move, by how many pointers they got, to new groups just above the rest of their own.  At the end a group
holds the suffixes with one Lyndon prefix.  The order within groups then follows without renaming or
recursion: going up the array, the suffix before each entry and those along its pointers are placed next in
their groups until one is met that has its place already.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be its only smallest one."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    start = [0] * n  # of each suffix: where its group starts, which also names the group
    size = [0] * n  # by group name
    place = [0] * n
    at = 0
    for i, s in enumerate(order):
        if i and text[order[i - 1]] != text[s]:
            at = i
        start[s] = at
        size[at] += 1
        place[s] = i
    prev = [-1] * n
    jump = list(range(-1, n - 1))  # path-compressed pointers to the left
    end = n
    while end > 0:
        name = start[order[end - 1]]
        members = order[name:end]
        counts: dict[int, int] = {}
        for s in sorted(members):
            p = jump[s]
            while p >= 0 and start[p] >= name:
                p = jump[p]
            prev[s] = jump[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        touched: dict[int, list[int]] = {}
        for p in counts:
            touched.setdefault(start[p], []).append(p)
        for group, found in touched.items():
            found.sort(key=counts.__getitem__, reverse=True)
            top, i = group + size[group], 0
            while i < len(found):
                j = i
                while j < len(found) and counts[found[j]] == counts[found[i]]:
                    j += 1
                new = top - j
                for at, p in enumerate(found[i:j], new):
                    other, old = order[at], place[p]
                    order[at], order[old], place[p], place[other] = p, other, at, old
                for p in found[i:j]:
                    start[p] = new
                if new != group:
                    size[new] = j - i
                i = j
            if len(found) < size[group]:
                size[group] -= len(found)
            else:
                size[group] = sum(counts[p] == counts[found[-1]] for p in found)
        end = name
    return _emit(n, start, prev)


def _emit(n: int, start: list[int], prev: list[int]) -> list[int]:
    out, free, done = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            at = free[start[s]]
            free[start[s]] = at + 1
            out[at] = s
            done[s] = True
            s = prev[s]
    return out


def suffix_arrays(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of the rows of ``texts``; row i counts up to lengths[i], where its only smallest symbol
    stands last, and the same holds for the rows that come back."""
    rows, n = texts.shape
    index = np.arange(n, dtype=np.int32)
    real = index < lengths[:, None]
    # group names from the ranks of first symbols: how many symbols of the row are smaller
    order = np.argsort(np.where(real, texts, np.iinfo(np.int32).max), axis=1, kind="stable")
    ranked = np.take_along_axis(texts, order, 1)
    fresh = np.ones((rows, n), bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    first = np.maximum.accumulate(np.where(fresh, index, 0), axis=1)
    start = np.full((rows, n), -1, np.int32)
    np.put_along_axis(start, order, first.astype(np.int32), 1)
    start[~real] = -1
    size = np.zeros((rows, n + 1), np.int32)
    r, c = np.nonzero(real)
    np.add.at(size, (r, start[r, c]), 1)
    prev = np.full((rows, n), -1, np.int32)
    name = start.max(axis=1)
    live = np.arange(rows)
    while len(live):
        g, own = start[live], name[live][:, None]
        left = np.maximum.accumulate(np.where((g < own) & (g >= 0), index, -1), axis=1)
        r, c = np.nonzero(g == own)
        p = np.where(c > 0, left[r, np.maximum(c - 1, 0)], -1)
        prev[live[r], c] = p
        hit = p >= 0
        codes, counts = np.unique(r[hit] * n + p[hit], return_counts=True)
        if len(codes):
            row, pos = live[codes // n], codes % n
            group = start[row, pos]
            by = np.lexsort((-counts, group, row))
            row, pos, group, counts = row[by], pos[by], group[by], counts[by]
            head = np.ones(len(row), bool)
            head[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
            head_at = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
            last = head.copy()  # last of a run of equal counts
            last[:-1] = head[1:] | (counts[1:] != counts[:-1])
            last[-1] = True
            run_end = np.minimum.accumulate(np.where(last, np.arange(len(row)), len(row))[::-1])[::-1]
            new = (group + size[row, group] - (run_end - head_at + 1)).astype(np.int32)
            start[row, pos] = new
            taken = np.bincount(np.cumsum(head) - 1)
            size[row[head], group[head]] -= taken.astype(np.int32)
            np.add.at(size, (row, new), 1)
        g = start[live]
        lower = np.where(g < name[live][:, None], g, -1).max(axis=1)
        name[live] = lower
        live = live[lower >= 0]
    out = np.full((rows, n), -1, np.int32)
    out[:, 0] = lengths - 1
    done = ~real
    everyone = np.arange(rows)
    done[everyone, lengths - 1] = True
    free = np.broadcast_to(index, (rows, n)).copy()
    for i in range(n):
        r = np.nonzero(i < lengths)[0]
        s = out[r, i] - 1
        while True:
            ok = s >= 0
            ok[ok] = ~done[r[ok], s[ok]]
            r, s = r[ok], s[ok]
            if not len(r):
                break
            group = start[r, s]
            at = free[r, group]
            free[r, group] = at + 1
            out[r, at] = s
            done[r, s] = True
            s = prev[r, s]
    return out
