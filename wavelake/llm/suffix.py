"""Suffix sorting in two stages, and common prefixes of neighbours, on byte arrays.

Stage one sorts only the suffixes that are smaller than their successors: the text between two
such positions is a block, blocks are named by their bytes and types, and the sequence of names is
sorted by doubling. Stage two induces all other suffixes by one scan over the buckets.
"""

from __future__ import annotations

import numpy as np

_STEP = 6  # bytes after which a block ends even without a position to sort


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last is not."""
    n = len(t)
    if n == 0:
        return np.zeros(0, bool)
    last = np.flatnonzero(t[:-1] != t[1:])
    up = np.append(t[last] < t[last + 1], False) if len(last) else np.array([False])
    runs = np.diff(np.concatenate([[-1], last, [n - 1]]))
    return np.repeat(up, runs)


def _sort_smaller(t: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the smaller suffixes, in the order of at least their first ``depth`` bytes."""
    n = len(t)
    at = np.flatnonzero(small)
    if not len(at):
        return at
    gap = np.diff(np.append(at, n))
    extra = (gap - 1) // _STEP
    if extra.any():  # long falling stretches: extra block starts, so that a block stays short
        k = np.repeat(np.arange(len(at)), extra)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        pos = np.sort(np.concatenate([at, at[k] + nth * _STEP]))
    else:
        pos = at
    m = len(pos)
    length = np.diff(np.append(pos, n))
    code = np.zeros(n + _STEP + 1, np.uint64)
    code[:n] = t.astype(np.uint64) * np.uint64(2) + small
    key = np.zeros(m, np.uint64)
    for e in range(_STEP + 1):
        key = (key << np.uint64(9)) | np.where(e <= length, code[pos + e], np.uint64(0))
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    rank = np.empty(m, np.int64)
    rank[order] = head
    single = first & np.append(first[1:], True)
    active = order[~single]
    h = 1
    while len(active) and h < depth:
        far = active + h
        behind = np.where(far < m, rank[np.minimum(far, m - 1)] + 1, 0)
        pair = rank[active] * np.int64(m + 1) + behind
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        old = rank[active]
        i = np.arange(len(active))
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        start_old = np.maximum.accumulate(np.where(new_old, i, 0))
        start_new = np.maximum.accumulate(np.where(new, i, 0))
        rank[active] = old + (start_new - start_old)
        single = new & np.append(new[1:], True)
        active = active[~single]
        h *= 2
        if len(active):
            ends = active + h
            reach = np.where(ends < m, pos[np.minimum(ends, m - 1)], n + depth) - pos[active]
            if reach.min() >= depth:
                break
    sorted_pos = pos[np.argsort(rank, kind="stable")]
    return sorted_pos[small[sorted_pos]]


def _doubled(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of symbols of any size, by doubling alone."""
    n, h = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while h < depth and rank.max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - h)] = rank[h:] + 1
        rank = np.unique(rank * np.int64(n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """All suffixes of ``t`` in the order of at least their first ``depth`` symbols (all if None). Bytes are sorted in two
    stages, larger symbols, of which a text has few, by doubling."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    if t.dtype != np.uint8:
        return _doubled(t, n if depth is None else depth)
    small = smaller_than_next(t)
    direct = _sort_smaller(t, small, n + 1 if depth is None else depth)
    cuts = np.searchsorted(t[direct], np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[t[n - 1]].append(np.array([n - 1]))
    out = []

    def deal(found: np.ndarray, here: int) -> list[np.ndarray]:
        """The larger suffixes just before the found ones go to the ends of their buckets."""
        q = found[found > 0] - 1
        q = q[~small[q]]
        if not len(q):
            return []
        c = t[q]
        by = np.argsort(c, kind="stable")
        q, c = q[by], c[by]
        edge = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
        same = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            (same if c[a] == here else large[c[a]]).append(q[a:b])
        return same

    for c in range(256):
        todo = large[c]
        while todo:
            found = np.concatenate(todo) if len(todo) > 1 else todo[0]
            out.append(found)
            todo = deal(found, c)
        found = direct[cuts[c]: cuts[c + 1]]
        if len(found):
            out.append(found)
            deal(found, c)
    return np.concatenate(out)


def common_prefix_reaches(t: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffixes a[i] and b[i] share at least ``width`` symbols (both must have as many)."""
    alive, done = np.arange(len(a)), 0
    if t.dtype == np.uint8:
        wide, done = np.concatenate([t, np.zeros(8, np.uint8)]), width - width % 8
        eight = np.ndarray(shape=(len(t) + 1,), dtype="<u8", buffer=wide.data, strides=(1,))
        for off in range(0, done, 8):
            alive = alive[eight[a[alive] + off] == eight[b[alive] + off]]
            if not len(alive):
                break
    for off in range(done, width):
        alive = alive[t[a[alive] + off] == t[b[alive] + off]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out
