"""Suffix arrays by induced sorting and their permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for smaller-type suffixes: the next different symbol is larger; the last suffix is one."""
    n = len(s)
    at = np.arange(n)
    differs = np.append(s[1:] != s[:-1], False)
    nxt = np.minimum.accumulate(np.where(differs, at, n - 1)[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = s[nxt[:-1]] < s[np.minimum(nxt[:-1] + 1, n - 1)]
    return small


def _left_runs(s: np.ndarray) -> np.ndarray:
    """Number of equal symbols directly before each position."""
    at = np.arange(len(s))
    first = np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0)
    return (at - np.maximum.accumulate(first)).astype(np.int32)


def _induce(s: np.ndarray, small: np.ndarray, runs: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from leftmost smaller-type suffixes in order; linear.

    Larger types are filled from the left of each bucket, smaller ones from its right. What a bucket sends to others goes there in
    one stable sort by symbol. Buckets are taken many at a time up to the first that gets something from those before
    it; a bucket that sends to itself is taken alone, and its runs are unrolled at once, by their lengths.
    """
    n = len(s)
    counts = np.bincount(s)
    end = np.cumsum(counts)
    start = end - counts
    symbols = np.flatnonzero(counts)
    sa = np.full(n, -1, np.int32)
    own = s[lms]
    order = np.argsort(own, kind="stable")
    own = own[order]
    seeds = np.bincount(own, minlength=len(counts))
    seeded = end[own] - seeds[own] + np.arange(len(own)) - (np.cumsum(seeds) - seeds)[own]
    sa[seeded] = lms[order]  # at the right of each bucket until the larger types are there
    none = lms[:0]
    most = 1 if len(symbols) < 1024 else len(symbols)

    def unroll(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What same-symbol runs before the items add to the bucket, and where the runs begin, in scan order."""
        r = runs[items]
        if not r.any():
            return none, items
        many = np.repeat(items, r)
        step = np.arange(len(many), dtype=np.int32) - np.repeat(np.cumsum(r) - r, r) + 1
        order = np.argsort(step, kind="stable")
        first = np.argsort(r, kind="stable")
        return (many - step)[order].astype(np.int32), (items - r)[first]

    def send(pre: np.ndarray, to: np.ndarray, edge: np.ndarray, sign: int):
        """Suffixes to their buckets, from the edge on, to the right or the left."""
        if not len(pre):
            return
        order = np.argsort(to, kind="stable")
        pre, to = pre[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        sizes = np.diff(np.append(cuts, len(to)))
        step = np.arange(len(to)) - np.repeat(cuts, sizes)
        sa[edge[to] + (step if sign > 0 else -1 - step)] = pre
        edge[to[cuts]] += sign * sizes

    head = start.copy()
    c, size = 0, 1
    while c < len(symbols):
        z = min(len(symbols), c + size)
        if z - c > 1:
            items = sa[start[symbols[c]] : end[symbols[z - 1]]]
            pre = items[items > 0] - 1
            pre = pre[~small[pre]]
            to = s[pre]
            if len(back := to[to <= symbols[z - 1]]):
                z = int(np.searchsorted(symbols, back.min()))
                use = s[pre + 1] < back.min()
                pre, to = pre[use], to[use]
            if z > c:
                send(pre, to, head, 1)
                c, size = z, min(most, 2 * (z - c) + 1)
                continue
        k = symbols[c]
        more, begins = unroll(sa[start[k] : head[k]].copy())
        sa[head[k] : head[k] + len(more)] = more
        head[k] += len(more)
        pre = np.concatenate([begins, sa[end[k] - seeds[k] : end[k]]]) - 1
        pre = pre[pre >= 0]
        to = s[pre]
        send(pre[to > k], to[to > k], head, 1)
        c, size = c + 1, min(most, 2)
    sa[seeded] = -1
    tail = end.copy()
    sa[0], tail[s[-1]] = n - 1, start[s[-1]]
    c, size = len(symbols), 1
    while c > 1:  # the last suffix, alone in its bucket, sends nothing
        z = max(1, c - size)
        if c - z > 1:
            items = sa[start[symbols[z]] : end[symbols[c - 1]]][::-1]
            pre = items[items > 0] - 1
            pre = pre[small[pre]]
            to = s[pre]
            if len(back := to[to >= symbols[z]]):
                z = int(np.searchsorted(symbols, back.max())) + 1
                use = s[pre + 1] > back.max()
                pre, to = pre[use], to[use]
            if z < c:
                send(pre, to, tail, -1)
                c, size = z, min(most, 2 * (c - z) + 1)
                continue
        k = symbols[c - 1]
        more, begins = unroll(sa[tail[k] : end[k]][::-1].copy())
        tail[k] -= len(more)
        sa[tail[k] : tail[k] + len(more)] = more[::-1]
        pre = np.concatenate([begins, sa[start[k] : head[k]][::-1]]) - 1
        pre = pre[pre >= 0]
        to = s[pre]
        send(pre[to < k], to[to < k], tail, -1)
        c, size = c - 1, min(most, 2)
    return sa


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Number of each leftmost smaller-type substring (in text order), equal ones alike, given their sorted order."""
    at = np.zeros(len(s), np.int32)
    at[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(s) - 1)
    lens = (ends - lms + 1)[at[order]]
    same = np.concatenate([[False], lens[1:] == lens[:-1]])
    live = np.flatnonzero(same)
    d = 0
    while len(live):
        live = live[lens[live] > d]
        equal = s[order[live] + d] == s[order[live - 1] + d]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
    names = np.empty(len(lms), np.int32)
    names[at[order]] = np.cumsum(~same) - 1
    return names


def _sorted(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end in one smaller than all others."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    small, runs = _types(s), _left_runs(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    sa = _induce(s, small, runs, lms)
    marked = np.zeros(len(s), bool)
    marked[lms] = True
    names = _names(s, sa[marked[sa]], lms)
    order = np.argsort(names, kind="stable") if int(names.max()) + 1 == len(lms) else _sorted(names)
    return _induce(s, small, runs, lms[order])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes (u8), the end of the text smallest; its first entry is the empty suffix.

    Leftmost smaller-type substrings are sorted by one induction. If equal ones remain, their numbers form the reduced string,
    at most half as long, whose suffixes are sorted in the same way. A second induction sorts all.
    """
    s = np.zeros(len(text) + 1, np.int16)
    s[:-1] = text
    s[:-1] += 1
    return _sorted(s)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each position the bytes that its suffix shares with the suffix before it in sa.

    The suffix d positions on shares at most d bytes less. So positions that are multiples of a large power of two come first, then
    those between them, and so on; each is compared, eight bytes at a time, only from where the one before it leaves off.
    """
    n = len(text)
    before = np.full(n + 1, n, np.int64)
    before[sa[1:]] = sa[:-1]
    before = before[:n]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    shared = np.zeros(n, np.int64)

    def extend(at: np.ndarray):
        room = n - np.maximum(at, before[at])
        while len(at):
            k = shared[at]
            apart = words[np.minimum(at + k, n)] ^ words[np.minimum(before[at] + k, n)]
            same = np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3)
            shared[at] = np.minimum(k + same, room)
            on = (same == 8) & (k + 8 < room)
            at, room = at[on], room[on]

    extend(np.arange(min(n, 1)))
    step = 1 << max(0, n - 1).bit_length()
    while step := step >> 1:
        at = np.arange(step, n, 2 * step)
        shared[at] = np.maximum(0, shared[at - step] - step)
        extend(at)
    return shared
