"""Suffix arrays by induced sorting, with whole buckets as the step, and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour; the leftmost S of each run (LMS) are sorted, and
all others are induced from them in two linear passes. A pass goes through the buckets of first characters; all suffixes that a
bucket holds by then induce their left neighbours at once, in order, as array operations. LMS suffixes are sorted by
sorting LMS substrings with the same two passes, naming them, and solving the string of names: recursively while its alphabet
is small, and by doubling prefixes where it is wide (a loop over buckets pays only while they are large).

Only the order by the first ``depth`` characters is wanted, so doubling stops when that many are covered.
"""

from __future__ import annotations

import numpy as np

NARROW = 512


def _by_char(j: np.ndarray, chars: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Appends j to the queues of its characters, in order."""
    order = np.argsort(chars, kind="stable")
    j, chars = j[order], chars[order]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    first = np.r_[0, cut]
    for c, part in zip(chars[first].tolist(), np.split(j, cut), strict=True):
        queues[c].append(part)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array that the ordered LMS suffixes induce, and the S suffixes of each bucket, descending.

    t: characters below k, the last one smallest of all. small: whether a suffix is of type S.
    """
    first: list[list[np.ndarray]] = [[] for _ in range(k)]
    _by_char(lms, t[lms], first)
    queue: list[list[np.ndarray]] = [[] for _ in range(k)]
    large: list[np.ndarray] = []
    for c in range(k):
        parts = []
        now = _join(queue[c])
        while len(now):
            parts.append(now)
            j = now[now > 0] - 1
            j = j[~small[j]]
            chars = t[j]
            same = chars == c
            now = j[same]
            if len(j) > len(now):
                _by_char(j[~same], chars[~same], queue)
        large.append(_join(parts))
        queue[c] = []
        if first[c]:
            j = _join(first[c])
            j = j[j > 0] - 1
            if len(j):
                _by_char(j, t[j], queue)
    smaller: list[np.ndarray] = [np.empty(0, np.int32)] * k
    for c in range(k - 1, -1, -1):
        parts = []
        now = _join(queue[c])
        while len(now):
            parts.append(now)
            j = now[now > 0] - 1
            j = j[small[j]]
            chars = t[j]
            same = chars == c
            now = j[same]
            if len(j) > len(now):
                _by_char(j[~same], chars[~same], queue)
        smaller[c] = _join(parts)
        j = large[c][::-1]
        j = j[j > 0] - 1
        j = j[small[j]]
        if len(j):
            _by_char(j, t[j], queue)
    last = len(t) - 1  # no suffix follows the last one, so it is induced by none
    smaller[int(t[last])] = np.r_[smaller[int(t[last])], np.int32(last)].astype(np.int32)
    return np.concatenate([x for c in range(k) for x in (large[c], smaller[c][::-1])]), smaller


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(type S or not, LMS positions): a suffix is S if the next different character is larger; the last is S."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(n, bool)
    if len(change):
        rises = t[change + 1] > t[change]
        small[: change[-1] + 1] = np.repeat(rises, np.diff(np.r_[-1, change]))
    small[change[-1] + 1 if len(change) else 0 :] = False
    small[n - 1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, lms.astype(np.int32)


def ranks_by_tripling(names: np.ndarray, most: int) -> np.ndarray:
    """The rank of each suffix of a string of names by its first ``most`` names at least; equal ones in any order.

    Each round packs three ranks into one key and so triples the names that are covered.
    """
    n = len(names)
    rank, k = names.astype(np.int64), 1
    while True:
        base = int(rank.max()) + 2
        key = rank
        for step in (k, 2 * k):
            if base > (1 << 62) // (int(key.max()) + 1):  # three don't fit in one: number the pairs first
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            after = np.zeros(n, np.int64)
            if step < n:
                after[: n - step] = rank[step:] + 1
            key = key * base + after
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        k *= 3
        if k >= most or k >= n or new[order[-1]] == n - 1:
            out = np.empty(n, np.int64)
            out[order] = np.arange(n)
            return out
        rank = new


def lms_names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The ranks of the LMS substrings, in text order; equal substrings have one.

    A substring is compared by characters and types up to the LMS position that ends it, six at a time: of two that agree that far,
    neither is longer, since its end would be an LMS position of the other too. Characters are below 512.
    """
    n = len(t)
    letter = t.astype(np.int64) << 1 | small
    length = np.minimum(np.r_[lms[1:], n - 1] + 1, n) - lms
    rank = np.zeros(len(lms), np.int64)
    at, open_ = 0, np.arange(len(lms))
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        place, size = lms[open_].astype(np.int64) + at, length[open_] - at
        for k in range(6):
            key = key << 10 | np.where(k < size, letter[np.minimum(place + k, n - 1)], 0)
        # ranks stay apart: those of one group so far take numbers from the group's first on
        group = rank[open_]
        order = np.lexsort((key, group)) if at else np.argsort(key)
        g, x = group[order], key[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]
        first = np.flatnonzero(new)
        begin = np.r_[True, g[1:] != g[:-1]]
        nth = np.arange(len(order))
        rank[open_[order]] = g + np.maximum.accumulate(np.where(new, nth, 0)) - np.maximum.accumulate(np.where(begin, nth, 0))
        several = np.repeat(np.diff(np.r_[first, len(order)]) > 1, np.diff(np.r_[first, len(order)]))
        at += 6
        open_ = np.sort(open_[order[several]])
        open_ = open_[length[open_] > at] if at < depth else open_[:0]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(t: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Suffixes of t in the order of their first ``depth`` characters at least. The last character must be smallest, and only there."""
    small, lms = classify(t)
    if len(lms) > 1:
        names = lms_names(t, small, lms, depth)
        several = int(names.max()) + 1
        if several == len(lms):
            lms = lms[np.argsort(names)]
        elif several <= NARROW < len(lms):
            lms = lms[suffix_array(names.astype(np.uint16), several, depth // 2 + 1)]
        else:
            out = np.empty(len(lms), np.int32)
            out[ranks_by_tripling(names, depth // 2 + 1)] = lms
            lms = out
    return induce(t, small, lms.astype(np.int32), k)[0]


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The permuted array: for each position the common prefix, at most ``most``, with the suffix before it in sa.

    In text order neighbouring positions mostly have neighbouring partners, and then each prefix is one longer than the next
    position's (or ends here at a difference). So only the last positions of such runs are compared, four characters at a time.
    wanted: a mask of positions to look at; others are 0.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    look = before >= 0 if wanted is None else (before >= 0) & wanted
    at = np.flatnonzero(look)
    if not len(at):
        return np.zeros(n, np.int32)
    came = before[at]
    last = np.r_[(at[1:] != at[:-1] + 1) | (came[1:] != came[:-1] + 1), True]
    stop = t[at] != t[came]
    out = np.zeros(len(at), np.int64)
    ends = np.flatnonzero(last & ~stop)
    out[ends] = _compare(t, at[ends], came[ends], most)
    # the next stop or run end of each position; what it has is one shorter for each step towards it
    next_ = np.minimum.accumulate(np.where(stop | last, np.arange(len(at)), len(at))[::-1])[::-1]
    full = np.zeros(n, np.int32)
    full[at] = np.minimum(out[next_] + next_ - np.arange(len(at)), most)
    return full


def _compare(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, at most ``most``, for many pairs."""
    n, wide = len(t), 4  # four characters of sixteen bits in a word
    room = np.zeros(n + most + 8, np.uint64)
    room[:n] = t
    word = room.copy()
    for s in (1, 2):
        word[:-s] |= word[s:] << np.uint64(16 * s)
    out = np.full(len(a), most, np.int64)
    left = np.arange(len(a))
    for k in range(0, most, wide):
        x = word[a[left] + k] ^ word[b[left] + k]
        same = x == 0
        rest = left[~same]
        low = x[~same] & (~x[~same] + np.uint64(1))
        out[rest] = np.minimum(k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4), most)
        left = left[same]
        if not len(left):
            break
    return out
