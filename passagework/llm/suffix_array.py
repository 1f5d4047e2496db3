"""Suffix arrays by induced sorting, with numpy working on whole buckets.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller
(LMS) ones are sorted by their substrings up to the next LMS, named, and ordered by the string
of names; the others are induced from them, bucket by bucket. The order of the names is found
by doubling: ranks of 2, 4, 8, ... consecutive substrings, until they are distinct or cover
`depth` characters, so suffixes are in order by their first `depth` characters at least, and
those that agree so far are neighbours.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour; the last is."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = 1
    # equal neighbours have the type of the next change
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(items: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append the items to their characters' buckets, in order."""
    if not len(items):
        return
    order = np.argsort(chars, kind="stable")
    items, chars = items[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for c, part in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts)):
        into[c].append(part)


_NONE = np.empty(0, np.int32)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def induce(s: np.ndarray, smaller: np.ndarray, lms: list[np.ndarray], letters: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes of each bucket in order."""
    large: list[list[np.ndarray]] = [[] for _ in range(letters)]
    for c in range(letters):
        now = _joined(large[c])
        done = [now]
        while len(now):  # runs of c: each larger suffix may have another before it
            before = now[now > 0] - 1
            now = before[(s[before] == c) & ~smaller[before]]
            if len(now):
                done.append(now)
        large[c] = [_joined(done)]
        both = np.concatenate([large[c][0], lms[c]])
        before = both[both > 0] - 1
        chars = s[before]
        keep = chars > c
        _deal(before[keep], chars[keep], large)
    small: list[list[np.ndarray]] = [[] for _ in range(letters)]
    small[0] = [np.array([len(s) - 1], np.int32)]
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):  # from here on in descending order
        now = _joined(small[c])
        done = [now]
        while len(now):
            before = now[now > 0] - 1
            now = before[(s[before] == c) & smaller[before]]
            if len(now):
                done.append(now)
        mine = _joined(done)
        both = np.concatenate([mine, large[c][0][::-1]])
        out.append(both)
        before = both[both > 0] - 1
        chars = s[before]
        keep = chars < c
        _deal(before[keep], chars[keep], small)
    return np.concatenate(out)[::-1]


def _eights(s: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as one value; zeros follow the end."""
    padded = np.concatenate([s.astype(np.uint8), np.zeros(64, np.uint8)])
    value = np.zeros(len(s) + 56, np.uint64)
    for j in range(8):
        value |= padded[j : j + len(value)].astype(np.uint64) << np.uint64(8 * j)
    return value


def common_prefixes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """What pairs of positions share, in whole steps of 8 characters, or `depth` if as much."""
    found = np.zeros(len(a), np.int16)
    going = np.flatnonzero(eights[a] == eights[b])
    last = len(eights) - 1
    for at in [*range(8, depth - 7, 8), depth - 8]:
        found[going] = at
        going = going[eights[np.minimum(a[going] + at, last)] == eights[np.minimum(b[going] + at, last)]]
        if not len(going):
            break
    found[going] = depth
    return found


def _names(s: np.ndarray, sorted_lms: np.ndarray, ends: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """A name, in order, for every LMS substring of the sorted list."""
    a, b = sorted_lms[:-1], sorted_lms[1:]
    size_a, size_b = ends[:-1] - a, ends[1:] - b
    new = np.ones(len(sorted_lms), bool)
    same = np.flatnonzero(size_a == size_b)
    at = 0
    while len(same):
        x, y, size = a[same] + at, b[same] + at, size_a[same] + 1 - at
        mask = np.where(size >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.clip(size, 0, 7).astype(np.uint64))) - np.uint64(1))
        last = len(eights) - 1
        equal = ((eights[np.minimum(x, last)] ^ eights[np.minimum(y, last)]) & mask) == 0
        over = equal & (size <= 8)
        new[same[over] + 1] = False
        same = same[equal & ~over]
        at += 8
    return np.cumsum(new) - 1


def _rank(names: np.ndarray, starts: np.ndarray, depth: int, length: int) -> np.ndarray:
    """For every suffix of the string of names, how many are smaller by their first `depth` characters."""
    n, step = len(names), 1
    sizes = np.bincount(names)
    rank = (np.cumsum(sizes) - sizes)[names]
    open_ = np.flatnonzero(sizes[names] > 1)
    bounds = np.append(starts, length)
    while len(open_):
        ahead = np.minimum(open_ + step, n)
        open_ = open_[(bounds[ahead] - starts[open_] < depth) & (ahead < n)]
        if not len(open_):
            break
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n - 1)]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old = rank[open_]
        index = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, index, 0))
        parted = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, index, 0))
        rank[open_] = old + parted - group
        alone = np.diff(np.append(np.flatnonzero(parted == index), len(open_)))
        open_ = np.sort(open_[np.repeat(alone > 1, alone)])
        step *= 2
    return rank


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `s` (values below 256, the last one the only 0) in order of their suffixes."""
    letters = 256
    smaller = smaller_types(s)
    is_lms = smaller.copy()
    is_lms[1:] &= ~smaller[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms).astype(np.int32)
    chars = s[lms]

    def by_bucket(order: np.ndarray) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in range(letters)]
        _deal(order, s[order], parts)
        return [_joined(p) for p in parts]

    first = induce(s, smaller, by_bucket(lms[np.argsort(chars, kind="stable")]), letters)
    sorted_lms = first[is_lms[first]]
    after = np.append(lms[1:], len(s) - 1)
    end_of = np.zeros(len(s), np.int32)
    end_of[lms] = after
    names = _names(s, sorted_lms, end_of[sorted_lms], _eights(s))
    in_text = np.zeros(len(s), np.int64)
    in_text[sorted_lms] = names
    rank = _rank(in_text[lms], lms.astype(np.int64), depth, len(s))
    return induce(s, smaller, by_bucket(lms[np.argsort(rank)]), letters)


def neighbours(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Permuted common prefixes: for every position, what it shares with its predecessor in order."""
    out = np.zeros(len(s), np.int16)
    out[order[1:]] = common_prefixes(_eights(s), order[1:], order[:-1], depth)
    return out
