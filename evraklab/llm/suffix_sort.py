"""Two-stage suffix sorting of one bounded block of byte strings, in numpy.

Only the suffixes that are smaller than their successors are sorted directly, eight bytes a
round and only as far as they tie. All others are induced: the buckets of equal first bytes
are scanned in ascending order, and a suffix larger than its successor takes the next free
place of its own bucket when its successor is met. Within a bucket the larger ones stand
first, by the length of their run of that byte. The order holds to a given depth; suffixes
that agree so far are neighbours in any order.
"""

from __future__ import annotations

import numpy as np

#: Ends every string; no byte of UTF-8.
END = 0xFF


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number that sorts as they do."""
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        part = text[k:].astype(np.uint64)
        part <<= np.uint64(56 - 8 * k)
        words[: len(part)] |= part
    return words


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For every place whether its suffix is smaller than the next one; false for the last."""
    last = np.flatnonzero(text[1:] != text[:-1])  # ends of runs of one byte
    smaller = np.zeros(len(text), bool)
    if len(last):
        lengths = np.diff(last, prepend=-1)
        smaller[: last[-1] + 1] = np.repeat(text[last] < text[last + 1], lengths)
    return smaller


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by the ``depth`` bytes from there on."""
    at = at[np.argsort(words[at], kind="stable")]
    first = words[at]
    head = np.ones(len(at), bool)  # begins a group that still ties
    head[1:] = first[1:] != first[:-1]
    tied = np.arange(len(at))
    for ahead in range(8, depth, 8):
        inside = ~head[tied]
        inside[:-1] |= inside[1:]
        tied = tied[inside]
        if not len(tied):
            break
        key = words[at[tied] + ahead]
        within = ~head[tied[1:]]
        group = np.concatenate(([0], np.cumsum(~within)))
        differ = np.zeros(group[-1] + 1, bool)
        differ[group[1:][within & (key[1:] != key[:-1])]] = True
        apart = np.flatnonzero(differ[group])  # the groups that part here
        if len(apart):
            order = apart[np.lexsort((key[apart], group[apart]))]
            at[tied[apart]] = at[tied[order]]
            key[apart] = key[order]
            head[tied[1:]] |= key[1:] != key[:-1]
    return at


def suffixes(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places marked in ``wanted``, ordered by the ``depth`` bytes from there on.

    ``text`` begins with END, ends each string with it, and has ``depth`` + 8 more at its end.
    """
    smaller = smaller_than_next(text)
    used = wanted.copy()
    # A larger suffix needs its successor: go on to the next smaller one.
    ends = np.flatnonzero(wanted[:-1] & ~wanted[1:] & ~smaller[:-1])
    if len(ends):
        small = np.flatnonzero(smaller)
        stops = small[np.searchsorted(small, ends)]
        edge = np.zeros(len(text) + 1, np.int32)
        np.add.at(edge, ends, 1)
        np.add.at(edge, stops + 1, -1)
        used |= np.cumsum(edge[:-1]) > 0
    direct = sort_directly(words, np.flatnonzero(used & smaller), depth)
    bounds = np.searchsorted(text[direct], np.arange(END + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(END + 1)]
    out = []
    for byte in range(END):
        bucket, new = [], np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        waiting[byte] = []
        while len(new):
            bucket.append(new)
            before = new - 1
            new = before[(text[before] == byte) & used[before]]
        bucket.append(direct[bounds[byte] : bounds[byte + 1]])
        scan = np.concatenate(bucket)
        if not len(scan):
            continue
        out.append(scan)
        before = scan - 1
        before = before[(text[before] > byte) & used[before]]
        firsts = text[before]
        order = np.argsort(firsts, kind="stable")
        before, firsts = before[order], firsts[order]
        cuts = np.flatnonzero(np.diff(firsts)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out) if out else direct
    return order[wanted[order]]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each place in ``order`` and the one before it, how many bytes they share, at most ``depth``."""
    shared = np.zeros(len(order), np.int32)
    open_ = np.arange(1, len(order))
    for ahead in range(0, depth, 8):
        if not len(open_):
            break
        differ = words[order[open_] + ahead] ^ words[order[open_ - 1] + ahead]
        ended, differ = open_[differ != 0], differ[differ != 0]
        # The highest differing byte says how many of the eight agree.
        shared[ended] = ahead + 7
        for k in range(6, -1, -1):
            shared[ended[(differ >> np.uint64(56 - 8 * k)) != 0]] = ahead + k
        alike = np.ones(len(order), bool)
        alike[ended] = False
        open_ = open_[alike[open_]]
        shared[open_] = ahead + 8
    return np.minimum(shared, depth)


def repeated_starts(strings: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string which of its first ``counts`` places begin ``length`` bytes found twice.

    A string stands for ``weights`` equal ones; every counted place has ``length`` bytes.
    """
    end = bytes([END])
    text = np.frombuffer(end + end.join(strings) + end * (length + 9), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    wanted = np.zeros(len(text), bool)
    owner = np.repeat(np.arange(len(strings)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = begin[owner] + inner
    wanted[places] = True
    words = words_at(text)
    order = suffixes(text, words, wanted, length)
    group = np.cumsum(common_prefixes(words, order, length) < length) - 1
    whose = np.zeros(len(text), np.int32)
    whose[places] = owner
    total = np.bincount(group, weights=weights[whose[order]].astype(np.float64)) if len(order) else np.zeros(0)
    twice = np.zeros(len(text), bool)
    twice[order] = total[group] > 1.5
    return np.split(twice[places], np.cumsum(counts)[:-1]) if len(strings) else []
