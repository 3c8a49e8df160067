"""Suffix order, Burrows-Wheeler transform and common prefixes of a few texts, in numpy.

Common prefixes come from backward extension, breadth first: an interval of suffixes that start with a string is split by the characters before
them in the transform, which gives the intervals of all strings one longer. The first interval to end at a place sets the common prefix there, so values come in
increasing order, and the search stops at the length of interest: places without a value by then have that length or more in common.
"""

from __future__ import annotations

import numpy as np


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as numbers, each text followed by a number of its own, and where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    out = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    out[ends - 1] = 256 + np.arange(len(texts))
    return out, ends - sizes


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` numbers at least, by doubling; those that do not differ there stay in order of place."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1]
    bits = int(rank.max(initial=1)).bit_length()
    length = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(length):
        key <<= bits
        key[: n - k] |= rank[k:] if k < n else 0
    order = np.argsort(key, kind="stable")
    rank = _ranks(key, order)
    while length < depth:
        # Only suffixes that share their rank are sorted further.
        first = rank[order]
        tied = np.zeros(n, dtype=bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        following = np.where(own + length < n, rank[np.minimum(own + length, n - 1)] + 1, 0)
        inner = np.argsort(first[at] * (n + 1) + following, kind="stable")
        order[at] = own[inner]
        key = first[at] * (n + 1) + following[inner]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        length *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix the first place, in ``order``, of those with its key."""
    held = key[order]
    new = np.concatenate(([True], held[1:] != held[:-1]))
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """At k the length that suffixes k - 1 and k of ``order`` share, at most ``limit``; 0 at both ends."""
    n = len(text)
    before = text[order - 1]
    by_character = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int32)
    step[by_character] = np.arange(n, dtype=np.int32)
    out = np.full(n + 1, limit)
    out[0] = out[n] = 0
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    # Every end within the numbers that close the texts is set by the first step, so no later one goes there: what is left are bytes, which sort by counting.
    inner, letter = before < 256, np.minimum(before, 255).astype(np.uint8)
    low = np.flatnonzero(np.concatenate(([True], np.diff(before[by_character]) != 0))).astype(np.int32)
    size = np.diff(np.append(low, n)).astype(np.int32)
    for length in range(limit):
        if length:
            place = np.arange(size.sum(), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
            owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
            held = inner[place]
            place, owner = place[held], owner[held]
            # Intervals are in order of place and the steps of one character too, so sorting by character sorts the steps.
            own = letter[place]
            ranked = np.argsort(own, kind="stable")
            to, owner, own = step[place[ranked]], owner[ranked], own[ranked]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(to)), dtype=bool), (owner[1:] != owner[:-1]) | (own[1:] != own[:-1]))))
            size = np.diff(np.append(first, len(to))).astype(np.int32)
            low = to[first]
        fresh = unset[low + size]
        low, size = low[fresh], size[fresh]
        out[low + size] = length
        unset[low + size] = False
        if not len(low):
            break
    return out


def recurring_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text, which of its strings of ``width`` bytes also start at another place in any of them."""
    text, starts = joined(texts)
    order = suffix_order(text, width)
    shared = common_prefixes(text, order, width) >= width
    mask = np.zeros(len(text), dtype=bool)
    mask[order] = shared[:-1] | shared[1:]
    return [mask[s : s + max(0, len(t) - width + 1)] for s, t in zip(starts, texts, strict=True)]
