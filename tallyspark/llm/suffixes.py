"""Suffix ranks by the difference-cover method (positions 1 and 2 of every three), to a given depth."""

from __future__ import annotations

import numpy as np


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of the columns, in their order; prefixes are named first where 63 bits don't hold all."""
    key = columns[0]
    for c in columns[1:]:
        have, more = int(key.max()).bit_length(), int(c.max()).bit_length()
        if have + more > 63:
            key = _named(key)[0]
            have = int(key.max()).bit_length()
        key = key << more | c
    return key


def _named(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 0 in the order of the keys, and their number."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.empty(len(key), np.int64)
    new[0] = 0
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.cumsum(new)
    names = np.empty(len(key), np.int64)
    names[order] = ranks
    return names, int(ranks[-1]) + 1


def _below(key: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key how many are smaller, and how many of those from place `z` on; by one sort, as a search for each key would miss the caches."""
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    times = np.diff(np.append(first, len(key)))
    late = np.concatenate(([0], np.cumsum(order >= z)))
    below, late_below = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    below[order] = np.repeat(first, times)
    late_below[order] = np.repeat(late[first], times)
    return below, late_below


def suffix_ranks(text: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """For every suffix of `text` (numbers from 0) how many suffixes are smaller, as far as `depth` base characters.

    `span`: base characters in one number of `text`. Suffixes that differ within the depth have ranks in their order;
    those that agree have ranks with none of another prefix between them. Past the end the text counts as smaller than any.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.zeros((n + 2) // 3 * 3 + 6, np.int64)
    padded[:n] = text + 1
    size = len(padded) - 3  # the last whole triple is past the end: it parts the two halves of the recursion
    first, second = np.arange(1, size, 3), np.arange(2, size, 3)
    sample = np.concatenate((first, second))
    names, count = _named(_packed([padded[sample], padded[sample + 1], padded[sample + 2]]))
    if count < len(sample) and 3 * span < depth:
        names = suffix_ranks(names, depth, 3 * span)
    rank = np.zeros(len(padded), np.int64)
    rank[sample] = names + 1
    zero = np.arange(0, size, 3)

    # a suffix at 0 meets those at 1 by (character, rank behind it), those at 2 by (two characters, rank behind them)
    by_one = _packed([np.concatenate((padded[zero], padded[first])), np.concatenate((rank[zero + 1], rank[first + 1]))])
    by_two = _packed([np.concatenate((padded[a], padded[b])) for a, b in ((zero, second), (zero + 1, second + 1))] + [np.concatenate((rank[zero + 2], rank[second + 2]))])
    z = len(zero)
    out = np.empty(len(padded), np.int64)
    below_one, firsts_below = _below(by_one, z)
    below_two, seconds_below = _below(by_two, z)
    smaller = np.concatenate(([0], np.cumsum(np.bincount(names))))[names]
    out[zero] = below_one[:z] + seconds_below[:z]
    out[first] = smaller[: len(first)] + below_one[z:] - firsts_below[z:]
    out[second] = smaller[len(first) :] + below_two[z:] - seconds_below[z:]
    return out[:n]
