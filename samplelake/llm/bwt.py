"""Equal strings of a minimum length in a few strings, from their Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SEPARATOR = 0
_BITS, _PACKED = 9, 7


def _order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols or more, and the place of each."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(_PACKED, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(_PACKED):
        key = key << np.uint64(_BITS) | padded[i : n + i]
    known = _PACKED
    while True:
        order = np.argsort(key)
        if known >= depth:
            break
        ranked = key[order]
        rank = np.empty(n + known, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])), dtype=np.uint64)
        rank[n:] = 0
        key = rank[:n] << np.uint64(32) | rank[known:]
        known *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def equal_prefix_groups(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and a group number that suffixes with equal first ``length``
    symbols share.

    Groups are told apart by the common prefixes of neighbours, which are found by increasing
    length: the interval of suffixes that start with a string is extended backwards by each
    symbol that stands before it in the transform, and the end of the new interval, if none was
    found there before, divides suffixes that agree in as many symbols as the string had. Only
    such intervals are extended again, and none to more than ``length`` symbols. Symbol 0
    separates strings: it ends strings, but none goes on over it. Suffixes shorter than
    ``length`` may be put in any group.
    """
    n = len(symbols)
    order, place = _order(symbols, length + 1)
    first = symbols[order]
    before = np.where(order > 0, place[order - 1], -1)
    before[(order > 0) & (symbols[order - 1] == SEPARATOR)] = -1
    divided = np.zeros(n + 1, bool)
    divided[0] = divided[n] = True
    divided[1:n] = first[1:] != first[:-1]
    ends = np.flatnonzero(divided)
    low, high = ends[:-1], ends[1:]
    for _ in range(length - 1):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        rows = before[np.arange(sizes.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)]
        inside = rows >= 0
        both = np.sort(rows[inside].astype(np.uint64) << np.uint64(32) | owner[inside].astype(np.uint64))
        if not len(both):
            break
        rows, owner = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[rows[1:]] != first[rows[:-1]])))
        starts = np.flatnonzero(new)
        low, high = rows[starts], rows[np.concatenate((starts[1:] - 1, [len(rows) - 1]))] + 1
        fresh = ~divided[high]
        low, high = low[fresh], high[fresh]
        divided[high] = True
    return order, np.cumsum(divided[:n])


def later_copies(
    strings: Sequence[bytes], ids: np.ndarray, starts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and starts of the strings of ``length`` bytes that also start earlier, by id and then
    start, in the same or another string; ``ids`` and ``starts`` place each string."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    symbols[ends - 1] = SEPARATOR
    order, group = equal_prefix_groups(symbols, length)
    string = np.repeat(np.arange(len(strings)), sizes)[order]
    offset = order - (ends - sizes)[string]
    whole = offset + length < sizes[string]
    group, string, offset = group[whole], string[whole], offset[whole]
    own, at = ids[string], starts[string] + offset
    by = np.lexsort((at, own, group))
    group, own, at = group[by], own[by], at[by]
    head = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else head
    later = (own != own[lead]) | (at != at[lead])
    return own[later], at[later]
