"""Suffix arrays of many short strings at once, by grouping: linear work, no recursion and no renaming.

Suffixes that begin with the same Lyndon prefix form a group. Phase one takes the groups of a string in descending order. Each suffix of the group
gets its pointer to the nearest earlier suffix of a lower group, found by following the pointers of those in between. The suffixes that are
pointed at leave their groups for new ones right above the old: the more pointers a suffix got from the group, the higher its new one.
At the end the groups are those of equal Lyndon prefixes. Phase two goes up the suffix array: the suffix before the one just met, and all that its
pointers lead to, take the next free places of their groups, until one that has its place.

All strings step together: in each step every string that is not done handles its next group (phase one) or place (phase two), on NumPy arrays.
"""

from __future__ import annotations

import numpy as np


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (lengths[i] of them), one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, string by string, in ascending order within each string.

    symbols: the strings one after the other, lengths[i] symbols each; every string ends with a symbol 0, which occurs nowhere else.
    """
    n = len(symbols)
    lengths = np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    if not n:
        return np.zeros(0, np.int64)
    # position 0 stands for "before the first": it is in no group
    off = 1 + np.cumsum(lengths) - lengths
    text = np.concatenate(([0], symbols.astype(np.int64)))
    group, size, before = _grouped(text, off, lengths)
    return _emitted(off, lengths, group, before) - 1


def _grouped(text: np.ndarray, off: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase one: for each position the first place of its group, the sizes of groups by their first place, and the pointers (0: none)."""
    n = len(text)
    owner = np.repeat(np.arange(len(off)), lengths)
    keys = owner * (int(text.max()) + 1) + text[1:]
    at = np.concatenate(([0], 1 + np.argsort(keys, kind="stable")))
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    ordered = keys[at[1:] - 1]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = 1 + np.flatnonzero(first)
    size = np.zeros(n + 1, np.int64)
    size[starts] = np.diff(np.concatenate((starts, [n])))
    group = np.full(n, -1, np.int64)
    group[at[1:]] = np.repeat(starts, size[starts])
    before = np.zeros(n, np.int64)
    moving = np.zeros(n, bool)
    low, end = off.copy(), off + lengths
    while len(end):
        begin = group[at[end - 1]]
        m = end - begin
        member = at[_ragged(begin, m)]
        own, lowest = np.repeat(begin, m), np.repeat(low, m)
        # the nearest earlier suffix of a lower group: over those in between by their own pointers
        cur = member - 1
        before[member] = cur
        open_ = np.flatnonzero(group[cur] >= own)
        while len(open_):
            cur[open_] = before[cur[open_]]
            before[member[open_]] = cur[open_]
            open_ = open_[group[cur[open_]] >= own[open_]]
        cur[cur < lowest] = 0
        before[member] = cur
        parent = cur[cur > 0]
        if len(parent):
            _raise(parent, at, place, group, size, moving)
        more = begin > low
        low, end = low[more], begin[more]
    return group, size, before


def _raise(pointed: np.ndarray, at: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, moving: np.ndarray) -> None:
    """Moves the suffixes that were pointed at to new groups right above their old ones, by the number of pointers."""
    p, hits = np.unique(pointed, return_counts=True)
    old = group[p]
    order = np.lexsort((hits, old))
    p, hits, old = p[order], hits[order], old[order]
    new_old = np.concatenate(([True], old[1:] != old[:-1]))
    runs = np.flatnonzero(new_old)
    q = np.diff(np.concatenate((runs, [len(p)])))
    olds = old[runs]
    left = size[olds] - q
    tail = olds + left
    slot = _ragged(tail, q)
    # others leave the tail of the group for the places of those that move there
    moving[p] = True
    others = at[slot]
    others = others[~moving[others]]
    moving[p] = False
    places = place[p]
    freed = places[places < np.repeat(tail, q)]
    at[freed] = others
    place[others] = freed
    at[slot] = p
    place[p] = slot
    sub = np.flatnonzero(new_old | np.concatenate(([True], hits[1:] != hits[:-1])))
    count = np.diff(np.concatenate((sub, [len(p)])))
    size[olds] = left
    size[slot[sub]] = count
    group[p] = np.repeat(slot[sub], count)


def _emitted(off: np.ndarray, lengths: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phase two: the suffixes in ascending order."""
    n = len(group)
    out = np.zeros(n, np.int64)
    free = np.arange(n + 1)  # the next free place of the group that begins here
    done = np.zeros(n, bool)
    done[0] = True
    last = off + lengths - 1
    out[off], done[last] = last, True
    i, end, cur = off.copy(), off + lengths, last - 1
    lowest = off
    cur = np.where(cur < lowest, 0, cur)
    while len(i):
        for _ in range(16):
            fresh = ~done[cur]
            put = cur[fresh]
            g = group[put]
            slot = free[g]
            out[slot] = put
            free[g] = slot + 1
            done[put] = True
            i = i + ~fresh
            nxt = out[np.minimum(i, end - 1)] - 1
            nxt[nxt < lowest] = 0
            cur = np.where(fresh, before[cur], nxt)
        more = i < end
        i, end, cur, lowest = i[more], end[more], cur[more], lowest[more]
    return out[1:]
