"""Suffix arrays by linear grouping, for many strings at once.

Every suffix belongs to the group of its Lyndon prefix. Phase one takes a string's
groups in descending order: each member finds, over previous-smaller pointers, the
nearest suffix before it in a lower group, and the prefix of that suffix grows by
what the members hold; suffixes with equal new prefixes form a group right above
their old one. Groups are then final and in order. Phase two emits each group's
order: the suffixes whose Lyndon prefix ends where the next smallest suffix starts
are appended to their groups, again over the pointers. Nothing is renamed and
nothing recurses.

The strings are independent, so all of them take each step together, as one array
operation; the number of steps is that of the string with the most groups.
"""

from __future__ import annotations

import numpy as np

from permeon.llm.common import ragged


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions in suffix order, string by string; string i is symbols[bounds[i]:bounds[i + 1]].

    The end of a string is smaller than any symbol. Positions count from the start
    of ``symbols``.
    """
    bounds = np.asarray(bounds, np.int64)
    sizes = np.diff(bounds)
    bounds = np.append(bounds[:-1][sizes > 0], bounds[-1])
    if not len(symbols):
        return np.zeros(0, np.int64)
    group, pointer = _group(symbols, bounds)
    return _emit(group, pointer, bounds)


def _group(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: every suffix's final group, named by where it starts in the order, and its pointer (-1: none)."""
    n = len(symbols)
    base, sizes = bounds[:-1], np.diff(bounds)
    owner = np.repeat(np.arange(len(base)), sizes)
    key = owner * (int(symbols.max()) + 1) + symbols
    at = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    heads = np.flatnonzero(np.concatenate(([True], key[at][1:] != key[at][:-1])))
    group = np.empty(n, np.int64)
    group[at] = np.repeat(heads, np.diff(np.append(heads, n)))
    count = np.zeros(n, np.int64)
    count[heads] = np.diff(np.append(heads, n))
    # One more cell, for "none" (-1), that is in no group.
    group, pointer, moved = np.append(group, -1), np.full(n + 1, -1), np.zeros(n + 1, bool)
    first = np.zeros(n, bool)
    first[base] = True

    top = bounds[1:] - 1
    while len(base):
        start = group[at[top]]
        size = top - start + 1
        members = at[ragged(start, size)]
        own = np.repeat(start, size)
        before = np.where(first[members], -1, members - 1)
        todo = np.flatnonzero(group[before] > own)
        while len(todo):
            before[todo] = pointer[before[todo]]
            todo = todo[group[before[todo]] > own[todo]]
        pointer[members] = before
        todo = np.flatnonzero(group[before] == own)
        while len(todo):
            before[todo] = pointer[before[todo]]
            pointer[members[todo]] = before[todo]
            todo = todo[group[before[todo]] == own[todo]]

        grown, times = np.unique(before[before >= 0], return_counts=True)
        if len(grown):
            old = group[grown]
            order = np.lexsort((times, old))
            grown, times, old = grown[order], times[order], old[order]
            new_old = np.concatenate(([True], old[1:] != old[:-1]))
            begins = np.flatnonzero(new_old)
            many = np.diff(np.append(begins, len(old)))
            names = old[begins]
            tail = names + count[names] - many
            target = ragged(tail, many)
            # Members that stay but lie in the tail change places with those that move there.
            moved[grown] = True
            there = at[target]
            stays = there[~moved[there]]
            free = place[grown]
            free = free[free < np.repeat(tail, many)]
            moved[grown] = False
            at[free], place[stays] = stays, free
            at[target], place[grown] = grown, target
            count[names] -= many
            fresh = np.flatnonzero(new_old | np.concatenate(([True], times[1:] != times[:-1])))
            members_of = np.diff(np.append(fresh, len(old)))
            group[grown] = np.repeat(target[fresh], members_of)
            count[target[fresh]] = members_of
        top = start - 1
        left = top >= base
        top, base = top[left], base[left]
    return group[:-1], pointer[:-1]


def _emit(group: np.ndarray, pointer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phase two: the suffixes of every string in order."""
    n = len(group)
    base, sizes = bounds[:-1], np.diff(bounds)
    order = np.full(n, -1)
    fill = np.arange(n)
    done = np.zeros(n + 1, bool)
    done[-1] = True
    first = np.zeros(n, bool)
    first[base] = True

    def append(j: np.ndarray) -> None:
        """Appends each suffix of ``j``, and those that its pointers lead to, until one is there already."""
        while len(j):
            to = group[j]
            order[fill[to]] = j
            fill[to] += 1
            done[j] = True
            j = pointer[j]
            j = j[~done[j]]

    append(bounds[1:] - 1)
    longest = np.argsort(-sizes, kind="stable")
    base, sizes = base[longest], sizes[longest]
    alive = len(base)
    for step in range(int(sizes[0])):
        while sizes[alive - 1] <= step:
            alive -= 1
        s = order[base[:alive] + step]
        j = np.where(first[s], -1, s - 1)
        append(j[~done[j]])
    return order
