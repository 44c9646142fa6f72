"""Suffix arrays by linear grouping, for many short strings side by side.

The first phase refines groups of suffixes until each holds those with the same Lyndon prefix.
Groups are taken from the highest down; each suffix of the group points to the nearest earlier
suffix of a lower group (its previous-smaller pointer), and those pointed at move up within their
groups by how many point at them, their prefixes growing accordingly.  The second phase goes from
the lowest group up and emits each group in the order of what follows its members' prefixes, which
is placed already: no renaming, no recursion.

Every string takes its own next group in each step, and all of a step is done in numpy at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal tuples begins, and one past the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def group_suffixes(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase one: suffixes in group order, each suffix's place and group (its first place), and its Lyndon prefix's length.

    ``text``: small non-negative integers; string k is text[first[k]:first[k + 1]], ended by a value
    that is smaller than its others.
    """
    n = len(text)
    lane = np.repeat(np.arange(len(first) - 1), np.diff(first))
    code = lane * (int(text.max(initial=0)) + 1) + text
    order = np.argsort(code, kind="stable")
    starts = _edges(code[order])
    sizes = np.diff(starts)
    size = np.zeros(n, np.int64)
    size[starts[:-1]] = sizes
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(starts[:-1], sizes)
    group[n] = -1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.arange(-1, n - 1)
    before[first[:-1][first[:-1] < first[1:]]] = n
    previous = np.full(n + 1, n, np.int64)
    length = np.ones(n, np.int64)
    moving = np.zeros(n, bool)
    end, low = first[1:].copy(), first[:-1]
    active = np.flatnonzero(end > low)
    while len(active):
        stop = end[active]
        a = group[order[stop - 1]]
        count = stop - a
        s = order[_ranges(a, count)]
        now = np.repeat(a, count)
        p = before[s]
        previous[s] = p
        while True:
            above = np.flatnonzero(group[p] >= now)
            if not len(above):
                break
            p[above] = previous[p[above]]
            previous[s[above]] = p[above]
        real = np.flatnonzero(p < n)
        if len(real):
            u, at, times = np.unique(p[real], return_index=True, return_counts=True)
            grown = times * length[s[real[at]]]
            home = group[u]
            by = np.lexsort((times, home))
            u, times, home = u[by], times[by], home[by]
            length[u] += grown[by]
            blocks = _edges(home)
            m = np.diff(blocks)
            homes = home[blocks[:-1]]
            tail = homes + size[homes] - m
            slot = _ranges(tail, m)
            old = place[u]
            moving[u] = True
            there = order[slot]
            pushed = there[~moving[there]]
            free = old[old < np.repeat(tail, m)]
            order[free], place[pushed] = pushed, free
            order[slot], place[u] = u, slot
            moving[u] = False
            parts = _edges(home, times)
            k = np.diff(parts)
            size[homes] -= m
            size[slot[parts[:-1]]] = k
            group[u] = np.repeat(slot[parts[:-1]], k)
        end[active] = a
        active = active[a > low[active]]
    return order, place, group[:n], length


def suffix_arrays(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The suffixes (places in ``text``) of every string in lexicographic order, string after string."""
    order, place, group, length = group_suffixes(text, first)
    n = len(text)
    if not n:
        return order
    starts = _edges(group[order])
    sizes = np.diff(starts)
    rank = np.full(n + 1, -2, np.int64)
    rank[n] = -1
    single = order[starts[:-1][sizes == 1]]
    rank[single] = place[single]
    big, many = starts[:-1][sizes > 1], sizes[sizes > 1]
    lane = np.searchsorted(first, big, "right") - 1
    lanes = _edges(lane) if len(lane) else np.zeros(1, np.int64)
    at, stop = lanes[:-1].copy(), lanes[1:]
    last = first[1:][np.searchsorted(first, np.arange(n), "right") - 1]
    while len(at):
        a, count = big[at], many[at]
        s = order[_ranges(a, count)]
        home = np.repeat(np.arange(len(a)), count)
        follow = s + length[s]
        follow[follow >= last[s]] = n
        front = a.copy()
        while len(s):
            key = rank[follow]
            known = np.flatnonzero(key != -2)
            by = known[np.lexsort((key[known], home[known]))]
            k = np.bincount(home[by], minlength=len(front))
            slot = _ranges(front, k)
            order[slot], rank[s[by]] = s[by], slot
            front += k
            rest = np.flatnonzero(key == -2)
            s, home, follow = s[rest], home[rest], follow[rest]
        at = at + 1
        going = at < stop
        at, stop = at[going], stop[going]
    return order
