"""Suffix sorting by linear grouping: Lyndon-prefix groups first, then their inner order.

First phase: suffixes start out grouped by their first symbol.  Groups are
processed in descending order.  When a group's turn comes its common prefix
is the longest Lyndon prefix of its members and final.  A member's pointer
leads to the previous position of a smaller group; that position's own
prefix grows by the member's, once for each member that points to it, so it
moves to a new group right behind its old one.  Second phase: in ascending
order of rank, each suffix x places those whose Lyndon prefix ends at x into
the next free place of their groups.  Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer string in ascending order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    by = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.r_[True, symbols[by[1:]] != symbols[by[:-1]]])
    index = np.zeros(n, np.int64)
    index[by] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))
    group = index.tolist()
    bounds = np.r_[heads, n].tolist()
    flat = by.tolist()
    members = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
    below = list(range(-1, len(members) - 1))  # the group before and the group after each group
    above = [*range(1, len(members)), -1]
    done = [False] * len(members)
    prev = [-1] * n

    finished = []  # groups in descending order
    g = len(members) - 1
    while g >= 0:
        mine = members[g] = [s for s in members[g] if group[s] == g]
        grown: dict[int, int] = {}  # position -> members that point to it
        for s in mine:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = prev[p]
            if p >= 0 and group[p] == g:
                p = prev[p]  # a run of the same prefix: both follow the same smaller position
            prev[s] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        done[g] = True
        finished.append(g)
        split: dict[int, dict[int, list[int]]] = {}  # old group -> times -> positions in ascending order
        for p, times in grown.items():
            parts = split.setdefault(group[p], {})
            if times in parts:
                parts[times].append(p)
            else:
                parts[times] = [p]
        for old, parts in split.items():
            under, over = old, above[old]
            for times in sorted(parts):  # more repeats of the larger prefix stand higher
                new = len(members)
                members.append(parts[times])
                done.append(False)
                below.append(under)
                above.append(-1)
                above[under] = new
                for p in parts[times]:
                    group[p] = new
                under = new
            above[under] = over
            if over >= 0:
                below[over] = under
        g = below[g]

    place = [0] * len(members)  # order of each group
    free = [0] * len(members)  # next free rank of each place
    at = 0
    for k, g in enumerate(reversed(finished)):
        place[g], free[k] = k, at
        at += len(members[g])
    rank = [place[g] for g in group]
    order = [0] * n
    p = n - 1
    while p >= 0:  # those with no smaller suffix behind them
        r = rank[p]
        order[free[r]] = p
        free[r] += 1
        p = prev[p]
    for i in range(n):
        x = order[i]
        p, here = x - 1, rank[x]
        while p >= 0 and rank[p] > here:
            r = rank[p]
            order[free[r]] = p
            free[r] += 1
            p = prev[p]
        if p >= 0 and rank[p] == here:
            order[free[here]] = p
            free[here] += 1
    return np.array(order, np.int64)
