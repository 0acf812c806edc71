"""Suffix arrays of many short texts at once, by linear grouping.

Phase 1 groups suffixes by their Lyndon prefix. Groups start as first symbols and are processed in descending order. For each suffix of a
processed group the previous suffix of a smaller group is found by following pointers that skip suffixes of processed groups; a
suffix found so has its prefix extended by the group's prefix, as often as it was found, and moves to a new group just above
its old one, the more often the higher. Each suffix is processed once; when the lowest group is reached, a suffix's prefix is the longest
Lyndon word it begins with, and the suffix after it is its next smaller suffix.
Phase 2 emits the order from the smallest suffix up: when a suffix is emitted, the suffixes whose Lyndon prefix ends
where it begins take the next free places of their groups. Nothing is renamed and nothing is sorted recursively.

Texts are lanes that never interact, so one round does the same step in all lanes: numpy works on the members of
the highest group of every lane, and on the next suffix of every lane in phase 2.
"""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = np.cumsum(count, dtype=start.dtype)
    return np.arange(total[-1] if len(total) else 0, dtype=start.dtype) + np.repeat(start - (total - count), count)


def suffix_arrays(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The suffixes of each lane in ascending order, as places in ``symbols``, lane after lane.

    ``symbols``: the lanes one after another, of ``length`` symbols each. A lane's last symbol must be its smallest and occur
    once in it. Comparisons don't leave a lane.
    """
    lanes, n = len(length), len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    I = np.int32 if n < 1 << 30 else np.int64  # noqa: E741  half the memory traffic
    end = np.cumsum(length).astype(I)
    base = end - length.astype(I)
    lane = np.repeat(np.arange(lanes, dtype=I), length)
    # layout: suffixes by lane and first symbol; groups are runs of the layout, known by their first place
    layout = np.lexsort((symbols, lane)).astype(I)
    place = np.empty(n, I)
    place[layout] = np.arange(n, dtype=I)
    edge = np.ones(n, bool)
    edge[1:] = (symbols[layout][1:] != symbols[layout][:-1]) | (lane[layout][1:] != lane[layout][:-1])
    firsts = np.flatnonzero(edge).astype(I)
    group = np.empty(n + 1, I)
    group[layout] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    group[n] = -1  # what stands before a lane
    start_of, end_of = np.zeros(n + 1, I), np.zeros(n + 1, I)
    start_of[np.append(firsts[1:], n)] = firsts
    end_of[firsts] = np.append(firsts[1:], n)
    before = np.arange(-1, n, dtype=I)  # the last entry is never followed
    before[base] = n
    size = np.ones(n, I)
    moved = np.zeros(n, bool)

    top, active = end.copy(), np.arange(lanes, dtype=I)
    while len(active):
        e = top[active]
        s = start_of[e]
        count = e - s
        member = layout[ranges(s, count)]
        own = np.repeat(s, count)
        prev = before[member]
        late = np.flatnonzero(group[prev] >= own)
        while len(late):
            prev[late] = before[prev[late]]
            late = late[group[prev[late]] >= own[late]]
        before[member] = prev
        found = prev < n
        if found.any():
            p, unit = prev[found], size[member[found]]
            order = np.argsort(p, kind="stable")
            p = p[order]
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(p)))
            x, unit = p[at], unit[order][at]
            q = group[x]
            order = np.lexsort((times, q))
            x, unit, times, q = x[order], unit[order], times[order], q[order]
            new_q = np.ones(len(x), bool)
            new_q[1:] = q[1:] != q[:-1]
            at = np.flatnonzero(new_q)
            moving = np.diff(np.append(at, len(x)))
            stop = end_of[q[at]]
            rest = stop - moving  # the end of what stays
            target = ranges(rest, moving)
            # what stands on the targets and doesn't move goes where movers from elsewhere stood
            moved[x] = True
            standing = layout[target]
            standing = standing[~moved[standing]]
            was = place[x]
            free = was[was < np.repeat(rest, moving)]
            moved[x] = False
            layout[free], place[standing] = standing, free
            layout[target], place[x] = x, target
            run = new_q.copy()
            run[1:] |= times[1:] != times[:-1]
            at_run = np.flatnonzero(run)
            run_start = target[at_run]
            run_end = run_start + np.diff(np.append(at_run, len(x)))
            group[x] = np.repeat(run_start, run_end - run_start)
            size[x] += times * unit
            stays = rest > q[at]
            end_of[q[at][stays]] = rest[stays]
            start_of[rest[stays]] = q[at][stays]
            end_of[run_start], start_of[run_end] = run_end, run_start
        top[active] = s
        active = active[s > base[active]]

    after = np.arange(n, dtype=I) + size  # the next smaller suffix
    child = np.argsort(after, kind="stable").astype(I)
    bound = np.searchsorted(after[child], np.arange(n + 1, dtype=I)).astype(I)
    out = np.empty(n, I)
    out[base] = end - 1
    free = group[:n].copy()  # by first place: the next free place of a group
    free_of = np.arange(n + 1, dtype=I)
    step = 0
    by_length = np.argsort(length, kind="stable")
    sorted_length = length[by_length]
    while True:
        active = by_length[np.searchsorted(sorted_length, step, "right") :]
        if not len(active):
            break
        x = out[base[active] + step]
        many = bound[x + 1] - bound[x]
        y = child[ranges(bound[x], many)]
        y = y[y >= np.repeat(base[active], many)]  # a lane's last suffix has no children of another lane
        g = free[y]
        at = free_of[g]
        out[at] = y
        free_of[g] = at + 1
        step += 1
    return out
