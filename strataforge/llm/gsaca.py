"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix, from the greatest group to the least. Each suffix of the group at hand
points at its nearest predecessor in a smaller group; whatever is pointed at has a prefix that goes on with the group's
prefix, once per pointer, so it moves up within its own group, the more pointers the higher, and its prefix grows by
theirs. Afterwards all of a group shares one Lyndon prefix, and behind it stands a smaller suffix: going through
the suffixes in order, each puts those that end their prefix where it starts to the next place of their group. Nothing
is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def radix_order(values: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers of 0 or more, digit by digit of 16 bits: for those numpy's stable sort is a counting sort."""
    order = np.arange(len(values))
    top = int(values.max(initial=0))
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = (values >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of whole numbers of 0 or more; a shorter suffix comes before one that it begins."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = radix_order(text)
    values = text[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    size = np.diff(np.r_[first, n])
    group = np.empty(n, np.int64)  # by suffix: the first place of its group
    group[order] = np.repeat(first, size)
    sa, where, group = order.tolist(), [0] * n, group.tolist()
    for i, s in enumerate(sa):
        where[s] = i
    last = [0] * n  # by first place: the group's last place
    for a, m in zip(first.tolist(), size.tolist(), strict=True):
        last[a] = a + m - 1
    smaller, length = [-2] * n, [1] * n  # -2: not known yet
    i = n - 1
    while i >= 0:
        s = sa[i]
        begin = group[s]
        if begin == i:  # a group of one
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                length[p] += length[s]
                h = group[p]
                e = last[h]
                if e != h:
                    k = where[p]
                    if k != e:
                        other = sa[e]
                        sa[k], where[other] = other, k
                        sa[e], where[p] = p, e
                    last[h] = e - 1
                    group[p] = last[e] = e
        else:
            grow = length[s]
            pointers: dict[int, int] = {}
            for s in sa[begin : i + 1]:
                waiting = []  # members of the group before ``s`` that are not done yet
                while smaller[s] == -2:
                    waiting.append(s)
                    p = s - 1
                    while p >= 0 and group[p] > begin:
                        p = smaller[p]
                    if p < 0 or group[p] < begin:
                        smaller[s] = p
                    else:
                        s = p
                p = smaller[s]
                for s in waiting:
                    smaller[s] = p
                    if p >= 0:
                        pointers[p] = pointers.get(p, 0) + 1
            # By the number of pointers, the most first: as many steps as there are pointers at most.
            by_count: list[list[int]] = []
            for p, c in pointers.items():
                length[p] += c * grow
                while len(by_count) <= c:
                    by_count.append([])
                by_count[c].append(p)
            moved: dict[int, list[tuple[int, int]]] = {}
            for c in range(len(by_count) - 1, 0, -1):
                for p in by_count[c]:
                    h = group[p]
                    if h in moved:
                        moved[h].append((c, p))
                    else:
                        moved[h] = [(c, p)]
            for h, those in moved.items():
                if last[h] == h:
                    continue
                e, at = last[h], 0
                whole = len(those) == e - h + 1
                while at < len(those):
                    c, stop, top = those[at][0], at, e
                    while at < len(those) and those[at][0] == c:
                        p = those[at][1]
                        k = where[p]
                        if k != e:
                            other = sa[e]
                            sa[k], where[other] = other, k
                            sa[e], where[p] = p, e
                        e -= 1
                        at += 1
                    if whole and at == len(those):  # nothing is left below: the group itself
                        last[h] = top
                    else:
                        last[e + 1] = top
                        for _, p in those[stop:at]:
                            group[p] = e + 1
                if not whole:
                    last[h] = e
        i = begin - 1
    end = np.arange(n) + np.array(length)
    ends: list[int] = radix_order(end).tolist()
    stop = np.r_[0, np.cumsum(np.bincount(end, minlength=n + 2))].tolist()
    nxt = list(range(n))  # by first place: where the group's next suffix goes
    out = [0] * n
    for k in range(stop[n], stop[n + 1]):
        s = ends[k]
        g = group[s]
        out[nxt[g]] = s
        nxt[g] += 1
    for s in out:  # ``out`` fills up ahead of this loop
        for k in range(stop[s], stop[s + 1]):
            j = ends[k]
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
    return np.array(out)
