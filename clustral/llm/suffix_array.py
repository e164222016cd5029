"""Suffix arrays by linear grouping (Baier's construction), and their longest common prefixes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffixes of text in order; its last letter must be smaller than all others.

    First suffixes are grouped by their longest Lyndon prefix: groups are processed in descending order; each suffix of a
    group gets a pointer to the last suffix before it of a lower group, and the suffixes pointed at move up, those with
    more pointers further. Then each group's order is emitted: the suffixes before those already placed, along their
    pointers, take the next places of their groups. Nothing is renamed, there is no recursion.
    """
    s = np.asarray(text)
    n = len(s)
    if not n:
        return []
    order = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[order][1:] != s[order][:-1]
    first = np.flatnonzero(new)
    where = np.empty(n, np.int64)
    where[order] = np.repeat(first, np.diff(np.append(first, n)))
    group = where.tolist()
    bounds = np.append(first, n).tolist()
    size, start, held = [0] * (n + 1), [0] * (n + 1), {}
    ranked = order.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        size[a], start[b], held[a] = b - a, a, ranked[a:b]
    before = [-1] * n
    end = n
    while end:
        g = start[end]
        pointed: dict[int, int] = {}
        for i in sorted(x for x in held.pop(g) if group[x] == g):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, count in pointed.items():
                moves.setdefault((-count, group[p]), []).append(p)
            for (_, h), own in sorted(moves.items(), key=lambda x: x[0]):
                rest = size[h] - len(own)
                if rest:
                    up = h + rest
                    size[h], size[up], start[h + rest + len(own)], start[up], held[up] = rest, len(own), up, h, own
                    for p in own:
                        group[p] = up
        end = g
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    top = list(range(n + 1))
    top[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[top[g]] = j
            placed[j] = True
            top[g] += 1
            j = before[j]
    return out


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """For each place of the suffix array but the first, the letters that suffix shares with the one before it."""
    n = len(text)
    rank, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            out[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out
