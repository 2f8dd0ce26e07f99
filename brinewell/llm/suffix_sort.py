"""Suffix sorting by grouping, without recursion (after U. Baier, Linear-time suffix sorting, 2016; the members of a group
are put in order of place by a sort here, which isn't linear at worst).

Phase one sorts suffixes into groups of equal Lyndon prefix, from the highest group down: each member points to the nearest
place before it whose group is lower (its previous smaller one), and places that got equally many pointers from a group move
together into a new group just after their old one. Phase two fills the groups in order: when a suffix is emitted, those
whose Lyndon prefix ends where it starts follow from the pointers, and each takes the next free place of its group.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: bytes) -> list[int]:
    """Places of text in the order of the suffixes that start there; a shorter suffix goes before what it begins."""
    n = len(text) + 1  # with a sentinel below every byte
    counts = [0] * 257
    for c in text:
        counts[c + 1] += 1
    first, total = [0] * 257, 1
    for c in range(1, 257):
        first[c] = total
        total += counts[c]
    order, place, group, size = [0] * n, [0] * n, [0] * n, [0] * n
    order[0], place[n - 1], group[n - 1], size[0] = n - 1, 0, 0, 1
    free = first[:]
    for i, c in enumerate(text):
        g = first[c + 1]
        at = free[c + 1]
        free[c + 1] = at + 1
        order[at], place[i], group[i] = i, at, g
        size[g] += 1
    before = [-1] * n
    end = n
    while end > 1:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        end = start
        if not pointers:
            continue
        most = max(pointers.values())
        levels: list[tuple[int, list[int]]]
        if most == 1:
            levels = [(1, list(pointers))]
        else:
            by_count = defaultdict(list)
            for j, k in pointers.items():
                by_count[k].append(j)
            levels = sorted(by_count.items(), reverse=True)
        for _, chosen in levels:
            by_group: dict[int, list[int]] = {}
            for j in chosen:
                by_group.setdefault(group[j], []).append(j)
            for g, moved in by_group.items():
                left = size[g] - len(moved)
                if not left:
                    continue
                new = g + left
                at = g + size[g] - 1
                for j in moved:
                    other, p = order[at], place[j]
                    order[at], order[p], place[j], place[other] = j, other, at, p
                    group[j] = new
                    at -= 1
                size[g], size[new] = left, len(moved)
    out, free, done = [-1] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]
