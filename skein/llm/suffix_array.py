"""Suffix arrays by linear grouping: no recursion and no renaming."""

from __future__ import annotations


def suffix_array(s: bytes) -> list[int]:
    """Places of s's suffixes in lexical order (a suffix before those that it begins).

    Phase 1 keeps suffixes in groups that are ordered by the prefix their members have in common, at first one
    symbol. Groups are taken from the last to the first. Each member points at the nearest earlier suffix of a lower
    group; a suffix that k members point at has its own prefix prolonged by the group's prefix k times, so it moves
    behind the rest of its group, those with larger k further behind. In the end a group is what shares its longest
    Lyndon prefix. Phase 2 reads the order from left to right: the suffix before the one at hand, and whatever it
    points at in turn, takes the next place in its group, until one has been placed already.
    """
    n = len(s) + 1  # with an end mark below all symbols
    sym = [x + 1 for x in s]
    sym.append(0)
    start = [0] * 258
    for x in sym:
        start[x + 1] += 1
    for x in range(257):
        start[x + 1] += start[x]
    fill = start[:]
    order, group, place = [0] * n, [0] * n, [0] * n
    for i, x in enumerate(sym):
        k = fill[x]
        fill[x] = k + 1
        order[k] = i
        place[i] = k
        group[i] = start[x]
    last = {start[x]: fill[x] - 1 for x in range(257) if fill[x] > start[x]}  # of each group that is still to come
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        members = order[g : end + 1]
        if len(members) > 1:
            members.sort()
        hits: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if len(hits) == 1:
            levels = [hits]
        else:
            by: dict[int, list[int]] = {}
            for j, k in hits.items():
                by.setdefault(k, []).append(j)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            touched: dict[int, int] = {}
            for j in level:
                h = group[j]
                e = touched.get(h)
                if e is None:
                    e = last[h]
                k = place[j]
                if k != e:
                    other = order[e]
                    order[k] = other
                    place[other] = k
                    order[e] = j
                    place[j] = e
                touched[h] = e - 1
            for h, e in touched.items():
                top = last[h]
                if e < h:
                    continue  # the whole group was prolonged
                last[h] = e
                last[e + 1] = top
                for k in range(e + 1, top + 1):
                    group[order[k]] = e + 1
        end = g - 1
    out, at, done = [0] * n, {}, bytearray(n)
    at = group[:]  # group starts, by place
    nxt = list(range(n))
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = at[j]
            done[j] = 1
            out[nxt[g]] = j
            nxt[g] += 1
            j = prev[j]
    return out[1:]
