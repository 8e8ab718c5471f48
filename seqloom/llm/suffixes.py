"""Suffix sorting by the linear grouping construction.

Suffixes are grouped by their Lyndon prefixes, the greatest group first. A group's suffixes point to the nearest earlier
suffix of a smaller group; how often a suffix is pointed to by one group tells how many copies of that group's prefix
follow its own, and so splits its group. When all groups are done, one pass in rising order places each suffix at the
next free place of its group, following the same pointers; no group is named or sorted again.

Only the alphabet is sorted. The suffixes of a group are a linked list in text order, so they leave it in constant time,
and pointers computed in text order only ever grow, so those that a group points to are met in text order too. A pointer
once set is jumped over and not walked again. All of it takes time in proportion to the number of symbols.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of symbols (non-negative) in rising order; an end is smaller than any symbol."""
    s = [*symbols, -1]
    n = len(s)
    places: dict[int, list[int]] = {}
    for x, c in enumerate(s):
        places.setdefault(c, []).append(x)
    start, size, head, ending = [0] * n, [0] * n, [0] * n, [0] * (n + 1)  # by place; the rest by a group's first rank
    ahead, behind = [-1] * n, [-1] * n  # neighbours of a place in its group's list

    def new_group(at: int, members: list[int]) -> int:
        head[at], size[at], before_it = members[0], len(members), -1
        for x in members:
            start[x], behind[x] = at, before_it
            if before_it >= 0:
                ahead[before_it] = x
            before_it = x
        ahead[before_it] = -1
        ending[at + len(members)] = at
        return at + len(members)

    top = 0
    for c in sorted(places):
        top = new_group(top, places[c])
    before = [-1] * n
    while top:
        low = ending[top]
        pointed: dict[int, int] = {}
        x = head[low]
        while x >= 0:
            p = x - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[x] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
            x = ahead[x]
        split: dict[int, dict[int, list[int]]] = {}  # group -> how often -> its places
        for p, often in pointed.items():
            split.setdefault(start[p], {}).setdefault(often, []).append(p)
        for group, by_count in split.items():
            moved = sum(map(len, by_count.values()))
            at = group + size[group] - moved
            if at > group:
                for own in by_count.values():
                    for p in own:
                        a, b = behind[p], ahead[p]
                        if a >= 0:
                            ahead[a] = b
                        else:
                            head[group] = b
                        if b >= 0:
                            behind[b] = a
                size[group] -= moved
                ending[at] = group
            for often in range(1, max(by_count) + 1):
                if often in by_count:
                    at = new_group(at, by_count[often])
        top = low
    out, free_at, placed = [n - 1] * n, list(range(n)), [False] * n
    placed[n - 1] = True
    for k in range(n):
        x = out[k] - 1
        while x >= 0 and not placed[x]:
            g = start[x]
            out[free_at[g]] = x
            free_at[g] += 1
            placed[x] = True
            x = before[x]
    return out[1:]
