"""Linear suffix sorting by Lyndon-prefix groups.

Suffixes are grouped by the Lyndon word they begin with, in one sweep from the greatest
group to the smallest: when a group is done, the suffixes that its members point back to
(their previous smaller suffixes) have their own prefix extended by it, and are split
from their groups by how often that happens. A second sweep then writes every group's
order directly, following the same pointers: no group is renamed and sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """The groups of suffixes in descending order, the group of each suffix, and its previous smaller suffix (-1: none)."""
    n = len(text)
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        starts.setdefault(c, []).append(i)
    members = [starts[c] for c in sorted(starts)]
    size = [len(m) for m in members]
    below = [*range(-1, len(members) - 1)]
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    done = bytearray(n)
    back = [-1] * n
    out: list[list[int]] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if size[g] != len(own):
            own = [i for i in own if group[i] == g]
        if own:
            out.append(own)
            times: dict[int, int] = {}
            for i in own:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = back[p]
                back[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            parts: dict[int, dict[int, list[int]]] = {}
            for p, k in times.items():
                parts.setdefault(group[p], {}).setdefault(k, []).append(p)
            for h, by_count in parts.items():
                if len(by_count) == 1 and sum(map(len, by_count.values())) == size[h]:
                    continue
                low, high = h, above[h]
                for k in sorted(by_count):
                    part = sorted(by_count[k])
                    new = len(members)
                    members.append(part)
                    size.append(len(part))
                    below.append(low)
                    above.append(high)
                    above[low] = new
                    low = new
                    size[h] -= len(part)
                    for p in part:
                        group[p] = new
                if high >= 0:
                    below[high] = low
        g = below[g]
    return out, group, back


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``text`` in lexicographic order; an empty text has none."""
    n = len(text)
    if not n:
        return []
    groups, group, back = lyndon_groups(text)
    front = [0] * (max(group) + 1)
    at = 0
    for own in reversed(groups):
        front[group[own[0]]] = at
        at += len(own)
    order = [-1] * n
    placed = bytearray(n)

    def put(p: int) -> None:
        while p >= 0 and not placed[p]:
            g = group[p]
            order[front[g]] = p
            front[g] += 1
            placed[p] = 1
            p = back[p]

    put(n - 1)  # what stands before the empty suffix, the smallest
    for i in range(n):
        put(order[i] - 1)
    return order
