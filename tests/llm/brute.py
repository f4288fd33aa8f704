"""Plain restatements that the tests hold operators against."""

import re
from collections import Counter


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def similar_groups(rows, width=3, percent=85):
    """id -> (set size, least id reachable) by comparing every pair that shares a shingle."""
    sets, parent, holders = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}
