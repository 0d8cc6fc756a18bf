"""Plain versions of operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def groups(texts, size, percent=80):
    """{id: (set size, smallest reachable id)}: every pair that shares a shingle among
    the rarest that two similar sets must share is compared."""
    sets = {i: shingle_set(t, size) for i, t in texts}
    often = defaultdict(int)
    for s in sets.values():
        for x in s:
            often[x] += 1
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        s = sets[i]
        rare = sorted(s, key=lambda x: (often[x], x))
        seen = set()
        for x in rare[: len(s) - -(-percent * len(s) // 100) + 1]:
            for j in index[x]:
                if j not in seen:
                    seen.add(j)
                    both = len(s & sets[j])
                    if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                        a, b = root(i), root(j)
                        parent[max(a, b)] = min(a, b)
            index[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}
