"""Plain versions of what the operators do, for several test modules."""

import re
from collections import defaultdict
from itertools import combinations

from tessera.llm.words import words_of

PLAIN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def roots(nodes, pairs):
    above = {x: x for x in nodes}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute_components(rows, n, num):
    sets = {}
    for key, text in rows:
        if key is not None:
            words = [w.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(text)]
            sets[key] = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])
    seen = defaultdict(set)
    for key, values in sets.items():
        for x in values:
            seen[x].add(key)
    close = {p for keys in seen.values() if len(keys) < 2000 for p in combinations(sorted(keys), 2)}
    linked = [(a, b) for a, b in close if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    found = roots(sets, linked)
    return {key: (len(values), found[key]) for key, values in sets.items()}


def plain_base(text):
    spans = [("assign", m.start(), m.end()) for m in PLAIN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return spans + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]


def gapless(rows):
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    return sum(n for parts in by.values() for _, n in parts)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weight = {x: weights[k % 3] for k, x in enumerate(names)}
    stopped, left = {}, share * sum(sizes.values())
    while True:
        free = [x for x in names if x not in stopped]
        level = (left - sum(stopped.values())) / max(sum(weight[x] for x in free), 1e-9)
        over = [x for x in free if level * weight[x] > most * sizes[x]]
        if not over:
            return {x: stopped.get(x, level * weight[x]) for x in names}
        stopped |= {x: most * sizes[x] for x in over}
