"""Plain restatements of what the operators must give."""

from collections import defaultdict

import regex


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingles(text, n=5):
    own = words(text)
    if len(own) < n:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}


def near(texts, threshold=0.8):
    """{id: (class, links)} over {id: text}."""
    sets = {k: shingles(v) for k, v in texts.items()}
    where, common = defaultdict(list), defaultdict(int)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    root, links = {k: k for k in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (find(k), links[k]) for k in sets}


def leaks(texts, items, least=0.8):
    """{(doc, item, shared)}: items of equal shingle sets are the smallest id."""
    sets = {}
    for k in sorted(items):
        s = frozenset(shingles(items[k]))
        if s and s not in sets.values():
            sets[k] = s
    out = set()
    for d, t in texts.items():
        own = shingles(t)
        for k, s in sets.items():
            if len(own & s) >= least * len(s) - 1e-9:
                out.add((d, k, len(own & s)))
    return out


def cut_repeats(rows, length):
    """For each byte string: kept bytes, removed bytes and removed runs."""
    counts = defaultdict(int)
    for t in rows:
        for p in range(len(t) - length + 1):
            counts[t[p : p + length]] += 1
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, x in zip(t, gone) if not x), sum(gone), spans))
    return out
