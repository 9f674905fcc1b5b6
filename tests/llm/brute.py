"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def key(i):
    return (i is not None, i if i is not None else 0)


def substring(rows, size=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)]"""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - size + 1):
            w = b[p:p + size]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < key(i):
                gone[p:p + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rows, size=20):
    data = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in data:
        for p in range(len(w) - size + 1):
            g = tuple(w[p:p + size])
            first[g] = min(first.get(g, (key(i), p)), (key(i), p))
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < (key(i), p):
                gone[p:p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[p:p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, percent):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            where[g].append(n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for m in where[g]:
                if m < n:
                    common[m] += 1
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                root[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        r = find(n)
        k = (i is None, i if i is not None else 0)
        least[r] = min(least.get(r, k), k)
    return [(i, len(sets[n]), i if not sets[n] else None if least[find(n)][0] else least[find(n)][1]) for n, (i, _) in enumerate(rows)]


def contaminated(rows, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, t in items:
        w = word.findall(lower(t or ""))
        for p in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[p:p + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p:p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
