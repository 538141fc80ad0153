"""Plain versions of the corpus operators, straight from their definitions."""

import hashlib
import re
from fractions import Fraction
from math import floor

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else bytes(x)).hexdigest()


def key(i):
    return -(2**63) if i is None else i


def windows(rows, width=13):
    """(doc_id, words, removed, hash of what is kept) of each (doc_id, text)."""
    first, out = {}, []
    found = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, x in found:
        for k in range(len(x) - width + 1):
            w = tuple(x[k : k + width])
            first[w] = min(first.get(w, key(i)), key(i))
    for i, x in found:
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[tuple(x[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        out.append((i, len(x), sum(gone), sha(" ".join(a for a, g in zip(x, gone, strict=True) if not g))))
    return out


def substrings(rows, width=100):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, x in data:
        for k in range(len(x) - width + 1):
            w = x[k : k + width]
            first[w] = min(first.get(w, (key(i), k)), (key(i), k))
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1):
            if first[x[k : k + width]] < (key(i), k):
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), len(x) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def shingles(t, size=5):
    x = WORD.findall(lower(t or ""))
    if not x:
        return set()
    return {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if len(x) >= size else {tuple(x)}


def jaccard(rows):
    """(doc_id, set size, component); rows without a doc_id link with nothing."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders = {}
    for n, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holders.setdefault(x, []).append(n)
    links, seen = [], set()
    for group in holders.values():
        for a in range(len(group)):
            for b in range(a):
                seen.add((group[b], group[a]))
    for a, b in seen:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 80 * len(sets[a][1] | sets[b][1]):
            links.append((sets[a][0], sets[b][0]))
    root = roots({i for i, _ in sets if i is not None}, links)
    return [(i, len(s), root.get(i)) for i, s in sets]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def cosines(rows, least=0.9):
    """(vec_id, links, component, kept)."""
    good = [(i, np.asarray(v, np.float64) / np.abs(v).max(), n) for n, (i, v) in enumerate(rows) if i is not None and sound(v) and any(v)]
    unit = [v / np.linalg.norm(v) for _, v, _ in good]
    count, links = {}, []
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links.append((good[a][0], good[b][0]))
                for x in (a, b):
                    count[good[x][2]] = count.get(good[x][2], 0) + 1
    root = roots({i for i, _ in rows if i is not None}, links)
    return [(i, count.get(n, 0), root.get(i), root.get(i) == i) for n, (i, _) in enumerate(rows)]


def top_k(rows, k=5):
    good = [(i, [floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            got = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got[:k])]
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out)
