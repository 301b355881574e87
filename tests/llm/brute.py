"""Plain versions of the operators, straight from their definitions."""

import re
from collections import Counter

import xxhash


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


WORD3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD5 = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, size=10):
    """docs, items: (id, text). Per document: n_words, hit positions, item ids."""
    wins = {}
    for i, t in items:
        w = WORD3.findall(fold(t))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w = WORD3.findall(fold(t))
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[x]
        out[d] = (len(w), hit, ids)
    return out


def simhash(t, size=3):
    w = WORD5.findall(fold(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius=2):
    """prints: id -> fingerprint; the smallest id reachable."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def quality(t):
    t = t or ""
    w = WORD5.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD5.search(x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def repeats(texts, size=200):
    """Per text: the bytes that lie in no string of ``size`` bytes that starts twice, how many went, and in how many runs."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(gone), runs))
    return out
