"""Plain-Python versions that the operators are compared with."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text):
    return WORD.findall(text or "")


def substring(rows, window=20):
    """rows: (doc_id, text) -> kept words of each row; rows equal in both are one document."""
    def row(text):
        h = xxhash.xxh64_intdigest(hashlib.md5((text or "").encode()).digest(), seed=42)
        return h - 2**64 if h >= 2**63 else h

    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, row(r[1])))
    seen, kept = set(), {}
    for doc, text in order:
        ws = word_list(text)
        stays = [True] * len(ws)
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s:s + window])
            if w in seen:
                stays[s:s + window] = [False] * window
            seen.add(w)
        kept[doc, text] = [w for w, k in zip(ws, stays) if k]
    return kept


def shingle_set(text, size=5):
    ws = word_list(text)
    n = min(size, len(ws))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def near_classes(rows, similarity=0.8):
    """rows: (doc_id, text), ids distinct -> {doc_id: least id of its class}."""
    sets = {d: shingle_set(t) for d, t in rows}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for o in set().union(*[by[x] for x in s]) if s else ():
            if o < d:
                common = len(s & sets[o])
                if common >= similarity * (len(s) + len(sets[o]) - common):
                    a, b = sorted((find(d), find(o)))
                    root[b] = a
    return {d: find(d) for d in sets}


def best_fit(lengths, capacity):
    """Sequences that best fit decreasing opens, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def jump_hash(key, shards):
    """The published loop."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b
