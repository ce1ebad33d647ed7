"""Plain loops that say what the operators must return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = b" \t\n\x0b\x0c\r"


def ascii_lower(b: bytes) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), b)


def words(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower((text or "").encode()))


def substrings(rows, length=50):
    """Per row of (doc_id, text): bytes, removed, spans, sha256 of the rest."""
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def language_model(rows, order, weight):
    toks = [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [*words(t), "end"]) for d, t in rows]
    count, texts = [Counter() for _ in range(order + 1)], 0
    for _, held, w in toks:
        if held:
            continue
        texts += 1
        p = ["start", *w]
        for i in range(1, len(p)):
            for k in range(1, order + 1):
                if i - k + 1 >= (0 if k > 1 else 1):
                    count[k][tuple(p[i - k + 1 : i + 1])] += 1
    n, v = sum(count[1].values()), len(count[1])
    count[1][("start",)] = texts
    out = []
    for d, held, w in toks:
        p, base, score = ["start", *w], 0.0, 0.0
        for i in range(1, len(p)):
            q = (count[1][(p[i],)] + 1) / (n + v + 1)
            base += math.log10(q)
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    q = (count[k][tuple(p[i - k + 1 : i + 1])] + weight * q) / (count[k - 1][tuple(p[i - k + 1 : i])] + weight)
            score += math.log10(q)
        out.append((d, held, len(w), sum(count[1][(x,)] > 0 for x in w), n, base, score))
    return out


def walked(rows, order, weight):
    """The score of each text by an automaton of dictionaries: states, arcs and failure arcs, one word after the other."""
    count, texts = Counter(), 0
    toks = [(d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [*words(t), "end"]) for d, t in rows]
    for held, w in toks:
        if not held:
            texts += 1
            p = ["start", *w]
            for k in range(1, order + 1):
                count.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1) if k > 1 or i)
    one = {g: c for g, c in count.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    if texts:
        count["start",] = texts

    def arc(h, w):
        return (count[(*h, w)] + weight * arc(h[1:], w)) / (count[h] + weight) if h else (count[w,] + 1) / (n + v + 1)

    out = []
    for _, w in toks:
        state, score = (("start",) if texts and order > 1 else ()), 0.0
        for x in w:
            while state and (*state, x) not in count:
                score += math.log10(weight / (count[state] + weight))
                state = state[1:]
            score += math.log10(arc(state, x))
            state = (*state, x)
            while state and (len(state) >= order or state not in count):
                state = state[1:]
        out.append(score)
    return out


def simhash(text, width=3) -> int:
    w = words(text)
    runs = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def near_groups(rows):
    """Fingerprint and component of each doc_id; doc_ids must differ."""
    fps = {d: simhash(t) for d, t in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr[:k] ^ arr[k]) <= 2):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: (fps[i], find(i)) for i in ids}


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def shingle_groups(rows, width=5, tenths=8):
    """The smallest doc_id each doc_id is connected to by Jaccard similarities of so many tenths or more; doc_ids must differ."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    ids = sorted(sets)
    held = defaultdict(list)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        both = Counter(j for x in sets[i] for j in held[x])
        for j, n in both.items():
            if 10 * n >= tenths * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            held[x].append(i)
    return {i: find(i) for i in ids}


def bench_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower((text or "").encode()).decode())


def contamination(rows, items):
    win = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                win[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(x) for x in win}
    out = []
    for d, t in rows:
        w = bench_words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in win:
                    hit |= set(range(i, i + n))
                    found |= win[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def line_dedup(rows, min_docs=10):
    """Per row: lines, dropped, text left."""
    keyed = [[(x, ascii_lower(x.strip(SPACE))) for x in (t or "").encode().split(b"\n")] for _, t in rows]
    n = Counter(k for ls in keyed for k in {k for _, k in ls})
    out = []
    for (d, _), ls in zip(rows, keyed):
        kept = [x for x, k in ls if not k or n[k] < min_docs]
        out.append((d, len(ls), len(ls) - len(kept), b"\n".join(kept).decode()))
    return out


def smallest_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, s = (lo + hi) // 2, 1, 0
        for x in sizes:
            n, s = (n + 1, x) if s + x > mid else (n, s + x)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo
