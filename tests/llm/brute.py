"""Plain versions of operators, for small inputs."""

import collections
import hashlib
import re

import numpy as np


def shingle_sets(texts, width):
    out = []
    for t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def least_ids(ids, comp):
    out = {}
    for i, c in zip(ids, comp, strict=True):
        if i is not None:
            out[c] = min(out.get(c, i), i)
    return [out.get(c) for c in comp]


def near_duplicates(ids, texts, width=4, threshold=80):
    sets = shingle_sets(texts, width)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    comp = least_ids(ids, components(len(sets), links))
    comp = [c if s else i for i, s, c in zip(ids, sets, comp, strict=True)]
    return [(i, len(s), c, i == c) for i, s, c in zip(ids, sets, comp, strict=True)]


def repeats(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out
