"""Brute-force forms that several tests share."""

import re

from cairngrid.llm.simhash import fingerprint

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(docs):
    fp = {i: fingerprint(t) & (2**64 - 1) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def brute_contaminated(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    win = set()
    for t in items:
        w = split(t)
        win.update(tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1)) if w)
    out = set()
    for i, t in docs.items():
        w = split(t)
        if any(tuple(w[k : k + n]) in win for n in {len(x) for x in win} for k in range(len(w) - n + 1)):
            out.add(i)
    return out
