"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re

LOW = {c: c + 32 for c in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingles(text, k=5):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(rows, percent=75):
    """{id: (n_shingles, component, kept)} of rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(links, ids)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def contamination(text, items, window=13):
    """(n_words, n_hit, n_items, items_sha256, contaminated, spans)."""
    words = alnum(text)
    hit, found = [False] * len(words), set()
    for key, body in items:
        w = alnum(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit[k : k + len(p)] = [True] * len(p)
                    if key is not None:
                        found.add(str(key))
    n = sum(hit)
    return len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words)


def cosine_nearest(rows, every, k=5):
    """{query: [(id, score)]} with sums from the first component on."""
    import math

    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def seq(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    norm = lambda v: math.sqrt(seq(v, v))
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        v = min(w for i, w in good if i == q)
        if found := [(i, seq(v, w) / (norm(v) * norm(w))) for i, w in good if i != q and len(w) == len(v)]:
            out[q] = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    return out
