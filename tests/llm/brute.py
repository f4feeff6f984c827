"""Plain Python versions of what the operators compute, for small tables."""

import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, k):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def component_ids(rows, radius):
    """{row number: smallest reachable id} for (id, fingerprint) rows."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                parent[root(i)] = root(j)
    best = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            best[root(i)] = min(best.get(root(i), id_), id_)
    return [best.get(root(i)) for i in range(len(rows))]


def repeat_words(text, k=8):
    ws = words(text)
    windows = [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]
    times = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(k)})


def targets(sizes, ceiling=3.0, cycle=(5.0, 2.0, 1.0)):
    """{source: target} by sharing out again and again until no target is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        made = {s: ceiling * sizes[s] if s in full else rest * weight[s] / share for s in order}
        above = {s for s in order if s not in full and made[s] > ceiling * sizes[s]}
        if not above:
            return made
        full |= above


def greedy(word, vocabulary):
    """Greedy longest-match tokens of a byte string, or -1."""
    n = at = 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at:at + size] in vocabulary:
                at, n = at + size, n + 1
                break
        else:
            return -1
    return n


def top_k(vectors, k, every, scale=64):
    import math

    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)
