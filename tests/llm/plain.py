"""Near-duplicate texts and vectors in plain Python: words, shingles, weights, cosines and similarities of their own."""

import math
import re
from collections import Counter

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def weighted(texts, steps, smooth=0.03):
    """id -> shingle -> TF-IDF, with the document frequency rounded to a step-th of a doubling and smoothed."""
    bags = {i: shingles(t) for i, t in texts.items()}
    df = Counter(s for bag in bags.values() for s in bag)
    rounded = {n: 2 ** (round(steps * math.log2(n)) / steps) for n in set(df.values())}
    n = len(texts)
    idf = {s: 1 + math.log((n + smooth * n) / (min(rounded[m], n) + smooth * n)) for s, m in df.items()}
    return {i: {s: tf * idf[s] for s, tf in bag.items()} for i, bag in bags.items()}


def similar_pairs(texts, least, steps):
    """Pairs of ids, smaller first, with weighted Jaccard similarity of `least` or more."""
    weights = weighted(texts, steps)
    total = {i: sum(w.values()) for i, w in weights.items()}
    holders = {}
    for i in sorted(texts):
        for s in weights[i]:
            holders.setdefault(s, []).append(i)
    out = set()
    for i in sorted(texts):
        shared = Counter()
        for s, w in weights[i].items():
            for j in holders[s]:
                if j > i:
                    shared[j] += min(w, weights[j][s])
        out |= {(i, j) for j, both in shared.items() if both / (total[i] + total[j] - both) >= least - 1e-6}
    return out


def classes(texts, least, steps):
    """Class of each id: equal texts that aren't blank, and similar ones, are joined; the least id names a class."""
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    equal = {(first.setdefault(t, i), i) for i, t in sorted(texts.items()) if t and not t.isspace()}
    for i, j in sorted(equal | similar_pairs(texts, least, steps)):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def cosine(a, b):
    """In exact sums; null where there is none."""
    if len(a) != len(b) or not all(x is not None and math.isfinite(x) for x in (*a, *b)):
        return None
    norms = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
    return math.fsum(x * y for x, y in zip(a, b)) / norms if norms else None


def linked(ids, values, labels, least=0.93):
    """(n_links, component) of each id: every pair of an equal label is compared."""
    good = [n for n, v in enumerate(values) if ids[n] is not None and labels[n] is not None and v]
    parent, count = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            if labels[i] == labels[j] and (c := cosine(values[i], values[j])) is not None and c >= least:
                count[ids[i]] += 1
                count[ids[j]] += 1
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: (count[i], root(i)) for i in ids if i is not None}
