"""Brute-force versions shared by the tests of the pipeline."""

import re

from waymark.llm import shingles


def classes_of(texts, threshold=0.8):
    ids = sorted(texts)
    sets = {i: shingles.shingles(texts[i]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if texts[i] == texts[j] or len(sets[i][0]) and shingles.similarity(sets[i], sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, items, window=13):
    words, hit = words_of(text), set()
    starts = {}
    for j, w in enumerate(words):
        starts.setdefault(w, []).append(j)
    for _, body in items:
        w = words_of(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in starts.get(w[i], ()):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def targets_of(sizes, weights=(5, 2, 1)):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above
