"""Plain single-machine versions of the operators, to compare with on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(rows, width, percent=80):
    """{id: (n, component)} of (id, text) rows with distinct ids."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i} - {i}:
            if (i, j) not in seen:
                seen.add((i, j))
                both = len(s & sets[j])
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, length=50):
    """{id: (n_bytes, n_removed, n_spans, sha256, kept bytes)}: bytes of `length`-byte strings that start in a smaller id."""
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def nn_pu(positive, unlabelled, n, prior, rounds, rate, decay, corrected=True):
    """(weights, bias, least clean risk): logistic non-negative positive-unlabelled learning on dense 0/1 rows, by Adam."""
    import numpy as np

    x_p, x_u = (np.zeros((len(texts), n + 1)) for texts in (positive, unlabelled))
    for x, texts in ((x_p, positive), (x_u, unlabelled)):
        for row, words in enumerate(texts):
            x[row, words] = 1
        x[:, n] = 1
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v, least = np.zeros(n + 1), np.zeros(n + 1), np.inf
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, rounds + 1):
        z_p, z_u = x_p @ w, x_u @ w
        clean = np.log1p(np.exp(z_u)).mean() - prior * np.log1p(np.exp(z_p)).mean()
        least = min(least, clean)
        of_clean = (x_u * sigmoid(z_u)[:, None]).mean(axis=0) - prior * (x_p * sigmoid(z_p)[:, None]).mean(axis=0)
        of_toxic = -prior * (x_p * sigmoid(-z_p)[:, None]).mean(axis=0)
        g = -of_clean if corrected and clean < 0 else of_toxic + of_clean
        g[:n] += decay * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:n], w[n], least
