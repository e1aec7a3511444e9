"""Plain sequential versions to compare with."""

import random
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def letters(x, size, alphabet):
    x = np.asarray(x, dtype=float)
    if size > 1:
        m = len(x) // size
        x = x[: m * size].reshape(m, size).mean(axis=1) if m else np.array([x.mean()])
    z = np.zeros(len(x)) if np.ptp(x) == 0 else (x - x.mean()) / x.std()
    cuts = [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]
    return "".join(chr(97 + int(np.searchsorted(cuts, v))) for v in z)


def patterns(text, w):
    return [text[i : i + w] for i in range(len(text) - w + 1)]


def fit(seq):
    counts = defaultdict(Counter)
    for a, b in zip(seq, seq[1:]):
        counts[a][b] += 1
    edges = {(a, b): c / sum(t.values()) for a, t in counts.items() for b, c in t.items()}
    return edges, {s for e in edges for s in e}


def nearest(p, states):
    return p if p in states else min(states, key=lambda s: (edits(p, s), s), default=None)


def walk(seq, edges, states, threshold=0.05):
    out, current = [], None
    for t, p in enumerate(seq):
        to = nearest(p, states)
        prob = 1.0 if t == 0 else edges.get((current, to), 0.0)
        mapped = None if p in states else to
        out.append((t, to, p, "seen" if p in states else "unseen", mapped, prob, "normal" if prob >= threshold else "anomaly"))
        current = to
    return out


def pattern_labels(labels, size, w):
    n = len(labels) // size - w + 1
    return [int(any(v == 1 for v in labels[i * size : (i + w) * size])) for i in range(max(n, 0))]


def series_rows(seed, lengths):
    """(key, t, x, label) rows of random walks, out of order."""
    rnd = random.Random(seed)
    rows = []
    for key, n in lengths.items():
        level = 0.0
        for t in range(n):
            level = 0.7 * level + rnd.gauss(0, 1)
            rows.append((key, t, level, int(rnd.random() < 0.05)))
    rnd.shuffle(rows)
    return rows
