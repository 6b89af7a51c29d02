"""Language mixtures against every set of languages, solved one by one."""

import math
import random
from itertools import combinations

import numpy as np

from streamloom.llm import language


def solved(slots, counts, table, chosen):
    """Proportions and log likelihood of a set, by many plain rounds over Python numbers."""
    pi = {k: 1 / len(chosen) for k in chosen}
    for _ in range(1500):
        new = dict.fromkeys(chosen, 0.0)
        for s, c in zip(slots, counts, strict=True):
            total = sum(table[s, k] * pi[k] for k in chosen)
            for k in chosen:
                new[k] += c * table[s, k] * pi[k] / total
        pi = {k: v / sum(counts) for k, v in new.items()}
    return pi, sum(c * math.log(sum(table[s, k] * pi[k] for k in chosen)) for s, c in zip(slots, counts, strict=True))


def test_every_set():
    rnd = random.Random(7)
    alphabets = ["abcdefgh", "efghijkl", "ijklmnop", "abcdmnop"]
    text = lambda k, n: " ".join("".join(rnd.choice(alphabets[k]) for _ in range(4)) for _ in range(n))
    table = np.full((language.SLOTS, 4), language.SMOOTHING)
    for k in range(4):
        np.add.at(table[:, k], language.trigrams(text(k, 3000)), 1)
    table = (table / table.sum(axis=0)).astype(np.float32)
    texts = [text(k, 12) for k in range(4)]
    texts += [text(a, n) + " " + text(b, m) for a, b in combinations(range(4), 2) for n, m in ((10, 5), (3, 14), (8, 8))]
    texts += [text(0, 9) + " " + text(1, 7) + " " + text(2, 8), "ab", "ae", text(1, 1)]
    proportions, chosen, totals = language.mixtures(texts, table)
    for i, t in enumerate(texts):
        slots, counts = np.unique(language.trigrams(t), return_counts=True)
        price = 0.5 * math.log(max(counts.sum(), 2))
        worth = {}
        for m in range(1, 5):
            for some in combinations(range(4), m):
                pi, value = solved(slots.tolist(), counts.tolist(), table.astype(float), some)
                worth[some] = (value - m * price, pi)
        best = max(worth, key=lambda c: worth[c][0])
        mine = tuple(np.flatnonzero(chosen[i]).tolist())
        assert worth[mine][0] > worth[best][0] - 0.02, (t, mine, best)
        assert all(abs(proportions[i, k] - worth[mine][1].get(k, 0)) < 0.02 for k in range(4)) and totals[i] == counts.sum()
