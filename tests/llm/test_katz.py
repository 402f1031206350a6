"""Katz backoff against its definition, word by word."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronofeat.llm import katz
from chronofeat.llm.katz import K, LARGE, good_turing, katz_scores

WORDS = [f"w{i}" for i in range(60)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Force:
    """The model by its definition, from lists of words."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            for a, b in zip([0, *t], [*t, 1]):
                self.one[b] += 1
                self.two[a, b] += 1
        self.n = sum(self.one.values())
        counts = lambda c: good_turing(np.array([sum(x == r for x in c.values()) for r in range(K + 2)]))
        self.star1, self.star2 = counts(self.one), counts(self.two)
        self.total, self.after = Counter(), defaultdict(list)
        for (a, b), c in self.two.items():
            self.total[a] += c
            self.after[a].append(b)
        self.alpha = {}

    @staticmethod
    def less(c, star):
        return c - LARGE if c > K else star[c]

    def single(self, w):
        known = sum(self.less(c, self.star1) for c in self.one.values())
        return self.less(self.one[w], self.star1) / self.n if w in self.one else 1 - known / self.n

    def weight(self, a):
        if a not in self.alpha:
            left = 1 - sum(self.less(self.two[a, b], self.star2) for b in self.after[a]) / self.total[a]
            self.alpha[a] = left / (1 - sum(self.single(b) for b in self.after[a]))
        return self.alpha[a]

    def p(self, w, a):
        if (a, w) in self.two:
            return self.less(self.two[a, w], self.star2) / self.total[a]
        return self.weight(a) * self.single(w) if a in self.total else self.single(w)

    def score(self, t):
        return sum(math.log10(self.p(b, a)) for a, b in zip([0, *t], [*t, 1]))


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(0, 40))
        out.append((i, " ".join(WORDS[min(59, int(x))] if x < 70 else f"r{rng.integers(500)}" for x in rng.exponential(15, k) * (1 + (rng.random(k) < 0.05) * 9))))
    return [*out, (n, ""), (n + 1, None), (n + 2, "W1 w2\tW3\n"), (None, "w1 w2 w3"), (5, out[5][1]), (6, "other text of this id")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_the_definition(spark, small, monkeypatch):
    if small:  # many parts, many flushes, and words that are dealt by both words
        monkeypatch.setattr(katz, "FLUSH", 50)
        monkeypatch.setattr(katz, "PART", 100)
        monkeypatch.setattr(katz, "STEP", 30)
        monkeypatch.setattr(katz, "HOT", 0.05)
    rows = corpus(3, 150)
    words = lambda t: (t or "").lower().encode().split()
    model = Force([words(t) for i, t in rows if i is not None and not held(i)])
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, len(words(t)) + 1, round(model.score(words(t)), 6)) for i, t in rows)


def test_probabilities_add_up_to_one():
    model = Force([t.lower().encode().split() for i, t in corpus(3, 150) if t and i is not None and not held(i)])
    for a in [0, b"w0", b"w7", b"w59", b"never seen"]:
        assert abs(sum(model.p(w, a) for w in model.one) + model.p(b"unknown", a) - 1) < 1e-12
