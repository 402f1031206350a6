"""The trained operators against their definitions."""

import numpy as np
import pyarrow as pa
import pytest

from chronofeat.llm import language_id, toxicity
from chronofeat.llm.language_id import codewords, decode, identify_language
from chronofeat.llm.toxicity import choose_features, features, fit_nnpu, nnpu_risk, score_toxicity


def sparse(seed, texts=40, m=12):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 6, texts)
    code = np.concatenate([np.sort(rng.choice(m, k, replace=False)) for k in n]).astype(np.int64)
    return np.r_[0, np.cumsum(n)], code, rng.random(len(code)) + 0.5, rng.random(texts) < 0.3, rng.normal(size=m) * 2, float(rng.normal())


def risk_by_force(w, bias, starts, code, value, is_p, prior):
    z = np.array([bias + sum(w[c] * v for c, v in zip(code[a:b], value[a:b])) for a, b in zip(starts, starts[1:])])
    loss = lambda x: np.log1p(np.exp(-x))
    positive, negative = prior * loss(z[is_p]).mean(), loss(-z[~is_p]).mean() - prior * loss(-z[is_p]).mean()
    return positive + max(0, negative), negative


@pytest.mark.parametrize("seed", range(8))
def test_risk_and_step_follow_the_definition(seed):
    starts, code, value, is_p, w, bias = sparse(seed)
    prior = 0.05 if seed % 2 else 0.9  # the estimate of the negatives' risk is above zero with the one, below with the other
    risk, by_weight, by_bias = nnpu_risk(w, bias, starts, code, value, is_p, prior)
    want, negative = risk_by_force(w, bias, starts, code, value, is_p, prior)
    assert abs(risk - want) < 1e-9

    def pushed(w, bias):  # what the step lowers
        r, n = risk_by_force(w, bias, starts, code, value, is_p, prior)
        return r if negative >= 0 else -n

    e = 1e-6
    slopes = [(pushed(w + e * np.eye(len(w))[i], bias) - pushed(w - e * np.eye(len(w))[i], bias)) / (2 * e) for i in range(len(w))]
    assert np.allclose(by_weight, slopes, atol=1e-6)
    assert abs(by_bias - (pushed(w, bias + e) - pushed(w, bias - e)) / (2 * e)) < 1e-6


def test_features_are_distinct_words_and_their_beginnings():
    texts = ["Straße straße STRASSE no", None, "", "élan élans ÉLANE", "abcdefgh abcdefxy abc", "123 !?"]
    text, found = features(pa.array(texts))
    for i, t in enumerate(texts):
        words = set("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        names = [("w", w) for w in words] + [(k, w[:k]) for w in words for k in (4, 5, 6) if len(w) >= k]
        counts = sorted({n: names.count(n) for n in names}.values())
        assert sorted(np.unique(found[text == i], return_counts=True)[1].tolist()) == counts
    same = features(pa.array(["élan"]))[1].tolist()
    assert set(same) <= set(found[text == 3].tolist())


def test_features_are_chosen_by_their_gap(spark):
    texts = [(True, "alpha beta gamma")] * 8 + [(False, "alpha delta")] * 20 + [(False, "rare words here")] * 2
    of = {t: features(pa.array([t]))[1].tolist() for _, t in texts}
    rows = [(p, bytearray(np.array(of[t], np.uint32).tobytes())) for p, t in texts]
    sample = spark.createDataFrame(rows, "positive boolean, x binary").repartition(3)
    every = {}
    for p, t in texts:
        for f in set(of[t]):
            n = every.setdefault(f, [0, 0, 0])
            c = np.log1p(of[t].count(f))
            every[f] = [n[0] + 1, n[1] + c * p, n[2] + c * (not p)]
    gap = {f: (-round(abs(a / 8 - b / 22) / np.sqrt(a / 8 + b / 22 + 1e-9), 9), f) for f, (n, a, b) in every.items() if n >= toxicity.LEAST_TEXTS}
    for most in (3, 1000):
        assert choose_features(sample, 8, 22, most).tolist() == sorted(f for _, f in sorted(gap.values())[:most])


def test_nothing_to_learn_from_gives_one_low_score(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (2, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == 3 and len({r.score for r in out}) == 1 and all(0 <= r.score < 1e-6 and r.predicted == 0 for r in out)
    z = np.zeros(0, np.int64)
    assert fit_nnpu(np.zeros(1, np.int64), z, z, np.zeros(0, bool), z, 0.1)["bias"] == -20


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(0)
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(30):
        own = [letters[i] for i in rng.choice(26, 5, replace=False)]
        words = ["".join(rng.choice(own, 4)) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 60)), f"l{k:02}", "clash") for i in range(40 if k else 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ambiguous string")
    truth = {r[0]: r[2] for r in rows}
    out = identify_language(docs, max_texts=300).collect()  # ten texts a language
    held = [r for r in out if r.held_out]
    assert {r.lang_pred for r in held} == {f"l{k:02}" for k in range(30)}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


@pytest.mark.parametrize("n", [2, 3, 7, 8, 50])
def test_codewords_differ_and_every_bit_tells_languages_apart(n):
    code = codewords(n)
    assert len(np.unique(code, axis=0)) == n and ((code.sum(0) > 0) & (code.sum(0) < n)).all()


def test_decoding_follows_the_definition():
    rng = np.random.default_rng(4)
    code = codewords(5)
    model = {"code": code, "w": rng.normal(size=(6, code.shape[1])), "b": rng.normal(size=code.shape[1]) / 9, "trust": rng.random(code.shape[1]) + 0.1}
    x = rng.normal(size=(300, 6)) / 4
    best, score, unsure = decode(x, model)
    for row, k, p, u in zip(x, best, score, unsure):
        z = row @ model["w"] + model["b"]
        loss = [sum(t * min(2, max(0, 1 - a * (1 if bit else -1))) for a, bit, t in zip(z, word, model["trust"])) / model["trust"].sum() for word in code]
        two = sorted(loss)[:2]
        assert abs(loss[k] - two[0]) < 1e-9 and 0 < p <= 1 and u == (two[1] - two[0] < language_id.MARGIN)
    assert 0 < unsure.mean() < 1
