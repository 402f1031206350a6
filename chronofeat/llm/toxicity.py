"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier learns from confirmed toxic texts (positives) and unlabelled texts. With class
prior p and logistic loss the risk is  p R_P(+) + max(0, R_U(-) - p R_P(-)) : the unlabelled texts stand for
the negatives once the positives' share is taken out, and the correction never goes below zero. The prior is
the share of toxic texts among the labelled training rows; a label 0 is used for nothing else.

Features: how many of the distinct words of the whole text are a word, or begin with given four to six
letters (logarithms), for those that occur in enough sampled texts. The fit uses at most max_positive and
max_unlabelled texts, chosen by a hash of doc_id; every text is scored. Features are counted and chosen on the
executors; only the counts of those chosen go to the driver, as one sparse row for each sampled text.

Results for unusual input: null or empty text: the classifier's score without features; no positives or no
unlabelled texts to learn from: one score near 0 (a bias of -20) for all; several labels of one doc_id: toxic if
any says so; repeated rows: each is returned, with equal scores; equal doc_ids with different texts: each text is
scored; very long texts: whole; equal scores: no order is given; an empty table gives an empty result; other
columns of docs and labels, whatever their names, are ignored (with carry they come along in `row`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, documents, give_back, hashes_at, mix, out_schema, release, store, utf8, with_row, words_in

#: Texts of the sample that a feature must occur in; and features kept at most.
LEAST_TEXTS, MAX_FEATURES = 6, 4000
EPOCHS, STEP, RIDGE = 250, 0.03, 5e-4
BEGINNINGS = (4, 5, 6)

_BITS = 22
#: Letters a-z and all bytes of other characters; the rest ends a word.
_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])
_LETTERS = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all texts, ascending by both, a pair as often as the text has distinct words with that feature."""
    raw, ends = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    raw = _LETTERS[raw]
    starts, lengths, n = words_in(raw, ends)
    text, words = np.repeat(np.arange(len(n)), n), hashes_at(raw, starts, lengths)
    order = np.lexsort((words, text))
    text, words, starts, lengths = text[order], words[order], starts[order], lengths[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (words[1:] != words[:-1])] if len(text) else np.zeros(0, bool)
    text, words, starts, lengths = text[new], words[new], starts[new], lengths[new]
    rows, found = [text], [mix(words + np.uint64(1)) >> np.uint64(64 - _BITS)]
    characters = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # where they start
    first = np.searchsorted(characters, starts)
    for k in BEGINNINGS:
        stop = characters[np.minimum(first + k, len(characters) - 1)] - starts
        long = np.flatnonzero((first + k < len(characters)) & (stop <= lengths))
        rows.append(text[long])
        found.append(mix(hashes_at(raw, starts[long], stop[long]) + np.uint64(k)) >> np.uint64(64 - _BITS))
    pairs = np.sort((np.concatenate(rows) << _BITS) | np.concatenate(found).astype(np.int64))
    return pairs >> _BITS, pairs & ((1 << _BITS) - 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 2_000_000):
        text, found = features(batch.column(1))
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        found = found.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["positive", "x"])


def _counts(x: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the distinct features of each row, in ascending order; value: log(1 + count)."""
    rows = [np.frombuffer(v, np.uint32) for v in x.to_pylist()]
    pair = np.concatenate(rows).astype(np.int64) + (np.repeat(np.arange(len(rows), dtype=np.int64), [len(r) for r in rows]) << _BITS)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)  # features come sorted
    value = np.log1p(np.diff(np.r_[first, len(pair)]))
    return pair[first] >> _BITS, pair[first] & ((1 << _BITS) - 1), value


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature: the texts that hold it, and the sums of its values over positive and unlabelled texts."""
    for batch in chunks(batches, text="x"):
        row, feature, value = _counts(batch.column(1))
        found, code = np.unique(feature, return_inverse=True)
        positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[row]
        sums = (np.bincount(code, minlength=len(found)), np.bincount(code, value * positive, len(found)), np.bincount(code, value * ~positive, len(found)))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(s) for s in sums)], ["feature", "texts", "in_positive", "in_all"])


def choose_features(sample: DataFrame, positives: int, unlabelled: int, most: int = MAX_FEATURES) -> np.ndarray:
    """Ascending numbers of the features that tell positive from unlabelled texts of sample (positive, x) best."""
    p, u = F.col("in_positive") / positives, F.col("in_all") / unlabelled
    stats = sample.mapInArrow(_statistics, "feature long, texts long, in_positive double, in_all double").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("texts", "in_positive", "in_all")))
    # rounded: sums differ in their last digits with the order of partitions
    gap = F.round(F.abs(p - u) / F.sqrt(p + u + 1e-9), 9)
    best = stats.where(F.col("texts") >= min(LEAST_TEXTS, positives + unlabelled)).orderBy(gap.desc(), "feature").limit(most).select("feature")
    return np.sort(np.array([r.feature for r in best.collect()], np.int64))  # `most` numbers


def _sparse(chosen: np.ndarray):
    """Of each sampled text its chosen features (by place in `chosen`) and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text="x"):
            row, feature, value = _counts(batch.column(1))
            at = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
            ok = chosen[at] == feature
            cuts = np.searchsorted(row[ok], np.arange(batch.num_rows + 1))
            codes, values = at[ok].astype("<u2"), value[ok].astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for v in (codes, values))], ["positive", "codes", "values"]
            )

    return run


def nnpu_risk(w: np.ndarray, bias: float, starts: np.ndarray, code: np.ndarray, value: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The corrected risk of a linear classifier, and the step direction: the gradient, or where the estimate of the
    negatives' risk is below zero, the one that pushes it back up.

    Text i has the features code[starts[i]:starts[i + 1]] with their values.
    """
    size, np_, nu = len(is_p), max(1, int(is_p.sum())), max(1, int((~is_p).sum()))
    n = np.diff(starts)
    product = w[code]
    product *= value
    z = np.zeros(size)
    z[n > 0] = np.add.reduceat(product, starts[:-1][n > 0]) if len(product) else 0.0
    z += bias
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    negative = np.logaddexp(0, z[~is_p]).mean() - prior * np.logaddexp(0, z[is_p]).mean()
    risk = prior * np.logaddexp(0, -z[is_p]).mean() + max(0.0, negative)
    correction = np.where(is_p, -prior / np_ * s, s / nu)
    g = np.where(is_p, prior / np_ * (s - 1), 0.0) + correction if negative >= 0 else -correction
    product = np.repeat(g, n)
    product *= value
    return float(risk), np.bincount(code, product, len(w)), float(g.sum())


def fit_nnpu(starts: np.ndarray, code: np.ndarray, value: np.ndarray, is_p: np.ndarray, features: np.ndarray, prior: float) -> dict:
    """Weights by feature number, and the bias, from sparse rows (as in nnpu_risk) of positive and of unlabelled texts."""
    empty = {"index": np.zeros(0, np.uint32), "weight": np.zeros(0, np.float32), "bias": -20.0}
    if not len(features) or not is_p.any() or is_p.all() or not 0 < prior < 1:
        return empty
    m = len(features)
    w, bias, am, av = np.zeros(m), float(np.log(prior / (1 - prior))), np.zeros(m + 1), np.zeros(m + 1)
    for epoch in range(1, EPOCHS + 1):
        _, by_weight, by_bias = nnpu_risk(w, bias, starts, code, value, is_p, prior)
        grad = np.r_[by_weight + RIDGE * w, by_bias]
        am, av = 0.9 * am + 0.1 * grad, 0.999 * av + 0.001 * grad**2
        step = STEP * (am / (1 - 0.9**epoch)) / (np.sqrt(av / (1 - 0.999**epoch)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return {"index": features.astype(np.uint32), "weight": w.astype(np.float32), "bias": float(bias)}


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, carry: bool = False, max_positive: int = 4000, max_unlabelled: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; labels (doc_id, toxic) of held-out rows are unused.

    carry: the whole row of docs comes along as a struct `row`. max_positive, max_unlabelled: the bounds of the sample
    that the classifier is fitted on.
    """
    every, docs = docs, documents(docs)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold != held_out)
    known = known.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = float(known.agg(F.avg("toxic")).first()[0] or 0)

    def some(of: DataFrame, most: int) -> DataFrame:
        return of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    positives = some(known.where("toxic = 1").select("doc_id"), max_positive)
    others = some(docs.select("doc_id").where("doc_id is not null").where(fold != held_out), max_unlabelled)  # toxic ones too, as the prior says
    chosen = positives.withColumn("positive", F.lit(True)).union(others.withColumn("positive", F.lit(False)))
    # at most max_positive + max_unlabelled rows of 9 bytes: a proven bound
    sample = store(docs.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(_extract, "positive boolean, x binary"), "sample")
    n = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    features_ = choose_features(sample, n[True], n[False]) if len(n) == 2 else np.zeros(0, np.int64)
    starts, code, value, is_p = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    if len(features_):
        rows = sample.mapInArrow(_sparse(features_), "positive boolean, codes binary, values binary").toArrow()
        # six bytes for each chosen feature of each sampled text
        code = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u2").astype(np.int64)
        value = np.frombuffer(b"".join(rows["values"].to_pylist()), "<f4").astype(np.float64)
        is_p = np.array(rows["positive"].to_pylist(), bool)
        starts = np.r_[0, np.cumsum([len(x) // 2 for x in rows["codes"].to_pylist()])]
        del rows
    release(sample)
    model = fit_nnpu(starts, code, value, is_p, features_, prior)
    del code, value
    give_back()  # the driver lives on
    return score_with(every, model, folds, held_out, carry)


def score_with(docs: DataFrame, model: dict, folds: int = 5, held_out: int = 0, carry: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights and the prior's bias at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index, weight = m["index"].astype(np.int64), m["weight"].astype(np.float64)
        for batch in chunks(batches, 2_000_000):
            ids, rows = batch.column(0).to_pylist(), batch.num_rows
            z = np.full(rows, m["bias"])
            if len(index):
                text, found = features(batch.column(1))
                at = np.minimum(np.searchsorted(index, found), len(index) - 1)
                ok = index[at] == found
                pair, count = np.unique(text[ok] * len(index) + at[ok], return_counts=True)
                z += np.bincount(pair // len(index), weight[pair % len(index)] * np.log1p(count), rows)
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            held = [None if i is None else zlib.crc32(str(i).encode()) % folds == held_out for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), *([batch.column(2)] if carry else [])],
                ["doc_id", "held_out", "score", "predicted", *(["row"] if carry else [])],
            )

    return with_row(docs, carry).mapInArrow(run, out_schema(docs, "doc_id long, held_out boolean, score double, predicted int", carry))
