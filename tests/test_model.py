"""The model layer, graph embeddings and rank operators against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofeat.operators import metrics
from chronofeat.operators.folds import FOLDS_A, Fold
from chronofeat.operators.median import running_median
from chronofeat.plans import graph, model
from chronofeat.sources.fixtures import stream


def ap_by_force(y, score):
    total, seen, hit, before = 0.0, 0, 0, 0
    for s in sorted(set(score), reverse=True):
        at = [i for i, x in enumerate(score) if x == s]
        seen, hit = seen + len(at), hit + sum(y[i] for i in at)
        total += (hit - before) / sum(y) * hit / seen
        before = hit
    return total


@pytest.mark.parametrize("seed", range(4))
def test_average_precision_groups_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1 if seed % 2 else 6)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "score double, label double").repartition(5)
    assert abs(metrics.average_precision(df).first().ap - ap_by_force(y, s)) < 1e-12
    assert abs(model._ap(y, s) - ap_by_force(y, s)) < 1e-12


def test_ranks_of_many_distinct_values(spark):
    rng = np.random.default_rng(1)
    values = [*(float(v) for v in rng.normal(size=3000)), *[0.5] * 50, *[None] * 7, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "txn_id long, v double").repartition(6)
    out = metrics.rank_ordinal(metrics.rank_average(df, "v", "a"), "v", "txn_id", "o").collect()
    key = lambda v: (v is not None, v != v if v is not None else False, v or 0.0)  # noqa: E731  null, numbers, not a number
    order = sorted(range(len(values)), key=lambda i: (key(values[i]), i))
    ordinal = {i: k + 1 for k, i in enumerate(order)}
    shared = {}
    for i in order:
        shared.setdefault(key(values[i]) if values[i] == values[i] else "nan", []).append(ordinal[i])
    for r in out:
        assert r.o == ordinal[r.txn_id]
        assert r.a == np.mean(shared[key(r.v) if r.v == r.v else "nan"])


def test_running_median_is_that_of_earlier_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"k{int(rng.integers(3))}", int(rng.integers(50)), None if i % 11 == 0 else float(np.round(rng.normal(), 1))) for i in range(500)]
    df = spark.createDataFrame(rows, "txn_id long, k string, t long, v double").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
    got = {r.txn_id: r.m for r in running_median(df, "k", F.col("v"), "m").collect()}
    for i, k, t, _ in rows:
        earlier = [x[3] for x in rows if x[1] == k and (x[2], x[0]) < (t, i) and x[3] is not None]
        assert got[i] == (float(np.median(earlier)) if earlier else None)


def climb_by_force(ranks, y, steps=40):
    chosen, history = [], []
    for _ in range(steps):
        best = None
        for n in ranks:
            a = ap_by_force(y, list(sum((ranks[c] for c in [*chosen, n]), np.zeros(len(y))) / (len(chosen) + 1)))
            if best is None or a > best[0]:
                best = (a, n)
        chosen.append(best[1])
        history.append(best[0])
    k = int(np.argmax(history)) + 1
    return {n: chosen[:k].count(n) / k for n in chosen[:k]}, history[k - 1]


def test_hill_climb_is_greedy_with_replacement_and_cut_at_its_peak():
    rng = np.random.default_rng(5)
    y = (rng.random(80) < 0.3).astype(float)
    ranks = {n: rng.permutation(80) / 80 + w * y for n, w in (("a", 0.3), ("b", 0.4), ("c", 0.0))}
    got = model.hill_climb(ranks, y, 8)
    weights, ap = climb_by_force(ranks, y, 8)
    assert got["weights"] == weights and abs(got["val_ap"] - ap) < 1e-12


def test_blend_takes_the_best_strategy(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(300) < 0.2).astype(float)
    rows = [(i, float(y[i]), float(rng.random() + 0.5 * y[i]), float(rng.random()), float(rng.random() + 0.4 * y[i])) for i in range(300)]
    spec = model.blend(spark.createDataFrame(rows, "txn_id long, label double, a double, b double, c double"), ["a", "b", "c"])
    single = max(ap_by_force(y, [r[k] for r in rows]) for k in (2, 3, 4))
    assert spec["val_ap"] >= single - 1e-12 and abs(sum(spec["weights"].values()) - 1) < 1e-9 and json.dumps(spec)


def test_calibration_keeps_the_order_and_takes_the_distribution(spark):
    rng = np.random.default_rng(7)
    score, ref = np.round(rng.random(301), 2), np.round(rng.beta(1, 9, 97), 2)
    out = model.calibrate(
        spark.createDataFrame([(i, float(s)) for i, s in enumerate(score)], "txn_id long, score double"), spark.createDataFrame([(float(x),) for x in ref], "p double"), "p"
    ).collect()
    order = np.lexsort((np.arange(301), score))
    q = np.empty(301)
    q[order] = np.arange(301) / 300
    want = np.clip(np.interp(q, np.linspace(0, 1, 97), np.sort(ref)) + 1e-9 * q, 0, 1)
    for r in out:
        assert abs(r.calibrated - want[r.txn_id]) < 1e-12
    swapped = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.2, 0.8)], "txn_id long, a double, b double")
    assert model.order_changed(swapped, "a", "b") and not model.order_changed(swapped, "a", "a")


@pytest.fixture(scope="module")
def ready(spark, sf):
    return stream(spark, sf).withColumns({"h": F.hour("ts").cast("double"), "gap": F.when(F.col("txn_id") % 5 > 0, F.col("amount") % 7)}).persist()


CONFIGS = {"base": (2, 4, 0.1, None), "hl45": (2, 5, 0.1, 45.0)}


def test_search_blend_and_final_give_every_unlabelled_row_a_score(ready):
    features = ["amount", "h", "gap", "account_age_days"]
    valid, results = model.search(ready, features, FOLDS_A[0], CONFIGS)
    assert [r["name"] for r in results] == list(CONFIGS) and all(0 < r["val_ap"] <= 1 and r["rounds"] >= 1 for r in results)
    assert valid.count() == ready.where(FOLDS_A[0].validation()).count()
    spec = model.blend(valid, list(CONFIGS))
    assert abs(sum(spec["weights"].values()) - 1) < 1e-9
    out = model.final(ready, features, spec["weights"], {r["name"]: r["rounds"] for r in results}, "2024-01-20 23:59:59", (42,), {n: (2, 4, 0.1, c[3]) for n, c in CONFIGS.items()})
    scores = [r.score for r in out.collect()]
    assert len(scores) == ready.where("is_test").count() and min(scores) == 0 and max(scores) == 1


def test_walk_forward_reports_each_fold_and_its_gains(spark, ready):
    features = ["amount", "h", "gap"]
    folds = [Fold("one", "2024-01-05 23:59:59", "2024-01-06 00:00:00", "2024-01-10 23:59:59"), Fold("two", "2024-01-12 23:59:59", "2024-01-13 00:00:00", "2024-01-16 23:59:59")]
    results, gains = model.walk_forward(ready, lambda df, end: df.withColumn("seen_end", F.lit(end)), features, folds, CONFIGS["base"])
    assert [r["fold"] for r in results] == ["one", "two"] and all(0 < r["ap_val"] <= 1 and r["lift"] > 0 for r in results)
    means = model.mean_gains(spark.createDataFrame(gains))
    assert abs(sum(r.mean_gain for r in means.collect()) - 1) < 1e-9
    blocks = {r.block: r.features for r in model.gain_by_block(means, {"raw": ["amount", "gap"], "time": ["h"]}).collect()}
    assert blocks == {"raw": 2, "time": 1}
    assert [r.place for r in model.top_features(means, 2).orderBy("place").collect()] == [1, 2]
    summary = model.fold_summary(spark.createDataFrame(results)).first()
    assert abs(summary.mean_ap - np.mean([r["ap_val"] for r in results])) < 1e-12 and abs(summary.std_ap - np.std([r["ap_val"] for r in results], ddof=1)) < 1e-12


def random_edges(seed, a, b, n):
    rng = np.random.default_rng(seed)
    return tuple(np.unique(np.stack([rng.integers(0, a, n), rng.integers(0, b, n)]), axis=1))


@pytest.mark.parametrize("shape", [(40, 30, 200), (12, 90, 150), (3, 4, 6)])
def test_spectral_factors_are_those_of_the_decomposition(shape):
    a, b, n = shape
    left, right = random_edges(1, a, b, n)
    m = np.zeros((a, b))
    m[left, right] = 1
    degree_l, degree_r = np.bincount(left, minlength=a), np.bincount(right, minlength=b)
    m = np.divide(m, np.sqrt(np.outer(degree_l, degree_r)), out=np.zeros_like(m), where=m > 0)
    dim = 8
    k = min(dim, min(a, b) - 1)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    got_u, got_v = graph.spectral_factors(left, right, a, b, dim, 3)
    want_u, want_v = u[:, :k] * s[:k], vt[:k].T * s[:k]
    # signs and equal values' axes are free: products of factors are not, and lengths neither
    assert np.allclose(got_u @ got_u.T, want_u @ want_u.T, atol=1e-5) and np.allclose(got_v @ got_v.T, want_v @ want_v.T, atol=1e-5)
    assert np.allclose(got_u @ got_v.T, want_u @ want_v.T, atol=1e-5)


@pytest.mark.parametrize("first", [True, False])
def test_propagation_is_two_layers_of_neighbourhood_means(first):
    rng = np.random.default_rng(3)
    cd, cm = random_edges(1, 7, 5, 20), random_edges(2, 7, 4, 15)
    c, d, m = (rng.normal(size=(n, 6)) for n in (7, 5, 4))
    w1, w2 = rng.normal(size=(6, 6)) / 3, rng.normal(size=(6, 6)) / 3
    got = graph.propagate([c, d, m], (w1, w2), cd, cm, customers_first=first)
    mean = lambda rows, x: np.mean([x[j] for j in rows], axis=0) if len(rows) else np.zeros(6)
    for _ in range(2):
        new = np.array([np.tanh(c[i] @ w1 + (0.5 * mean(cd[1][cd[0] == i], d) + 0.5 * mean(cm[1][cm[0] == i], m)) @ w2) for i in range(7)])
        seen = new if first else c
        d = np.array([np.tanh(d[i] @ w1 + mean(cd[0][cd[1] == i], seen) @ w2) for i in range(5)])
        m = np.array([np.tanh(m[i] @ w1 + mean(cm[0][cm[1] == i], seen) @ w2) for i in range(4)])
        c = new
    assert all(np.allclose(x, y) for x, y in zip(got, (c, d, m)))


def test_refinement_raises_the_scores_of_links():
    cd = random_edges(4, 30, 20, 120)
    rng = np.random.default_rng(5)
    c, d = rng.normal(size=(30, 8)) / 3, rng.normal(size=(20, 8)) / 3
    before = (c[cd[0]] * d[cd[1]]).sum(1).mean()
    c, d = graph.refine_links(c, d, *cd)
    linked, all_ = (c[cd[0]] * d[cd[1]]).sum(1).mean(), (c @ d.T).mean()
    assert linked > before + 0.1 and linked > all_


def test_embedding_columns_of_rows_with_a_snapshot(spark, sf):
    df = graph.assign_snapshots(stream(spark, sf), least_rows=100)
    for options in ({}, {"train_links": True}):
        rows = graph.embedded(df, dim=8, **options).select("snap", *graph.SPECTRAL, *graph.GNN).collect()
        assert len(rows) == df.count()
        assert all(all(r[c] is None for c in (*graph.SPECTRAL, *graph.GNN)) for r in rows if r.snap is None)
        seen = [r for r in rows if r.snap is not None]
        assert seen and all(r.gnn_cd_score is not None and r.g_cust_emb_norm >= 0 for r in seen)
        assert all(-1 - 1e-9 <= r[c] <= 1 + 1e-9 for r in seen for c in ("g_cd_cos", "gnn_cd_cos", "gnn_cm_cos") if r[c] is not None)
