"""Model layer: gradient-boosted search, blending, final fit, walk-forward evaluation and calibration.

Spark ML's trees stand in for native boosters; scores are not comparable with those. Missing values become a
sentinel with a flag beside it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.functions.scalar import safe_div
from chronofeat.operators.folds import Fold
from chronofeat.operators.metrics import average_precision, quantile_map, rank_average, rank_ordinal, recency_weight

SENTINEL = -999.0
#: name: depth, rounds, step, half-life in days of the recency weight.
SEARCH = {
    "base": (5, 60, 0.1, None),
    "deep": (7, 60, 0.1, None),
    "shallow": (3, 80, 0.1, None),
    "hl90": (5, 60, 0.1, 90.0),
    "hl45": (5, 60, 0.1, 45.0),
    "slow": (5, 100, 0.05, None),
    "sampled": (5, 60, 0.1, None),
}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f"__{f}": F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(SENTINEL)) for f in features})
    filled = filled.withColumn("__missing", sum((F.col(f).isNull().cast("double") for f in features), F.lit(0.0)))
    return VectorAssembler(inputCols=[f"__{f}" for f in features] + ["__missing"], outputCol="features").transform(filled).drop(*(f"__{f}" for f in features), "__missing")


def fit(train: DataFrame, valid: DataFrame | None, config: tuple, cutoff: str, seed: int, sampled: bool = False) -> GBTClassificationModel:
    """Early stopping on the validation rows, if given; recency weights by the age at the cutoff."""
    depth, rounds, step, halflife = config
    age = (F.unix_timestamp(F.lit(cutoff).cast("timestamp")) - F.col("ts_epoch")) / 86_400.0
    rows = train.withColumn("__valid", F.lit(False)).withColumn("__w", recency_weight(age, halflife))
    if valid is not None:
        rows = rows.unionByName(valid.withColumn("__valid", F.lit(True)).withColumn("__w", F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="__w", maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed, subsamplingRate=0.7 if sampled else 1.0, featureSubsetStrategy="auto")
    if valid is not None:
        gbt = gbt.setValidationIndicatorCol("__valid")
    return gbt.fit(rows)


def predict(model: GBTClassificationModel, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def rounds_of(model: GBTClassificationModel) -> int:
    return model.getNumTrees


def search(df: DataFrame, features: list[str], fold: Fold, configs: dict[str, tuple] = SEARCH, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """Validation predictions, one column a configuration, and what each scored."""
    ready = assemble(df, features).select("txn_id", "ts_epoch", "ts", "is_test", "label", "features").persist()
    train, valid = ready.where(fold.train()), ready.where(fold.validation())
    out, results = valid, []
    for name, config in configs.items():
        model = fit(train, valid, config, fold.train_end, seed, name == "sampled")
        out = predict(model, out, name)
        results.append({"name": name, "val_ap": average_precision(predict(model, valid)).first().ap, "rounds": rounds_of(model)})
    return out.drop("features"), results


def _ap(y: np.ndarray, score: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    y, s = y[order], score[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[last]
    return float(np.sum(np.diff(np.r_[0, tp]) * tp / (last + 1)) / max(1, y.sum()))


def hill_climb(ranks: dict[str, np.ndarray], y: np.ndarray, steps: int = 40) -> dict:
    """Greedy selection with replacement on rank columns; the first of equal members wins; cut at the best step."""
    chosen, history, total = [], [], np.zeros(len(y))
    for _ in range(steps):
        scored = [(_ap(y, (total + r) / (len(chosen) + 1)), n) for n, r in ranks.items()]
        best = max(scored, key=lambda x: x[0])
        chosen.append(best[1])
        history.append(best[0])
        total = total + ranks[best[1]]
    k = int(np.argmax(history)) + 1
    return {"weights": {n: chosen[:k].count(n) / k for n in dict.fromkeys(chosen[:k])}, "val_ap": history[k - 1], "n_members": k}


def blend(valid: DataFrame, names: list[str]) -> dict:
    """The best of: hill-climbed weights, all equal, the single best. Ranks of one fold's rows go to the driver."""
    ranked = valid
    for n in names:
        ranked = rank_average(ranked, n, f"__r_{n}")
    pdf = ranked.select("label", *(f"__r_{n}" for n in names)).toPandas()
    y, ranks = pdf["label"].to_numpy(float), {n: pdf[f"__r_{n}"].to_numpy() / len(pdf) for n in names}
    best = max(names, key=lambda n: _ap(y, ranks[n]))
    options = {
        "hill_climb": hill_climb(ranks, y),
        "equal": {"weights": {n: 1 / len(names) for n in names}, "val_ap": _ap(y, sum(ranks.values()) / len(names))},
        "single": {"weights": {best: 1.0}, "val_ap": _ap(y, ranks[best])},
    }
    strategy = max(options, key=lambda k: options[k]["val_ap"])
    return {"strategy": strategy, **options[strategy]}


def weighted_ranks(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted mean of rank columns, scaled to 0 to 1."""
    for n in weights:
        df = rank_average(df, n, f"__r_{n}")
    df = df.withColumn("__z", sum((F.col(f"__r_{n}") * w for n, w in weights.items()), F.lit(0.0)))
    ends = df.agg(F.min("__z").alias("__a"), F.max("__z").alias("__b"))
    df = df.crossJoin(F.broadcast(ends))  # one row
    return df.withColumn(name, F.when(F.col("__b") > F.col("__a"), (F.col("__z") - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(0.0)).drop("__z", "__a", "__b", *(f"__r_{n}" for n in weights))


def final(df: DataFrame, features: list[str], weights: dict[str, float], rounds: dict[str, int], cutoff: str, seeds: tuple[int, ...] = (42, 43, 44), configs: dict[str, tuple] = SEARCH) -> DataFrame:
    """Fits on all labelled rows with a fifth more rounds (at least 50), over several seeds; scores of unlabelled rows."""
    ready = assemble(df, features).select("txn_id", "ts_epoch", "ts", "is_test", "label", "features").persist()
    train, test = ready.where("not is_test and label is not null"), ready.where("is_test")
    for n in weights:
        depth, most, step, halflife = configs[n]
        members = []
        for seed in seeds:
            model = fit(train, None, (depth, max(50, int(rounds.get(n, most) * 1.2)), step, halflife), cutoff, seed, n == "sampled")
            members.append(f"__{n}_{seed}")
            test = rank_average(predict(model, test, members[-1]), members[-1], f"{members[-1]}r")
        test = test.withColumn(n, sum((F.col(f"{m}r") for m in members), F.lit(0.0)) / len(members)).drop(*members, *(f"{m}r" for m in members))
    return weighted_ranks(test, weights).select("txn_id", "score")


def walk_forward(df: DataFrame, build_encoded: Callable[[DataFrame, str], DataFrame], features: list[str], folds: list[Fold], config: tuple = SEARCH["base"]) -> tuple[list[dict], list[dict]]:
    """For each fold: encode at its cutoff, fit, score both sides. Also the gain of each feature by fold."""
    results, gains = [], []
    for fold in folds:
        ready = assemble(build_encoded(df, fold.train_end), features).select("txn_id", "ts_epoch", "ts", "is_test", "label", "features").persist()
        train, valid = ready.where(fold.train()), ready.where(fold.validation())
        model = fit(train, valid, config, fold.train_end, 42)
        base = valid.agg(F.avg("label")).first()[0]
        ap = average_precision(predict(model, valid)).first().ap
        results.append({"fold": fold.name, "ap_train": average_precision(predict(model, train)).first().ap, "ap_val": ap, "base_rate": base, "lift": ap / base if base else None})
        gain = model.featureImportances.toArray()
        gains += [{"fold": fold.name, "feature": f, "gain": float(g)} for f, g in zip([*features, "n_missing"], gain)]
        ready.unpersist()
    return results, gains


def calibrate(scores: DataFrame, reference: DataFrame, ref_value: str, check: bool = True) -> DataFrame:
    """Scores with the distribution of reference probabilities, in the same order; check: an error if they are not."""
    out = quantile_map(scores, "score", "txn_id", reference, ref_value, "calibrated")
    if check and order_changed(out, "score", "calibrated"):
        raise ValueError("calibration changed the order of scores")
    return out


def order_changed(df: DataFrame, a: str, b: str) -> bool:
    """Whether some row's place by (a, txn_id) is another by (b, txn_id)."""
    both = rank_ordinal(rank_ordinal(df.select("txn_id", a, b), a, "txn_id", "__i"), b, "txn_id", "__j")
    return bool(both.where("__i <> __j").take(1))


def fold_summary(results: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of the validation scores of the folds (fold, ap_val)."""
    return results.agg(F.count(F.lit(1)).alias("folds"), F.avg("ap_val").alias("mean_ap"), F.stddev_samp("ap_val").alias("std_ap"), F.min("ap_val").alias("least_ap"), F.max_by("fold", "ap_val").alias("best_fold"))


def mean_gains(gains: DataFrame) -> DataFrame:
    """feature, mean_gain: gains (fold, feature, gain) as shares of their fold's sum, averaged over folds."""
    total = gains.groupBy("fold").agg(F.sum("gain").alias("__all"))
    shares = gains.join(F.broadcast(total), "fold").withColumn("__share", safe_div(F.col("gain"), F.col("__all")))  # a row for each fold
    return shares.groupBy("feature").agg(F.avg("__share").alias("mean_gain"))


def top_features(means: DataFrame, k: int = 30) -> DataFrame:
    """The k features with the largest mean gain, with their place."""
    best = means.orderBy(F.desc("mean_gain"), "feature").limit(k)  # a report of k rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_gain"), "feature")))


def gain_by_block(means: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """block, gain, features: mean gains summed by the block that a feature is of."""
    block = F.lit(None).cast("string")
    for name, features in blocks.items():
        block = F.when(F.col("feature").isin(features), name).otherwise(block)
    return means.withColumn("block", block).where("block is not null").groupBy("block").agg(F.sum("mean_gain").alias("gain"), F.count(F.lit(1)).alias("features"))
