"""Leakage audit: six checks of a feature matrix, each as one DataFrame job."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.config import BANNED, SUSPICIOUS
from chronofeat.operators.components import delete, store
from chronofeat.operators.metrics import single_feature_ap
from chronofeat.operators.past import ordered

#: Rows of a task, where their windows make them wide.
TASK_ROWS = 100_000


class LeakageError(ValueError):
    """A feature knows what it must not."""


def banned_columns(features: list[str]) -> list[str]:
    """Names that are banned, or that hint at the label or the time."""
    return [f for f in features if f in BANNED or any(s in f.lower() for s in SUSPICIOUS)]


def _unpivot(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.selectExpr(*keep, f"stack({len(features)}, {pairs}) AS (feature, v)")
    return long.withColumn("v", F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")))


def first_row_null(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """feature, n_filled: history features that have a value on an entity's first row (0 where all is well)."""
    first = df.withColumn("__rn", F.row_number().over(ordered(key))).where("__rn = 1")
    return _unpivot(first, features).groupBy("feature").agg(F.count("v").alias("n_filled"))


def _mismatches(whole: DataFrame, cut: DataFrame, features: list[str], atol: float, rtol: float) -> DataFrame:
    """One row: for each feature the rows of both tables whose values differ."""
    cut = cut.select("txn_id", *(F.col(f).alias(f"__{f}") for f in features))

    def differs(f: str) -> Column:
        a, b = F.col(f).cast("double"), F.col(f"__{f}").cast("double")
        far = F.abs(a - b) > atol + rtol * F.abs(b)
        return F.count_if((a.isNull() != b.isNull()) | F.coalesce(far, F.lit(False))).cast("long")

    # a row for each transaction on both sides: no table to broadcast
    return whole.select("txn_id", *features).hint("merge").join(cut, "txn_id").agg(*(differs(f).alias(f) for f in features))


def truncation_mismatches(build: Callable[[DataFrame], DataFrame], df: DataFrame, cutoff: str, features: list[str], atol: float = 1e-5, rtol: float = 1e-4) -> DataFrame:
    """feature, n_mismatched: rows up to the cutoff whose value changes when later rows are taken away; all rows are compared."""
    early = F.col("ts") <= F.lit(cutoff).cast("timestamp")
    one = _mismatches(build(df).where(early), build(df.where(early)), features, atol, rtol)
    return one.selectExpr(f"stack({len(features)}, " + ", ".join(f"'{f}', `{f}`" for f in features) + ") AS (feature, n_mismatched)")


def truncation_mismatches_of_parts(parts: Callable[[DataFrame, int], Iterable[DataFrame]], df: DataFrame, cutoff: str, features: list[str], atol: float = 1e-5, rtol: float = 1e-4) -> DataFrame:
    """The same for a matrix in parts: tables (txn_id, ts, some features), each compared alone, so no wide row is ever made.

    parts(df, tasks): tasks in which no rows are many. The comparison runs here, part after part; the stream is stored once.
    """
    early = F.col("ts") <= F.lit(cutoff).cast("timestamp")
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    path, df = store(df.repartition(tasks))
    counts = {}
    for whole, cut in zip(parts(df, tasks), parts(df.where(early), tasks), strict=True):
        here = [f for f in features if f in whole.columns and f not in counts]
        if here:
            counts |= _mismatches(whole.where(early), cut, here, atol, rtol).first().asDict()
    delete(spark, path)
    if lacking := [f for f in features if f not in counts]:
        raise ValueError(f"in no part: {lacking}")
    return spark.createDataFrame([(f, counts[f]) for f in features], "feature string, n_mismatched long")


def boundary_continuity(df: DataFrame, features: list[str], train_end: str, test_start: str, days: int = 14, max_shift: float = 0.35, least: int = 100) -> DataFrame:
    """Shift of the medians across the train/test boundary in units of the pooled standard deviation."""
    end, start = F.lit(train_end).cast("timestamp"), F.lit(test_start).cast("timestamp")
    step = F.expr(f"INTERVAL {days} DAYS")
    side = F.when((F.col("ts") > end - step) & (F.col("ts") <= end), "pre").when((F.col("ts") >= start) & (F.col("ts") < start + step), "post")
    long = _unpivot(df.withColumn("__side", side).where("__side is not null"), features, "__side")
    pre, post = F.col("__side") == "pre", F.col("__side") == "post"
    g = long.groupBy("feature").agg(
        F.percentile(F.when(pre, F.col("v")), 0.5).alias("median_pre"),
        F.percentile(F.when(post, F.col("v")), 0.5).alias("median_post"),
        F.stddev_pop("v").alias("__sd"),
        F.count(F.when(pre, F.col("v"))).alias("__a"),
        F.count(F.when(post, F.col("v"))).alias("__b"),
        F.avg(F.when(pre, F.col("v").isNull().cast("double"))).alias("nan_pre"),
        F.avg(F.when(post, F.col("v").isNull().cast("double"))).alias("nan_post"),
    )
    g = g.where((F.col("__a") >= least) & (F.col("__b") >= least))
    shift = F.when(F.col("__sd") > 0, F.abs(F.col("median_post") - F.col("median_pre")) / F.col("__sd")).otherwise(0.0)
    g = g.withColumn("norm_shift", shift).withColumn("flag", F.when(F.col("norm_shift") > max_shift, "REVIEW").otherwise("ok"))
    return g.drop("__sd", "__a", "__b")


def tail_coverage(df: DataFrame, features: list[str], days: int = 7, max_excess: float = 0.1, least: int = 100) -> DataFrame:
    """Rate of missing values in the stream's last days against all before."""
    end = df.agg(F.max("ts").alias("__end"))
    tail = F.col("ts") > F.col("__end") - F.expr(f"INTERVAL {days} DAYS")
    long = _unpivot(df.crossJoin(F.broadcast(end)).withColumn("__tail", tail), features, "__tail")  # one row
    gone = F.col("v").isNull().cast("double")
    g = long.groupBy("feature").agg(F.avg(F.when(F.col("__tail"), gone)).alias("nan_tail"), F.avg(F.when(~F.col("__tail"), gone)).alias("nan_rest"), F.count_if(F.col("__tail")).alias("__n"))
    g = g.where(F.col("__n") >= least).withColumn("excess", F.col("nan_tail") - F.col("nan_rest"))
    return g.withColumn("failed", F.col("excess") > max_excess).drop("__n")


def near_perfect(df: DataFrame, features: list[str], label: str = "label", limit: float = 0.85) -> DataFrame:
    """Features that alone rank the label nearly perfectly, in either direction."""
    ap = single_feature_ap(df, features, label).withColumn("best_ap", F.greatest("ap_pos", "ap_neg"))
    return ap.withColumn("failed", F.col("best_ap") > limit)


def run_all(df: DataFrame, features: list[str], train_end: str, test_start: str, build: Callable | None = None, stream: DataFrame | None = None, cutoff: str | None = None, history: dict[str, list[str]] | None = None) -> dict:
    """All checks; raises LeakageError on a failure, returns the boundary report for review.

    history: for each key the features that must be null on its first row.
    """
    wrong = banned_columns(features)
    if wrong:
        raise LeakageError(f"banned: {wrong}")
    filled = [x.feature for key, names in (history or {}).items() for x in first_row_null(df, key, names).where("n_filled > 0").collect()]
    if filled:
        raise LeakageError(f"history on a first row: {filled}")
    late = [r.feature for r in tail_coverage(df, features).where("failed").collect()]
    perfect = [r.feature for r in near_perfect(df, features).where("failed").collect()]
    moved = [r.feature for r in truncation_mismatches(build, stream, cutoff, features).where("n_mismatched > 0").collect()] if build else []
    if late or perfect or moved:
        raise LeakageError(f"dark tail: {late}; near perfect: {perfect}; not past-only: {moved}")
    return {"boundary": boundary_continuity(df, features, train_end, test_start)}
