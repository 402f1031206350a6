"""Ranking metrics and rank operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a missing value counts as in single-feature scores.
MISSING_SCORE = -1e9


#: Places that a row of a reference table gives at a time, and above which the table is never broadcast.
RUN = 50_000
#: Ranges of values that cumulative sums over all values are cut into.
RANGES = 64


def _ranges(counts: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds __b: the range of values (of the group) that a value is in, in ascending order; null values come first.

    Borders are approximate quantiles, one short array for each group; any borders give right sums.
    """
    at = F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("__at")
    borders = counts.groupBy(*by).agg(at) if by else counts.agg(at)
    joined = counts.join(F.broadcast(borders), list(by)) if by else counts.crossJoin(F.broadcast(borders))  # a row for each group
    return joined.withColumn("__b", F.coalesce(F.size(F.filter("__at", lambda x: x <= F.col(value))), F.lit(-1))).drop("__at")


def _below(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = (), down: bool = False) -> DataFrame:
    """Adds <sum>_before: the sum over rows of smaller values (down: larger ones), for distinct values.

    Sums are taken by range of values, accumulated over the few ranges, and added to those within a range, so that no
    task meets all values.
    """
    ranged = _ranges(counts, value, by)
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    start = Window.unboundedPreceding
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order("__b")).rowsBetween(start, -1)
    totals = ranged.groupBy(*by, "__b").agg(*(F.sum(s).alias(s) for s in sums))  # RANGES rows a group
    offsets = totals.select(*by, "__b", *(F.coalesce(F.sum(s).over(over), F.lit(0)).alias(f"{s}_o") for s in sums))
    inside = Window.partitionBy(*by, "__b").orderBy(order(value)).rowsBetween(start, -1)
    out = ranged.join(F.broadcast(offsets), [*by, "__b"])
    return out.withColumns({f"{s}_before": F.col(f"{s}_o") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).drop("__b", *(f"{s}_o" for s in sums))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over distinct scores, highest first, of (recall gained) x precision; ties are one step."""
    g = df.groupBy(*by, F.col(score).alias("__s")).agg(F.sum(F.col(label).cast("double")).alias("__tp"), F.count(F.lit(1)).alias("__n"))
    c = _below(g, "__s", ["__tp", "__n"], by, down=True)
    step = F.col("__tp") * (F.col("__tp_before") + F.col("__tp")) / (F.col("__n_before") + F.col("__n"))
    ap = (F.sum(step) / F.sum("__tp")).alias("ap")
    return c.groupBy(*by).agg(ap) if by else c.agg(ap)


def single_feature_ap(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """feature, ap_pos, ap_neg: each feature as a score, and its negative; missing counts as -1e9 (negated: 1e9)."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.where(F.col(label).isNotNull()).selectExpr(f"`{label}` AS label", f"stack({len(features)}, {pairs}) AS (feature, v)")
    long = long.withColumn("v", F.coalesce(F.when(~F.isnan("v"), F.col("v")), F.lit(MISSING_SCORE)))
    pos = average_precision(long, "v", "label", ("feature",)).withColumnRenamed("ap", "ap_pos")
    neg = average_precision(long.withColumn("v", -F.col("v")), "v", "label", ("feature",)).withColumnRenamed("ap", "ap_neg")
    return pos.join(neg, "feature")


def _value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value (__v) with how many rows have it (__n) and how many have less (__less)."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return _below(counts, "__v", ["__n"]).withColumnRenamed("__n_before", "__less")


def rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """1-based rank, equal values share their mean rank."""
    r = _value_ranks(df, value)
    return df.join(r, df[value].eqNullSafe(r["__v"])).withColumn(name, F.col("__less") + (F.col("__n") + 1) / 2.0).drop("__v", "__n", "__less")


def rank_ordinal(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """1-based rank, equal values in the order of another column."""
    r = _value_ranks(df, value)
    inside = F.row_number().over(Window.partitionBy(value).orderBy(order))
    return df.join(r, df[value].eqNullSafe(r["__v"])).withColumn(name, (F.col("__less") + inside).cast("long")).drop("__v", "__n", "__less")


def recency_weight(age_days: Column, halflife_d: float | None) -> Column:
    return F.lit(1.0) if halflife_d is None else F.pow(F.lit(0.5), age_days / halflife_d)


def quantile_map(df: DataFrame, value: str, order: str, reference: DataFrame, ref_value: str, name: str) -> DataFrame:
    """Gives the n-th ranked row the n-th quantile of reference, interpolated, strictly increasing, clipped to [0, 1]."""
    n, m = df.count(), reference.count()
    # equal reference values are given places one after another, in two steps: a value may have most places
    places = _value_ranks(reference.select(F.col(ref_value).alias("__r")), "__r")
    end = F.col("__less") + F.col("__n") - 1
    runs = places.select(F.col("__v").alias("__r"), end.alias("__end"), F.explode(F.sequence("__less", end, F.lit(RUN))).alias("__from"))
    ref = runs.select("__r", F.explode(F.sequence("__from", F.least(F.col("__from") + (RUN - 1), "__end"))).alias("__i"))
    if m > RUN:  # judged by its few distinct values, a long reference would be taken to the driver
        ref = ref.hint("merge")
    q = (F.col("__k") - 1) / float(max(1, n - 1))
    at = q * (m - 1)
    ranked = rank_ordinal(df, value, order, "__k").withColumns({"__q": q}).withColumns({"__lo": F.least(F.floor(at), F.lit(m - 1)), "__f": at - F.floor(at)})
    ranked = ranked.withColumn("__hi", F.least(F.col("__lo") + 1, F.lit(m - 1)))
    low = ref.select(F.col("__i").alias("__lo"), F.col("__r").alias("__a"))
    high = ref.select(F.col("__i").alias("__hi"), F.col("__r").alias("__b"))
    out = ranked.join(low, "__lo").join(high, "__hi").withColumn("__m", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f") + 1e-9 * F.col("__q"))
    return out.withColumn(name, F.least(F.greatest("__m", F.lit(0.0)), F.lit(1.0))).drop("__k", "__q", "__lo", "__hi", "__f", "__a", "__b", "__m")


def describe(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """One row: n, mean, sample deviation, least, largest and exact percentiles (p50, p99) of a column."""
    names = [f"p{round(100 * s)}" for s in shares]
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"), F.percentile(value, list(shares)).alias("__p"))
    return one.select("*", *(F.col("__p")[k].alias(n) for k, n in enumerate(names))).drop("__p")
