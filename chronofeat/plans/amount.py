"""Amount features (28): ratios to the customer's past, contexts, trailing ranks, roundness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.config import RANK_GRID, RANK_LEAST_ROWS, RANK_WINDOWS_D
from chronofeat.functions.scalar import flag, n0, safe_div, two_decimals
from chronofeat.operators.past import expanding, prev_value, prior_count, rolling_mean

#: Ranges of amounts for each factor of e.
BINS = 200
CONTEXTS = {"categ": "mcat", "type": "ttype", "payme": "pay"}
RATIOS = ["cust_amt_prev_mean", "cust_amt_prev_std", "cust_amt_prev_max", "amt_ratio_mean", "amt_ratio_median", "amt_ratio_max", "amt_ratio_min", "amt_z", "log_amt_ratio_mean", "amt_ratio_last1", "amt_ratio_last5", "amt_ratio_last20"]
CONTEXT = [n.format(c) for c in CONTEXTS for n in ("amt_ratio_mean_by_{}", "amt_z_by_{}", "cust_{}_prior_n")]
RANKS = [f"amt_rank_{d}d" for d in RANK_WINDOWS_D]
ROUND = ["amt_is_int", "amt_round_100", "amt_round_1000"]
NAMES = ["amount_bdt", "log_amount", *RATIOS, *CONTEXT, *RANKS, *ROUND]


def ratios(df: DataFrame) -> DataFrame:
    k, a = ("cust",), F.col("amount")
    df = df.withColumns({"amount_bdt": a, "log_amount": F.log1p(a)})
    df = df.withColumns({f"__{h}": expanding(k, a, h) for h in ("mean", "std", "max", "min", "median")} | {"__l1": prev_value(k, a), "__l5": rolling_mean(k, a, 5), "__l20": rolling_mean(k, a, 20)})
    out = {f"cust_amt_prev_{h}": F.col(f"__{h}") for h in ("mean", "std", "max")} | {f"amt_ratio_{h}": safe_div(a, F.col(f"__{h}")) for h in ("mean", "median", "max", "min")}
    out |= {"amt_z": safe_div(a - F.col("__mean"), F.col("__std")), "log_amt_ratio_mean": F.log1p(a) - F.log1p("__mean")}
    out |= {f"amt_ratio_last{n}": safe_div(a, F.col(f"__l{n}")) for n in (1, 5, 20)}
    return df.withColumns(out).drop("__mean", "__std", "__max", "__min", "__median", "__l1", "__l5", "__l20")


def contexts(df: DataFrame) -> DataFrame:
    a = F.col("amount")
    for short, column in CONTEXTS.items():
        k = ("cust", column)
        df = df.withColumns({"__m": expanding(k, a, "mean"), "__s": expanding(k, a, "std"), f"cust_{short}_prior_n": prior_count(*k)})
        df = df.withColumns({f"amt_ratio_mean_by_{short}": safe_div(a, F.col("__m")), f"amt_z_by_{short}": safe_div(a - F.col("__m"), F.col("__s"))}).drop("__m", "__s")
    return df


def _grids(base: DataFrame, w: int) -> DataFrame:
    """(__day, __grid): RANK_GRID quantiles of the amounts of w days before a day, for days with enough rows.

    base: (__day, ts_epoch, amount, __bin), bins being ranges of amounts. Rows are counted by (day, bin), and these few counts
    tell which bins of a window hold the quantiles' ranks; only values of such bins are lent to the days they serve.
    """
    days = base.groupBy("__day").agg(F.min("ts_epoch").alias("__first"))
    # of the day that the window's start cuts, the rows after the start; of the others all
    edge = base.select((F.col("__day") + w).alias("__for"), "__bin", "amount", "ts_epoch").join(days.select(F.col("__day").alias("__for"), "__first"), "__for")
    edge = edge.where(F.col("ts_epoch") >= F.col("__first") - w * 86_400).groupBy("__for", "__bin", "amount").agg(F.count(F.lit(1)).alias("__n"))
    values = base.groupBy("__day", "__bin", "amount").agg(F.count(F.lit(1)).alias("__n"))
    cells = values.groupBy("__day", "__bin").agg(F.sum("__n").alias("__n"))
    reach = cells.withColumn("__for", F.explode(F.sequence(F.col("__day") + 1, F.col("__day") + w - 1))).join(days.select(F.col("__day").alias("__for")), "__for")
    reach = reach.select("__for", "__bin", "__n").union(edge.select("__for", "__bin", "__n")).groupBy("__for", "__bin").agg(F.sum("__n").alias("__n"))
    of_day = Window.partitionBy("__for")
    reach = reach.withColumns({"__before": n0(F.sum("__n").over(of_day.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))), "__rows": F.sum("__n").over(of_day)})

    def place(i: Column) -> Column:
        return (F.col("__rows") - 1) * (i / F.lit(float(RANK_GRID - 1)))

    def holds(i: Column, start: Column, n: Column) -> Column:
        inside = lambda x: (x >= start) & (x < start + n)
        return inside(F.floor(place(i))) | inside(F.ceil(place(i)))

    wanted = F.filter(F.sequence(F.lit(0), F.lit(RANK_GRID - 1)), lambda i: holds(i, F.col("__before"), F.col("__n")))
    wanted = reach.where(F.col("__rows") >= RANK_LEAST_ROWS).select("__for", "__bin", "__before", "__rows", wanted.alias("__i")).where(F.size("__i") > 0)
    lent = wanted.select("__for", "__bin", F.explode(F.sequence(F.col("__for") - w + 1, F.col("__for") - 1)).alias("__day")).join(values, ["__day", "__bin"])
    lent = lent.select("__for", "__bin", "amount", "__n").union(edge.join(wanted.select("__for", "__bin"), ["__for", "__bin"]).select("__for", "__bin", "amount", "__n"))
    merged = lent.groupBy("__for", "__bin", "amount").agg(F.sum("__n").alias("__n"))
    below = Window.partitionBy("__for", "__bin").orderBy("amount").rowsBetween(Window.unboundedPreceding, -1)
    found = merged.withColumn("__below", n0(F.sum("__n").over(below))).join(wanted, ["__for", "__bin"])
    start, i = F.col("__before") + F.col("__below"), F.col("__k")
    found = found.select("*", F.explode("__i").alias("__k")).where(holds(i, start, F.col("__n")))
    at, inside = place(i), lambda x: (x >= start) & (x < start + F.col("__n"))
    found = found.select("__for", "__k", at.alias("__at"), F.when(inside(F.floor(at)), F.col("amount")).alias("__low"), F.when(inside(F.ceil(at)), F.col("amount")).alias("__high"))
    points = found.groupBy("__for", "__k").agg(*(F.max(c).alias(c) for c in ("__at", "__low", "__high")))
    low, high = F.floor("__at"), F.ceil("__at")
    value = F.when((low == high) | (F.col("__low") == F.col("__high")), F.col("__low")).otherwise((high - F.col("__at")) * F.col("__low") + (F.col("__at") - low) * F.col("__high"))
    grid = F.transform(F.sort_array(F.collect_list(F.struct("__k", value.alias("v")))), lambda x: x.v)  # RANK_GRID values
    return points.groupBy(F.col("__for").alias("__day")).agg(grid.alias("__grid"))


def trailing_ranks(df: DataFrame, windows_d: tuple[int, ...] = RANK_WINDOWS_D, base: DataFrame | None = None) -> DataFrame:
    """Place of the amount in the quantiles of the days before, once a day.

    A day's window reaches so many days back from its first row and ends with the day before.
    """
    day = F.floor(F.col("ts_epoch") / 86_400).cast("long")
    bin_ = F.floor(F.signum("amount") * F.log1p(F.abs("amount")) * BINS).cast("long")
    base, df = (df if base is None else base).select(day.alias("__day"), "ts_epoch", "amount", bin_.alias("__bin")), df.withColumn("__day", day)
    for w in windows_d:
        # a row for each day
        df = df.join(F.broadcast(_grids(base, w)), "__day", "left")
        df = df.withColumn(f"amt_rank_{w}d", F.when(F.col("__grid").isNotNull(), F.size(F.filter("__grid", lambda g: g <= F.col("amount"))) / float(RANK_GRID))).drop("__grid")
    return df.drop("__day")


def roundness(df: DataFrame) -> DataFrame:
    two = two_decimals(F.col("amount"))
    whole = F.rint(two)
    return df.withColumns({"amt_is_int": flag(two == whole), "amt_round_100": flag(two % 100 == 0), "amt_round_1000": flag(two % 1000 == 0)})


def build(df: DataFrame) -> DataFrame:
    return roundness(trailing_ranks(contexts(ratios(df)), base=df))
