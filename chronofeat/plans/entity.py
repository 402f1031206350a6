"""Entity features (55): novelty, sharing, diversity, movement and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.config import WINDOWS_S
from chronofeat.functions.scalar import clip, flag, n0, safe_div
from chronofeat.operators.past import first_occurrence, ordered, past, prev_gap, prior_count, sum_in_window
from chronofeat.operators.scan import first_epoch, global_min_epoch, prefix_scan

ENTITIES = {"dev": "dev", "merch": "merch", "loc": "loc", "dtype": "dtype", "mcat": "mcat", "pay": "pay", "ttype": "ttype"}
NOVELTY = [n.format(e) for e in ENTITIES for n in ("cust_new_{}", "cust_{}_prior_n", "cust_{}_dt", "cust_{}_share")]
SHARING = ["dev_prior_ncust", "dev_prior_nloc", "dev_new_cust_24h", "dev_new_cust_168h", "dev_cust_churn", "merch_prior_ncust", "merch_prior_ndev"]
DIVERSITY = ["cust_prior_ndev", "cust_prior_nmerch", "cust_prior_nloc", "cust_prior_nmcat", "cust_new_dev_24h", "cust_new_loc_24h", "cust_new_dev_168h", "cust_new_loc_168h", "cust_dev_per_txn"]
MOVEMENT = ["loc_changed_vs_prev", "time_since_loc_change"]
AGE = [f"{k}_{x}" for k in ("dev", "merch") for x in ("age_days", "age_frac", "is_first_seen")] + ["cust_stream_age_days", "cust_stream_age_frac", "cust_txn_per_active_day"]
NAMES = [*NOVELTY, *SHARING, *DIVERSITY, *MOVEMENT, *AGE]


def novelty(df: DataFrame) -> DataFrame:
    df = df.withColumn("__n", prior_count("cust"))
    for short, column in ENTITIES.items():
        key = ("cust", column)
        df = df.withColumns({f"cust_{short}_prior_n": prior_count(*key), f"cust_{short}_dt": prev_gap(key)})
        df = df.withColumns({f"cust_new_{short}": flag((F.col(f"cust_{short}_prior_n") == 0) & (F.col("__n") > 0)), f"cust_{short}_share": safe_div(F.col(f"cust_{short}_prior_n"), F.col("__n"))})
    return df.drop("__n")


def _firsts(df: DataFrame, outer: str, inner: tuple[str, ...]) -> DataFrame:
    """Adds __f_<inner>: 1 where the outer key meets an inner key for the first time; each is found once."""
    known = lambda x: (F.col(f"{outer}_{x}_prior_n") == 0).cast("int") if f"{outer}_{x}_prior_n" in df.columns else first_occurrence(outer, x)
    return df.withColumns({f"__f_{x}": known(x) for x in inner})


def _met(outer: str, x: str) -> Column:
    """Distinct inner keys among the outer key's earlier rows."""
    return n0(F.sum(f"__f_{x}").over(past(outer))).cast("long")


def _new(outer: str, x: str, window: str) -> Column:
    return sum_in_window((outer,), F.col(f"__f_{x}"), WINDOWS_S[window], whole=True).cast("long")


def sharing_of_devices(df: DataFrame) -> DataFrame:
    df = _firsts(df, "dev", ("cust", "loc"))
    df = df.withColumns({"dev_prior_ncust": _met("dev", "cust"), "dev_prior_nloc": _met("dev", "loc")} | {f"dev_new_cust_{w}": _new("dev", "cust", w) for w in ("24h", "168h")})
    return df.withColumn("dev_cust_churn", safe_div(F.col("dev_prior_ncust"), prior_count("dev"))).drop("__f_cust", "__f_loc")


def sharing_of_merchants(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    firsts = {"__fc": first_occurrence("merch", "cust"), "__fd": first_occurrence("merch", "dev")}
    df = prefix_scan(df.withColumns(firsts), ["merch"], {"merch_prior_ncust": F.col("__fc"), "merch_prior_ndev": F.col("__fd")}, base=base.withColumns(firsts)).drop("__fc", "__fd")
    return df.withColumns({c: F.col(c).cast("long") for c in ("merch_prior_ncust", "merch_prior_ndev")})


def sharing(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    return sharing_of_merchants(sharing_of_devices(df), df if base is None else base)


def diversity(df: DataFrame) -> DataFrame:
    every = ("dev", "merch", "loc", "mcat")
    df = _firsts(df, "cust", every)
    df = df.withColumns({f"cust_prior_n{x}": _met("cust", x) for x in every} | {f"cust_new_{x}_{w}": _new("cust", x, w) for x in ("dev", "loc") for w in ("24h", "168h")})
    return df.withColumn("cust_dev_per_txn", safe_div(F.col("cust_prior_ndev"), prior_count("cust"))).drop(*(f"__f_{x}" for x in every))


def movement(df: DataFrame) -> DataFrame:
    w = ordered("cust")
    df = df.withColumn("loc_changed_vs_prev", flag(F.lag("loc").over(w) != F.col("loc")))
    change = F.when(F.col("loc_changed_vs_prev") == 1, F.col("ts_epoch"))
    return df.withColumn("time_since_loc_change", (F.col("ts_epoch") - F.last(change, ignorenulls=True).over(w.rowsBetween(-(2**63), 0))).cast("double"))


def age_of(df: DataFrame, k: str, base: DataFrame | None = None) -> DataFrame:
    """Days since the first row of a customer, device or merchant, and as a share of the stream's age."""
    base = df if base is None else base
    label = "cust_stream" if k == "cust" else k
    df = first_epoch(global_min_epoch(df, "__start", base), [k], "__first", base)
    span = F.greatest((F.col("ts_epoch") - F.col("__start")) / 86_400.0, F.lit(1e-6))
    df = df.withColumn(f"{label}_age_days", (F.col("ts_epoch") - F.col("__first")) / 86_400.0)
    df = df.withColumn(f"{label}_age_frac", clip(F.col(f"{label}_age_days") / span, 0.0, 1.0))
    if k == "cust":
        df = df.withColumn("cust_txn_per_active_day", safe_div(prior_count("cust"), F.greatest("cust_stream_age_days", F.lit(1.0))))
    else:  # the first row is the first of the key's first second
        first = F.row_number().over(ordered(k, "ts_epoch")) == 1
        df = df.withColumn(f"{k}_is_first_seen", flag((F.col("ts_epoch") == F.col("__first")) & first))
    return df.drop("__first", "__start")


def age(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    for k in ("dev", "merch", "cust"):
        df = age_of(df, k, base)
    return df


def build(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    return age(movement(diversity(sharing(novelty(df), base))), base)
