"""Velocity features (57): counts, gaps and sums in trailing windows by customer, device, merchant, location and pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.config import VELOCITY_WINDOWS, WINDOWS_S
from chronofeat.functions.scalar import n0, safe_div
from chronofeat.operators.median import running_median
from chronofeat.operators.past import count_in_window, expanding, prev_gap, prior_count, sums_in_windows
from chronofeat.operators.scan import bucketed_range_count, prefix_scan


def names(k: str) -> list[str]:
    out = [f"{k}_prior_n", f"{k}_dt", f"{k}_log_dt"]
    if k in ("cust", "dev"):
        out += [f"{k}_dt2", f"{k}_dt3", f"{k}_dt_vs_typical"]
    for w in VELOCITY_WINDOWS[k]:
        out += [f"{k}_n_{w}"] + ([f"{k}_amt_sum_{w}", f"{k}_amt_mean_{w}"] if k in ("cust", "dev") else [])
    return out + {"cust": ["cust_burst_1h_24h", "cust_burst_24h_168h", "cust_txn_per_day"], "dev": ["dev_burst_1h_24h"]}.get(k, [])


PAIR = ["custdev_prior_n", "custdev_dt", "custdev_n_24h", "custdev_share_24h"]
NAMES = [*names("cust"), *names("dev"), *names("merch"), *names("loc"), *PAIR]


def by_entity(df: DataFrame, k: str, median: bool = True) -> DataFrame:
    """For customers and devices: one exchange and sort of the key serves all.

    median: the typical gap from a window, which fits keys of up to some hundred rows; typical_gap is for others.
    """
    key = (k,)
    df = df.withColumns({f"{k}_prior_n": prior_count(k), f"{k}_dt": prev_gap(key), f"{k}_dt2": prev_gap(key, 2), f"{k}_dt3": prev_gap(key, 3)})
    df = df.withColumn(f"{k}_log_dt", F.log1p(f"{k}_dt"))
    if median:  # the first gap is no gap; it enters the history as 0
        df = df.withColumn(f"{k}_dt_vs_typical", safe_div(F.col(f"{k}_dt"), expanding(key, n0(F.col(f"{k}_dt")), "median")))
    df = df.withColumns({f"{k}_n_{w}": count_in_window(key, WINDOWS_S[w]) for w in VELOCITY_WINDOWS[k]})
    df = sums_in_windows(df, key, F.col("amount"), {f"{k}_amt_sum_{w}": WINDOWS_S[w] for w in VELOCITY_WINDOWS[k]})
    df = df.withColumns({f"{k}_amt_mean_{w}": safe_div(F.col(f"{k}_amt_sum_{w}"), F.col(f"{k}_n_{w}")) for w in VELOCITY_WINDOWS[k]})
    burst = {f"{k}_burst_1h_24h": safe_div(F.col(f"{k}_n_1h"), F.col(f"{k}_n_24h"))}
    if k == "cust":
        burst |= {"cust_burst_24h_168h": safe_div(F.col("cust_n_24h"), F.col("cust_n_168h")), "cust_txn_per_day": safe_div(F.col("cust_prior_n"), F.greatest("account_age_days", F.lit(1)))}
    return df.withColumns(burst)


def typical_gap(df: DataFrame, k: str) -> DataFrame:
    """(txn_id, __typical) for keys with many rows: the median of earlier gaps."""
    return running_median(df.withColumn("__gap", n0(prev_gap((k,)))), k, F.col("__gap"), "__typical")


def by_hub(df: DataFrame, k: str, base: DataFrame | None = None) -> DataFrame:
    """For merchants and locations, a few of which have most rows: scans over buckets of time."""
    base = df if base is None else base
    df = prefix_scan(df, [k], {f"{k}_prior_n": F.lit(1)}, last_epoch="__last", base=base)
    df = df.withColumns({f"{k}_prior_n": F.col(f"{k}_prior_n").cast("long"), f"{k}_dt": (F.col("ts_epoch") - F.col("__last")).cast("double")}).drop("__last")
    df = df.withColumn(f"{k}_log_dt", F.log1p(f"{k}_dt"))
    return bucketed_range_count(df, [k], {f"{k}_n_{w}": WINDOWS_S[w] for w in VELOCITY_WINDOWS[k]}, base)


def pair(df: DataFrame) -> DataFrame:
    key = ("cust", "dev")
    df = df.withColumns({"custdev_prior_n": prior_count(*key), "custdev_dt": prev_gap(key), "custdev_n_24h": count_in_window(key, WINDOWS_S["24h"])})
    of_cust = F.col("cust_n_24h") if "cust_n_24h" in df.columns else count_in_window(("cust",), WINDOWS_S["24h"])
    return df.withColumn("custdev_share_24h", safe_div(F.col("custdev_n_24h"), of_cust))


def build(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = df if base is None else base
    # coarse keys first: windows over (cust, dev) reuse the exchange by cust
    return by_hub(by_hub(by_entity(pair(by_entity(df, "cust")), "dev"), "merch", base), "loc", base)
