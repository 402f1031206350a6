"""Past-only window primitives: statistics over rows of the same key strictly earlier in (ts, txn_id).

All are Column builders, so one key's primitives share one exchange and sort. A range of seconds is a running sum
over earlier rows less one over the seconds out of reach: both frames only grow, so a key's time is linear in its
rows, while a sliding frame is summed anew for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.functions.scalar import n0

ORDER = ("ts", "txn_id")
START = Window.unboundedPreceding
#: What sums of doubles are taken in: parts of one, and a power of two for what is larger; and values too large for that.
UNITS, COARSE, LARGEST = 10_000.0, 2.0**30, 1e300


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def past(*keys: str) -> Window:
    return ordered(*keys).rowsBetween(START, -1)


def prior_count(*keys: str) -> Column:
    return (F.row_number().over(ordered(*keys)) - 1).cast("long")


def _out_of_reach(keys: tuple[str, ...], seconds: int) -> Window:
    return Window.partitionBy(*keys).orderBy("ts_epoch").rangeBetween(START, -seconds - 1)


def count_in_window(keys: tuple[str, ...], seconds: int) -> Column:
    return (prior_count(*keys) - F.count(F.lit(1)).over(_out_of_reach(keys, seconds))).cast("long")


def sum_in_window(keys: tuple[str, ...], value: Column, seconds: int, whole: bool = False) -> Column:
    """whole: the values are small whole numbers, whose sums are exact as they are.

    Others are split into multiples of COARSE, ten-thousandths and what is left of them: the first two are whole numbers,
    whose sums as doubles are exact to 9e15, so that the difference of two running sums keeps its last digits. Values that
    are not finite (or beyond 1e300, as such) count while they are in reach.
    """
    now, gone = past(*keys), _out_of_reach(keys, seconds)
    less = lambda x: n0(F.sum(x).over(now)) - n0(F.sum(x).over(gone))
    if whole:
        return less(value)
    pieces, odd = _pieces(value)
    return _total([less(x) for x in pieces], [F.max(x).over(now) for x in odd], seconds)


#: Values whose sums are kept apart, in the order of _pieces.
ODD = (float("inf"), -float("inf"), float("nan"))


def _pieces(value: Column) -> tuple[list[Column], list[Column]]:
    """Multiples of COARSE, ten-thousandths and the rest of a finite value; and the row's time where it is one of ODD."""
    value = value.cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < LARGEST), value)
    coarse = F.rint(finite / COARSE)
    fine = finite - coarse * COARSE
    units = F.rint(fine * UNITS)
    here = [F.isnan(value) if x != x else (value >= LARGEST) & ~F.isnan(value) if x > 0 else value <= -LARGEST for x in ODD]
    return [coarse, units, fine - units / UNITS], [F.when(x, F.col("ts_epoch")) for x in here]


def _total(pieces: list[Column], last: list[Column], seconds: int) -> Column:
    coarse, units, rest = pieces
    total = coarse * COARSE + (units / UNITS + rest)
    for x, t in zip(ODD, last):
        total = total + F.when(t >= F.col("ts_epoch") - seconds, F.lit(x)).otherwise(0.0)
    return total


def sums_in_windows(df: DataFrame, keys: tuple[str, ...], value: Column, windows: dict[str, int]) -> DataFrame:
    """Adds sum_in_window for each name and its seconds; what all windows share is summed once."""
    pieces, odd = _pieces(value)
    df = df.withColumns({f"__v{i}": x for i, x in enumerate(pieces)} | {f"__o{i}": x for i, x in enumerate(odd)})
    now = past(*keys)
    df = df.withColumns({f"__s{i}": n0(F.sum(f"__v{i}").over(now)) for i in range(3)} | {f"__l{i}": F.max(f"__o{i}").over(now) for i in range(3)})
    gone = lambda i, seconds: n0(F.sum(f"__v{i}").over(_out_of_reach(keys, seconds)))
    last = [F.col(f"__l{i}") for i in range(3)]
    df = df.withColumns({name: _total([F.col(f"__s{i}") - gone(i, seconds) for i in range(3)], last, seconds) for name, seconds in windows.items()})
    return df.drop(*(f"__{x}{i}" for x in "vosl" for i in range(3)))


def prev_gap(keys: tuple[str, ...], lag: int = 1) -> Column:
    return (F.col("ts_epoch") - F.lag("ts_epoch", lag).over(ordered(*keys))).cast("double")


def prev_value(keys: tuple[str, ...], value: Column, lag: int = 1) -> Column:
    return F.lag(value, lag).over(ordered(*keys))


def expanding(keys: tuple[str, ...], value: Column, how: str) -> Column:
    """how: mean, std (sample), max, min, median (exact, interpolated)."""
    w = past(*keys)
    if how == "median":
        return F.percentile(value, 0.5).over(w)
    return {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}[how](value).over(w)


def rolling_mean(keys: tuple[str, ...], value: Column, k: int) -> Column:
    """Mean of up to k previous values (of fewer, where there are no more)."""
    return F.avg(value).over(ordered(*keys).rowsBetween(-k, -1))


def first_occurrence(*keys: str) -> Column:
    return (F.row_number().over(ordered(*keys)) == 1).cast("int")


def running_nunique(df: DataFrame, outer: tuple[str, ...], inner: tuple[str, ...], name: str) -> DataFrame:
    """Distinct inner keys among the outer key's earlier rows: a running sum of first occurrences."""
    first = f"__first_{name}"
    return df.withColumn(first, first_occurrence(*outer, *inner)).withColumn(name, n0(F.sum(first).over(past(*outer))).cast("long")).drop(first)


def new_pairs_in_window(df: DataFrame, outer: tuple[str, ...], inner: tuple[str, ...], seconds: int, name: str) -> DataFrame:
    """Inner keys first met by the outer key within the window."""
    first = f"__first_{name}"
    return df.withColumn(first, first_occurrence(*outer, *inner)).withColumn(name, sum_in_window(outer, F.col(first), seconds, whole=True).cast("long")).drop(first)
