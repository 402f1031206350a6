"""Prefix scans for keys with many rows each, or for the whole stream.

A window over a key with a large part of all rows runs in one task. Here rows are cut into buckets of time;
each (key, bucket) is summed by a partial aggregate, the sums are accumulated over a key's buckets (a small
table), and the window within a bucket adds the rest. No task holds more than one bucket of a key.

Each function reads the stream twice. base is the stream that the second reading starts from: callers that chain
scans pass the source, so that a plan grows with the number of scans and doesn't double with each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.functions.scalar import n0
from chronofeat.operators.past import ORDER, START

DAY_S = 86_400


def prefix_scan(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], last_epoch: str | None = None, bucket_s: int = DAY_S, base: DataFrame | None = None) -> DataFrame:
    """Adds, for each name in sums, the sum over the key's earlier rows; last_epoch: the time of the row before."""
    b = "__bucket"
    bucket = F.floor(F.col("ts_epoch") / bucket_s).cast("long")
    base, df = (df if base is None else base).withColumn(b, bucket), df.withColumn(b, bucket)
    part = {f"__s{i}": e for i, e in enumerate(sums.values())}
    totals = base.groupBy(*keys, b).agg(*(F.sum(e).alias(n) for n, e in part.items()), F.max("ts_epoch").alias("__last"))
    by_bucket = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(b).rowsBetween(START, -1)
    before = totals.select(*keys, b, *(n0(F.sum(n).over(by_bucket)).alias(f"{n}p") for n in part), F.max("__last").over(by_bucket).alias("__lastp"))
    # a row for each key and bucket: Spark broadcasts it where it is small and shuffles it where not
    joined = df.join(before, [*keys, b])
    inside = Window.partitionBy(*keys, b).orderBy(*ORDER)
    frame = inside.rowsBetween(START, -1)
    joined = joined.withColumns({name: n0(F.col(f"{n}p")) + n0(F.sum(e).over(frame)) for name, (n, e) in zip(sums, part.items())})
    if last_epoch:
        joined = joined.withColumn(last_epoch, F.coalesce(F.lag("ts_epoch").over(inside), "__lastp"))
    return joined.drop(b, "__lastp", *(f"{n}p" for n in part))


def bucketed_range_count(df: DataFrame, keys: Sequence[str], windows: dict[str, int], base: DataFrame | None = None) -> DataFrame:
    """Adds, for each name, the count of the key's earlier rows within so many seconds (windows up to a day).

    Rows are dealt by key and day and lent to the next day, where they count but are not returned.
    """
    longest = max(windows.values())
    b, lent = "__bucket", "__lent"
    own = df.withColumn(b, F.floor(F.col("ts_epoch") / longest).cast("long")).withColumn(lent, F.lit(False))
    slim = [F.col(c) if c in {*keys, "ts_epoch", *ORDER} else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    guest = (df if base is None else base).select(*slim, (F.floor(F.col("ts_epoch") / longest) + 1).cast("long").alias(b), F.lit(True).alias(lent))
    both = own.unionByName(guest)
    # growing frames: a sliding one is counted anew for each row
    met = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*ORDER)) - 1
    gone = lambda seconds: F.count(F.lit(1)).over(Window.partitionBy(*keys, b).orderBy("ts_epoch").rangeBetween(START, -seconds - 1))
    out = {name: (met - gone(seconds)).cast("long") for name, seconds in windows.items()}
    return both.withColumns(out).where(~F.col(lent)).drop(b, lent)


def first_epoch(df: DataFrame, keys: Sequence[str], name: str, base: DataFrame | None = None) -> DataFrame:
    """Adds the key's first time in the stream, by a partial aggregate; it is of no later row than any row."""
    return df.join((df if base is None else base).groupBy(*keys).agg(F.min("ts_epoch").alias(name)), list(keys))


def global_min_epoch(df: DataFrame, name: str, base: DataFrame | None = None) -> DataFrame:
    return df.crossJoin(F.broadcast((df if base is None else base).agg(F.min("ts_epoch").alias(name))))  # one row
