"""Calendar and circular-time features (18, and one behind a switch)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.functions.scalar import flag, hour_angle, safe_div
from chronofeat.operators.past import expanding, past
from chronofeat.operators.scan import prefix_scan
from chronofeat.sources.stream import add_implied_signup

CALENDAR = ["hour", "minute_of_day", "dayofweek", "day_of_month", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_night", "is_deep_night", "account_age_log", "days_since_signup"]
CIRCULAR = ["cust_time_concentration", "cust_ang_dev", "cust_ang_dev_weighted"]
#: Angle of each minute of the day, its factors in the order of the SQL.
MINUTES = [(m // 60 + m % 60 / 60.0) * 2 * math.pi / 24.0 for m in range(1440)]
NAMES = [*CALENDAR[:11], *CIRCULAR, "hour_volume_share", "account_age_days", *CALENDAR[11:]]


def calendar(df: DataFrame) -> DataFrame:
    hour, dow, angle = F.hour("ts"), F.weekday("ts"), hour_angle(F.col("ts"))
    week = dow * (2 * math.pi / 7)
    return df.withColumns(
        {
            "hour": hour,
            "minute_of_day": hour * 60 + F.minute("ts"),
            "dayofweek": dow,
            "day_of_month": F.dayofmonth("ts"),
            "is_weekend": flag(dow >= 5),
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
            "dow_sin": F.sin(week),
            "dow_cos": F.cos(week),
            "is_night": flag(hour < 5),
            "is_deep_night": flag((hour >= 1) & (hour < 5)),
            "account_age_log": F.log1p("account_age_days"),
            "days_since_signup": F.col("account_age_days").cast("double"),
        }
    )


def circular(df: DataFrame) -> DataFrame:
    """How concentrated the customer's past hours are, and how far this one is from their mean.

    Opposite hours cancel but for the last bits of their sines, which then are the mean's whole direction: sines are
    those of the C library for each minute of the day, as the SQL has them, since the JVM's differ in the last bit.
    """
    angle, w, minute = hour_angle(F.col("ts")), past("cust"), F.hour("ts") * 60 + F.minute("ts") + 1
    c, s = (F.element_at(F.lit([f(x) for x in MINUTES]), minute) for f in (math.cos, math.sin))
    df = df.withColumns({"__c": F.avg(c).over(w), "__s": F.avg(s).over(w)})
    off = angle - F.atan2("__s", "__c")
    df = df.withColumns({"cust_time_concentration": F.sqrt(F.col("__c") ** 2 + F.col("__s") ** 2), "cust_ang_dev": F.abs(F.atan2(F.sin(off), F.cos(off)))})
    return df.withColumn("cust_ang_dev_weighted", F.col("cust_ang_dev") * F.col("cust_time_concentration")).drop("__c", "__s")


def volume_share(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Share of all earlier rows that fell in this hour of the day."""
    base = (df if base is None else base).withColumn("__h", F.hour("ts"))
    df = prefix_scan(df.withColumn("__h", F.hour("ts")), ["__h"], {"__same": F.lit(1)}, base=base)
    df = prefix_scan(df, [], {"__all": F.lit(1)}, base=base)
    return df.withColumn("hour_volume_share", safe_div(F.col("__same"), F.col("__all"))).drop("__h", "__same", "__all")


def signup_inconsistency(df: DataFrame) -> DataFrame:
    df = add_implied_signup(df)
    day = F.col("implied_signup_day")
    return df.withColumn("signup_inconsistency_d", F.abs(day - expanding(("cust",), day, "median"))).drop("implied_signup_day")


def build(df: DataFrame, base: DataFrame | None = None, use_signup_inconsistency: bool = False) -> DataFrame:
    df = volume_share(circular(calendar(df)), df if base is None else base)
    return signup_inconsistency(df) if use_signup_inconsistency else df
