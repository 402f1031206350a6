"""Canonical streams over the test tables, as SQL that both Spark and DuckDB read but for two expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.sources.stream import clean

COLUMNS = "txn_id, ts, ts_epoch, cust, dev, merch, loc, mcat, dtype, pay, ttype, amount, account_age_days, is_test, label"

_A = """SELECT event_id AS txn_id, ts, {epoch} AS ts_epoch, user_id AS cust, 'D' || k AS dev, 'M' || (event_id % 37) AS merch,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'L' || (event_id % 11) END AS loc, 'C' || (event_id % 6) AS mcat, 'T' || (k % 4) AS dtype,
  'P' || (k % 5) AS pay, 'Y' || (event_id % 3) AS ttype, value AS amount,
  CAST(user_id % 400 + {day} - {first_day} AS INT) AS account_age_days, ts >= TIMESTAMP '2024-01-21 00:00:00' AS is_test,
  CASE WHEN ts >= TIMESTAMP '2024-01-21 00:00:00' THEN NULL WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END AS label
FROM ({events}) e"""

_B = """SELECT o_orderkey AS txn_id, o_orderdate AS ts, {epoch} AS ts_epoch, o_custkey AS cust, CAST(l.sk AS {text}) AS dev, CAST(l.pk AS {text}) AS merch,
  CAST(s.s_nationkey AS {text}) AS loc, c.c_mktsegment AS mcat, 'T' || (o_orderkey % 4) AS dtype, o_orderpriority AS pay, o_orderstatus AS ttype,
  o_totalprice AS amount, CAST(o_custkey % 400 + {day} - {first_day} AS INT) AS account_age_days, o_orderdate >= TIMESTAMP '2000-07-01 00:00:00' AS is_test,
  CASE WHEN o_orderdate >= TIMESTAMP '2000-07-01 00:00:00' THEN NULL WHEN o_orderkey % 50 = 0 THEN 1.0E0 ELSE 0.0E0 END AS label
FROM {orders} o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN {supplier} s ON s.s_suppkey = l.sk LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey"""

_NA = "SELECT txn_id, ts, ts_epoch, cust, coalesce(dev, '__NA__') AS dev, coalesce(merch, '__NA__') AS merch, coalesce(loc, '__NA__') AS loc, coalesce(mcat, '__NA__') AS mcat, coalesce(dtype, '__NA__') AS dtype, coalesce(pay, '__NA__') AS pay, coalesce(ttype, '__NA__') AS ttype, amount, account_age_days, is_test, label FROM ({raw}) r"

_DUCK_A = _A.format(epoch="(epoch_us(ts) // 1000000)", day="(epoch_us(ts) // 86400000000)", first_day="19723", events="SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_DUCK_B = _B.format(epoch="(epoch_us(o_orderdate) // 1000000)", day="(epoch_us(o_orderdate) // 86400000000)", first_day="9131", text="VARCHAR", orders="orders", lineitem="lineitem", supplier="supplier", customer="customer")
#: A common table expression `s` with the stream, for DuckDB.
DUCK = {"a": f"WITH s AS ({_NA.format(raw=_DUCK_A)})", "b": f"WITH s AS ({_NA.format(raw=_DUCK_B)})"}
DUCK_RAW = {"a": _DUCK_A, "b": _DUCK_B}


def raw_stream(spark: SparkSession, sf_dir: str, which: str = "a") -> DataFrame:
    """Stream a: events; stream b: orders with a derived device. Missing categories are null."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    day = "datediff(CAST({0} AS DATE), DATE '1970-01-01')"
    if which == "a":
        e = read("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        sql = _A.format(epoch="unix_timestamp(ts)", day=day.format("ts"), first_day="19723", events="SELECT * FROM {events}")
        return spark.sql(sql, events=e)
    o = read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    sql = _B.format(epoch="unix_timestamp(o_orderdate)", day=day.format("o_orderdate"), first_day="9131", text="STRING", orders="{orders}", lineitem="{lineitem}", supplier="{supplier}", customer="{customer}")
    return spark.sql(sql, orders=o, lineitem=read("lineitem"), supplier=read("supplier"), customer=read("customer"))


def stream(spark: SparkSession, sf_dir: str, which: str = "a") -> DataFrame:
    return clean(raw_stream(spark, sf_dir, which)).select(*COLUMNS.split(", "))
