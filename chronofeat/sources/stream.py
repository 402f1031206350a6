"""Reading, joining, cleaning and checking the transaction stream; writing features and predictions."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofeat.config import MISSING

CATEGORIES = ("dev", "merch", "loc", "mcat", "dtype", "pay", "ttype")
#: Columns of a raw file and their names in the stream.
RAW = {
    "transaction_id": ("txn_id", T.StringType()),
    "timestamp": ("ts", T.TimestampType()),
    "customer_id": ("cust", T.StringType()),
    "merchant_id": ("merch", T.StringType()),
    "device_id": ("dev", T.StringType()),
    "amount_bdt": ("amount", T.DoubleType()),
    "account_age_days": ("account_age_days", T.IntegerType()),
    "merchant_category": ("mcat", T.StringType()),
    "device_type": ("dtype", T.StringType()),
    "location": ("loc", T.StringType()),
    "payment_method": ("pay", T.StringType()),
    "transaction_type": ("ttype", T.StringType()),
}


class StreamError(ValueError):
    """The stream breaks one of its rules."""


def read_csv(spark: SparkSession, path: str, labelled: bool, order: list[str] | None = None) -> DataFrame:
    """A raw CSV file with a header, read with explicit types (columns in the file's order, RAW's by default)."""
    types = {k: t for k, (_, t) in RAW.items()} | ({"fraud": T.DoubleType()} if labelled else {})
    schema = T.StructType([T.StructField(c, types[c]) for c in (order or types)])
    df = spark.read.schema(schema).option("header", True).csv(path)
    names = {k: n for k, (n, _) in RAW.items()} | {"fraud": "label"}
    return df.select(*(F.col(c).alias(names[c]) for c in df.columns))


def read_results(spark: SparkSession, path: str, schema: str = "txn_id string") -> DataFrame:
    """A CSV file with a header, read with the given types: wanted ids, predictions, or results of a search."""
    return spark.read.schema(schema).option("header", True).csv(path)


def union_stream(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labelled and unlabelled rows as one stream; its order is (ts, txn_id), never a physical one."""
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("ts_epoch", F.unix_timestamp("ts"))


def clean(df: DataFrame, indicators: bool = False) -> DataFrame:
    """Missing categories become a level of their own; indicators: {column}_was_missing as well."""
    here = [c for c in CATEGORIES if c in df.columns]
    if indicators:
        df = df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("tinyint") for c in here})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in here})


def add_implied_signup(df: DataFrame) -> DataFrame:
    """Day of signup that the account's age implies, in days since 1970."""
    return df.withColumn("implied_signup_day", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) - F.col("account_age_days"))


def validation_report(df: DataFrame) -> DataFrame:
    """One row with the counts that the stream's rules are about, in one pass (ids: a partial aggregate)."""
    ids = df.groupBy("txn_id").count().agg(F.sum((F.col("count") - 1)).cast("long").alias("duplicate_ids"))
    c = lambda x: F.count_if(x).cast("long")
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        c(F.col("ts").isNull() | F.col("txn_id").isNull()).alias("missing_order"),
        c(~(F.col("amount") > 0) | F.col("amount").isNull()).alias("bad_amounts"),
        c(F.col("account_age_days") < 0).alias("bad_ages"),
        c(~F.col("is_test") & F.col("label").isNull()).alias("train_without_label"),
        c(F.col("is_test") & F.col("label").isNotNull()).alias("test_with_label"),
        c(F.col("ts_epoch") != F.unix_timestamp("ts")).alias("bad_epochs"),
        F.max(F.when(~F.col("is_test"), F.col("ts_epoch"))).alias("train_end"),
        F.min(F.when(F.col("is_test"), F.col("ts_epoch"))).alias("test_start"),
    )
    return one.crossJoin(F.broadcast(ids))  # one row each


def validate(df: DataFrame, rows: int | None = None) -> None:
    r = validation_report(df).first()
    wrong = [k for k in ("duplicate_ids", "missing_order", "bad_amounts", "bad_ages", "train_without_label", "test_with_label", "bad_epochs") if r[k]]
    if r.train_end is not None and r.test_start is not None and r.train_end >= r.test_start:
        wrong.append("train after test")
    if rows is not None and r.n_rows != rows:
        wrong.append("row count")
    if wrong:
        raise StreamError(", ".join(wrong))


def write_features(df: DataFrame, path: str, narrow: bool = True) -> None:
    """Parquet; doubles are narrowed to float at the sink only."""
    if narrow:
        df = df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cached(df: DataFrame, build, path: str, version: str = "1") -> DataFrame:
    """build(df), kept as Parquet below path under a name made of df's schema, its rows and a version of the features.

    Rows are known by their number and by the sum of a hash of each, so changed rows give another name.
    """
    n, rows = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    name = hashlib.sha256(json.dumps([df.schema.json(), n, str(rows), version]).encode()).hexdigest()[:16]
    spark, target = df.sparkSession, f"{path.rstrip('/')}/features-{name}"
    try:
        return spark.read.parquet(target)
    except AnalysisException:  # not built yet
        build(df).write.parquet(target)
        return spark.read.parquet(target)


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=1, default=str))


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text())


def submission(ids: DataFrame, predictions: DataFrame, key: str = "txn_id", value: str = "score") -> DataFrame:
    """Every wanted id with its prediction; ids that lack one are an error."""
    out = ids.select(key).join(predictions.select(key, value), key, "left")
    if out.where(F.col(value).isNull()).take(1):
        raise StreamError("ids without a prediction")
    return out
