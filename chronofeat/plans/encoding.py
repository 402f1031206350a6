"""Target encodings (13): smoothed past label rates by category, expanding and decayed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.config import TE_ALPHA, TE_HALFLIFE_D
from chronofeat.functions.scalar import hour_bucket
from chronofeat.operators.scan import prefix_scan

COLUMNS = {"location": "loc", "merchant_category": "mcat", "device_type": "dtype", "payment_method": "pay", "transaction_type": "ttype"}
NAMES = [n for c in COLUMNS for n in (f"te_{c}", f"te_{c}_decay")] + ["te_hour_bucket_X_device_type", "te_location_X_transaction_type", "te_merchant_id"]


def trainable(cutoff: str) -> Column:
    return ~F.col("is_test") & (F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def _with_labels(df: DataFrame, cutoff: str) -> DataFrame:
    """__t: 1 where the label may be read; __y: the label there; __hb: the band of hours."""
    df = df.withColumn("__t", F.coalesce(trainable(cutoff), F.lit(False)).cast("double"))
    return df.withColumns({"__y": F.when(F.col("__t") == 1, F.coalesce("label", F.lit(0.0))).otherwise(0.0), "__hb": hour_bucket(F.col("ts"))})


def _with_constants(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """__prior: the mean label over all rows that may be read (later ones, too); __start: the stream's first second."""
    prior = F.coalesce(F.avg(F.when(F.col("__t") == 1, F.col("label"))), F.lit(0.0))
    return df.crossJoin(F.broadcast(labelled.agg(prior.alias("__prior"), F.min("ts_epoch").alias("__start"))))  # one row


def _smooth(y: Column, n: Column, alpha: float) -> Column:
    return (y + F.col("__prior") * alpha) / (n + alpha)


def encode(df: DataFrame, base: DataFrame, keys: list[str], alpha: float, plain: str | None = None, decay: str | None = None, halflife_d: float = TE_HALFLIFE_D) -> DataFrame:
    """Adds the expanding rate (plain) and the decayed one, from one scan over base.

    A past label counts half as much after a half-life: sums of labels times e^(rate t), divided by that of now.
    """
    grown = F.exp(math.log(2) / (halflife_d * 86_400) * (F.col("ts_epoch") - F.col("__start")))
    sums, out = {}, {}
    if plain:
        sums |= {"__sy": F.col("__y"), "__sn": F.col("__t")}
        out[plain] = _smooth(F.col("__sy"), F.col("__sn"), alpha)
    if decay:
        sums |= {"__dy": F.col("__y") * grown, "__dn": F.col("__t") * grown}
        out[decay] = _smooth(F.col("__dy") / grown, F.col("__dn") / grown, alpha)
    return prefix_scan(df, keys, sums, base=base).withColumns(out).drop(*sums)


def build(df: DataFrame, cutoff: str, alpha: float = TE_ALPHA, halflife_d: float = TE_HALFLIFE_D, base: DataFrame | None = None) -> DataFrame:
    """All 13 encodings; base: the stream that df was made from, where that is longer than a source."""
    labelled = _with_labels(df if base is None else base, cutoff)
    start = _with_constants(labelled, labelled)
    df = _with_constants(_with_labels(df, cutoff), labelled)
    for name, column in COLUMNS.items():
        df = encode(df, start, [column], alpha, f"te_{name}", f"te_{name}_decay", halflife_d)
    df = encode(df, start, ["__hb", "dtype"], alpha, "te_hour_bucket_X_device_type")
    df = encode(df, start, ["loc", "ttype"], alpha, "te_location_X_transaction_type")
    return encode(df, start, ["merch"], alpha * 4, "te_merchant_id").drop("__t", "__y", "__prior", "__start", "__hb")
