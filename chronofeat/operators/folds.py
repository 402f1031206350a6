"""Forward-block validation folds as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.config import EMBARGO_S


@dataclass(frozen=True)
class Fold:
    name: str
    train_end: str
    val_start: str
    val_end: str

    def _t(self, x: str) -> Column:
        return F.lit(x).cast("timestamp")

    def train(self) -> Column:
        return ~F.col("is_test") & (F.col("ts") <= self._t(self.train_end))

    def validation(self) -> Column:
        return ~F.col("is_test") & (F.col("ts") >= self._t(self.val_start)) & (F.col("ts") <= self._t(self.val_end))

    def embargo(self, seconds: int = EMBARGO_S) -> Column:
        """Rows in the last seconds before the training end."""
        end = F.unix_timestamp(self._t(self.train_end))
        return (F.col("ts_epoch") > end - seconds) & (F.col("ts_epoch") <= end)

    @property
    def horizon_days(self) -> int:
        return (datetime.fromisoformat(self.val_end) - datetime.fromisoformat(self.val_start)).days + 1


#: Folds of the two test streams.
FOLDS_A = [
    Fold("primary", "2024-01-10 23:59:59", "2024-01-11 00:00:00", "2024-01-20 23:59:59"),
    Fold("wf_1", "2024-01-05 23:59:59", "2024-01-06 00:00:00", "2024-01-10 23:59:59"),
    Fold("wf_2", "2024-01-12 23:59:59", "2024-01-13 00:00:00", "2024-01-16 23:59:59"),
]
FOLDS_B = [Fold("primary", "1999-05-30 23:59:59", "1999-05-31 00:00:00", "2000-06-30 23:59:59")]


def describe_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows, positives and base rate of each fold's two sides, in one pass."""
    sides = F.array(*(F.when(p, F.lit(f"{f.name}/{s}")) for f in folds for s, p in (("train", f.train()), ("val", f.validation()))))
    long = df.select("label", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("side"))
    g = long.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("base_rate"))
    return g.select(F.split("side", "/")[0].alias("fold"), F.split("side", "/")[1].alias("part"), "n", "positives", "base_rate")
