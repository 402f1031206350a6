"""Exact running medians in one pass over a key's rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from chronofeat.operators.past import ORDER


def running_median(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(txn_id, name): the median of the key's values in strictly earlier rows; null without any.

    A window's percentile is taken anew for each row. Here rows stream by in order, and two heaps hold a key's values so
    far: the time is n log n, and what a task holds is the values of one key, not its rows.
    """
    rows = df.select("txn_id", key, *ORDER[:1], value.cast("double").alias("__v"))
    rows = rows.repartition(key).sortWithinPartitions(key, *ORDER).select("txn_id", key, "__v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, low, high = none, [], []
        for batch in batches:
            out = []
            for k, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if k != at or at is none:
                    at, low, high = k, [], []
                out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
                if v is None or v != v:
                    continue
                # low holds the smaller half, negated, and one more where the number is odd
                if len(low) > len(high):
                    heapq.heappush(high, -heapq.heappushpop(low, -v))
                else:
                    heapq.heappush(low, -heapq.heappushpop(high, v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["txn_id", name])

    return rows.mapInArrow(run, f"txn_id {dict(df.dtypes)['txn_id']}, {name} double")
