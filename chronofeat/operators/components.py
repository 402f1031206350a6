"""Connected components by alternating large-star and small-star rounds, stored between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(df: DataFrame) -> tuple[str, DataFrame]:
    """A folder that driver and executors share, and the rows as they are read from there."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def _store(df: DataFrame) -> DataFrame:
    return store(df)[1]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Nodes that a task knows at a time while it looks for cycles.
KNOWN = 500_000


def forest(edges: DataFrame, by: str | None = None) -> DataFrame:
    """Edges (u, v, ...) without those that close a cycle in their task: what is connected stays so.

    by: a column; then what edges up to any value of it connect stays connected by those kept up to it.

    A task sees all edges of its v, so dense graphs lose nearly all edges in this one pass. When a task knows KNOWN nodes it
    forgets them and begins anew, which keeps more edges and loses no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            kept = []
            for i, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (a := top(u)) != (b := top(v)):
                    up[a] = b
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))
            if len(up) > KNOWN:
                up.clear()

    dealt = edges.repartition("v")
    return (dealt.sortWithinPartitions(by) if by else dealt).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component; edges (a, b) of any one orderable type."""
    e = _store(forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")).distinct())
    last = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", "m")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = _store(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        last = now
