"""Exact top-k search by inner product: MaxScore over sharded postings.

A component of a vector is a term, and a term's postings are the values of a shard's vectors there. As vectors are
dense, nearly every vector is in every posting list: lists are kept as the columns of a matrix, without ids, and
traversed STRIDE vectors at a time for a block of queries at once, where each list has its largest and smallest value. For a
query, a list can add at most (query value x extreme value). Lists are put in order of that bound, summed over the block's queries. For
a query, those whose bounds together stay below its k-th best score so far are non-essential: a vector whose sum over the
others, the essential lists, leaves more to reach than that can't get in. The lists that are essential for any query of
the block are traversed for all vectors, as one product of matrices; the remaining lists are probed for the
pairs of query and vector that can still reach the query's k-th best score, which is checked again after every few lists. Shards are
searched apart and their best k merged. All pairs of a query and a vector are bounded or scored, so the work grows with the
square of the rows; vectors travel in the smallest integers that hold them.

Query blocks meet each shard as one row, so a task holds one shard and one block. Results for unusual input:
vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths are
apart: a query's candidates are those of its own length; rows with the same id stand
for themselves (a query never gets a row of its own id); fewer than k candidates: all; rows with null ids take no part;
very long vectors: as others (a shard's memory grows with their length); ties: the smaller id first, and of equal ids any; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.llm._common import fit_for_broadcast, store

SHARD, BLOCK = 8192, 1024
#: Vectors scored in one go; the k-th best scores are brought up to date in between.
STRIDE = 2048


def best_of(row: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (row, score, id) of each row: rows ascending, scores descending, ids ascending among equals."""
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], s[keep], i[keep]


def maxscore(shard: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a shard for each query, as (place of the query, score, id), best first."""
    largest = shard.shape[1] * int(np.abs(shard).max(initial=0)) * int(np.abs(queries).max(initial=0))
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # sums stay exact
    fast, none = queries.astype(kind), np.iinfo(np.int64).min
    top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    theta = np.full(len(queries), none)
    for at in range(0, len(ids), STRIDE):
        v, vid = shard[at : at + STRIDE], ids[at : at + STRIDE]
        most = np.maximum(0, np.maximum(queries * v.max(0), queries * v.min(0)))  # bound of a term's positive contribution
        terms = np.argsort(-most.sum(0, dtype=np.float64), kind="stable")
        rest = np.zeros((len(queries), len(terms) + 1), np.int64)  # bound of a term and all after it
        rest[:, :-1] = np.cumsum(most[:, terms][:, ::-1], axis=1)[:, ::-1]
        # a vector in no essential list has no positive contribution there
        essential = max(1, int((rest >= theta[:, None]).sum(1).max(initial=0)))
        essential = min(essential, len(terms))
        fast_v = v.astype(kind)
        score = fast[:, terms[:essential]] @ fast_v[:, terms[:essential]].T
        alive = vid != query_ids[:, None]
        known = theta > none
        if known.any():
            alive &= (score >= (theta - rest[:, essential]).astype(np.int64)[:, None]) | ~known[:, None]
        if not known.all() and len(vid) > k and essential == len(terms):
            # the k-th best of a query's others, as one that isn't among them may be its own row
            own = np.where(alive, score, kind(-largest - 1) if kind is not np.int64 else none)
            alive &= score >= np.partition(own, len(vid) - k, axis=1)[:, len(vid) - k][:, None]
        row, column = np.nonzero(alive)
        found, done = score[row, column], essential
        while done < len(terms) and len(row):
            some = terms[done : done + 8]
            found = found + (fast[:, some][row] * fast_v[:, some][column]).sum(1, dtype=kind)
            done += len(some)
            keep = found >= np.where(known[row], theta[row] - rest[row, done], none)
            row, column, found = row[keep], column[keep], found[keep]
        top = best_of(np.r_[top[0], row], np.r_[top[1], found.astype(np.int64)], np.r_[top[2], vid[column]], k)
        last = np.flatnonzero(np.r_[top[0][1:] != top[0][:-1], True]) if len(top[0]) else np.zeros(0, np.int64)
        full = last[np.diff(np.r_[-1, last]) == k]
        theta[top[0][full]] = top[1][full]
    return top


def smallest(m: np.ndarray) -> np.ndarray:
    """m in the smallest integers that hold it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def quantise(vectors: DataFrame, scale: int, column: str) -> DataFrame:
    """vec_id and q: floor(scale x component) as integers, of the vectors that take part."""
    q = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    whole = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")).where("vec_id is not null")


def topk(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    rows = store(quantise(vectors, scale, column).withColumn("dim", F.size("q")), "vectors")
    # one row for each length of vectors
    sizes = store(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / (every * BLOCK)).cast("int").alias("blocks")), "sizes")
    few = fit_for_broadcast(sizes)
    schema = "dim int, shard int, ids binary, vectors binary"

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        m = np.array(t["q"].combine_chunks().flatten()).reshape(len(order), -1)[order]
        return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "ids": [t["vec_id"].to_numpy()[order].tobytes()], "vectors": [smallest(m).tobytes()]})

    def packed(df: DataFrame, count: str) -> DataFrame:
        dealt = df.join(few, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "q"), F.col(count)).cast("int"))
        return dealt.select("dim", "shard", "vec_id", "q").groupBy("dim", "shard").applyInArrow(pack, schema)

    # the stated query set in blocks against all rows: every block is sent to every shard of its vectors' length
    blocks = packed(rows.where(F.col("vec_id") % every == 0), "blocks").join(few, "dim")
    sent = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    pairs = packed(rows, "shards").join(sent, ["dim", "shard"]).select("dim", "ids", "vectors", "query_ids", "queries")
    tasks = 2 * spark.sparkContext.defaultParallelism
    shards = sizes.agg(F.sum("shards")).first()[0] or 1

    def unpack(data: pa.BinaryScalar, rows: int, dim: int) -> np.ndarray:
        raw = np.frombuffer(data.as_buffer(), np.uint8)
        return raw.view(f"i{len(raw) // (rows * dim)}").reshape(rows, dim).astype(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, vectors_, query_ids, queries_ in zip(*(c for c in batch.columns)):
                ids, query_ids = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(query_ids.as_py(), np.int64)
                row, score, vec_id = maxscore(unpack(vectors_, len(ids), dim.as_py()), ids, unpack(queries_, len(query_ids), dim.as_py()), query_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.repartition(max(shards, tasks)).mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
