"""Helpers that the training-data operators share: shared storage, batching and word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows above which a side is joined by shuffle rather than broadcast.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fit_for_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (stored, narrow) marked for broadcast if it has at most so many rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and a worker and its executor hold whole batches.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(df: DataFrame) -> DataFrame:
    """The two columns the operators read, by name, whatever else df holds."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_row(df: DataFrame, carry: bool) -> DataFrame:
    """doc_id and text, and with carry the whole row as a struct `row`."""
    small_batches(df.sparkSession)
    base = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return df.select(*base, *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []))


def out_schema(df: DataFrame, columns: str, carry: bool) -> T.StructType:
    out = T.StructType.fromDDL(columns)
    return out.add("row", df.schema) if carry else out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives memory that is free within this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 2_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about max_bytes of text at most (a longer text alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, one after another (null: none), and where each begins and the last ends."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, at, data = column.buffers()
    ends = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A mask for each number of bytes that a last piece of a word has.
_ENDS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes above which a word is hashed by itself.
_LONG = 256


def words_in(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words (without white space) of texts start, their bytes, and how many each text has; texts as utf8() gives them."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    word = _WORD[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = ends[1:-1]
    inner = cut[(cut > 0) & (cut < len(raw))]
    inner = inner[word[inner] & word[inner - 1]]  # two texts' words that touch
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.diff(np.searchsorted(starts, ends))


def hashes_at(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of bytes at these places."""
    h = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    todo, at = np.flatnonzero(lengths <= _LONG), 0
    while len(todo):
        left = lengths[todo] - at
        h[todo] = mix((h[todo] ^ (eight[starts[todo] + at] & _ENDS[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(memoryview(padded)[starts[i] : starts[i] + lengths[i]])
    return h


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a column of texts, A-Z in lower case, and how many words each text has."""
    raw, ends = utf8(column)
    raw = _LOWER[raw]
    starts, lengths, n = words_in(raw, ends)
    return hashes_at(raw, starts, lengths), n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped_sum(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, and each values array summed by key."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _at_rest(edges: DataFrame) -> bool:
    """Whether edges (u, v) with v < u are stars: every u has one v, and no v is a u."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1))
    ).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not roles.where("below > 1 or below + above > 1").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b); label: the smallest node of its connected component.

    Large-star and small-star rounds in turn, stored after each, until only stars are left. Edges that are stars
    from the start, such as the result of an earlier call, cost no round. A node's smallest neighbour comes from a
    partial aggregate, so a hub's edges need not meet in one task.
    """
    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _at_rest(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = store(small, "edges")
        release(e)
        e = new
    # every edge is (node, smallest of its component)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
