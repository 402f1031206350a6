"""Token counts through a digest cache.

The cache is a table (tokenizer, digest, n_tokens): the tokenizer file's digest, the content's digest and the
count. Documents are joined to it by both; only distinct contents that it lacks are encoded, each once, and
their counts are appended. Contents that differ only in runs of blanks, tabs and line ends are one content
for tokenizers that read such a run as one blank.

Results for unusual input: null text: as an empty one, 0 tokens; repeated rows and copies: each row is
returned, their content encoded once; very long texts: whole; null doc_id: returned as it is; an empty table gives an
empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, documents, shared_dir
from chronofeat.llm.tokenization import blanks_are_one, encoder, version

LIMIT = 2048
CACHE = "tokenizer string, digest binary, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; cache: path of the cache table, a new one if None."""
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    tag = version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.regexp_replace(text, "[ \t\r\n]{2,}|[\t\r\n]", " ") if blanks_are_one(tokenizer) else text
    rows = documents(docs).select("doc_id", text.alias("text"), F.unhex(F.md5(content.cast("binary"))).alias("digest"))

    def cached() -> DataFrame:
        try:
            return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        except AnalysisException:  # no cache yet
            return spark.createDataFrame([], "digest binary, n_tokens long")

    # the first document of each content stands for it
    wanted = rows.groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))).alias("k")).select("digest", F.col("k.k").alias("k"))
    misses = wanted.join(cached(), "digest", "left_anti")
    with_text = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).join(misses, ["k", "digest"]).select("k", "digest", "text").dropDuplicates(["k", "digest"]).select("digest", "text")  # rows can share id and content

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in chunks(batches, text="text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.counts(batch.column(1)))], ["digest", "n_tokens"])

    new = with_text.mapInArrow(encode, "digest binary, n_tokens long")
    new.select(F.lit(tag).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    out = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(cached(), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
