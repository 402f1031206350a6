"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

* toxicity: documents predicted toxic go; all others stay as they are.
* ngram_jaccard_join: of each group of near duplicates the document with the smallest doc_id stays.
* suffix_dedup: later copies of passages of PASSAGE_WORDS words, and of strings of 400 bytes, go from the texts, n_chars
  is brought up to date, and a document that loses all of its text goes.
* decontamination: documents with a benchmark leak go.
* packing: one row for each piece of what is left.

A document is a row: decisions are kept by a hash of doc_id and text, so rows of one doc_id with different texts are judged
apart. Results for unusual input: null or empty texts stay to the end, where they are packed as an end token;
rows with null doc_id are judged like others (in a group of near duplicates they stay only if no row has an id); rows
equal in doc_id and text are copies: the second and third stages leave one of them; very long texts: whole; ties
cannot come about, as ids and hashes decide; empty tables: empty results; other columns, whatever their names, are kept
as they are by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm._common import fit_for_broadcast, release, shared_dir, store
from chronofeat.llm.decontamination import find_leaks
from chronofeat.llm.jaccard_join import jaccard_components
from chronofeat.llm.packing import pack
from chronofeat.llm.suffix_dedup import drop_later_copies
from chronofeat.llm.toxicity import score_toxicity

#: SQL can express neither the classifier nor the retrieval order; tests compare with brute force.
ORACLE_SQL = None

#: Passages of over 50 words must go; 50, as a passage's first or last word may have a quote or a stop attached to it.
PASSAGE_WORDS = 50


def _uid(docs: DataFrame) -> Column:
    """The hash by which operators know a row; columns by their place, as names can clash."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _without(docs: DataFrame, uids: DataFrame) -> DataFrame:
    """docs without the rows whose hash is in uids (uid)."""
    gone = fit_for_broadcast(store(uids.select("uid").distinct(), "gone"))
    return docs.join(gone, _uid(docs) == gone["uid"], "left_anti")


def _one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that are equal in doc_id and text; rows without text all stay."""
    some = docs.where("text <> ''")
    repeated = store(some.groupBy(_uid(some).alias("uid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid"), "repeated")
    if not repeated.take(1):
        return docs
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), _uid(docs).alias("uid"))
    again = rows.join(fit_for_broadcast(repeated), "uid", "left_semi").dropDuplicates(["uid"]).select("row.*")
    return _without(docs, repeated).union(again)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 0").select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _one_of_each(docs)
    rows = store(jaccard_components(docs, carry=True).where("label is not null").select("uid", "label", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid").alias("order")), "groups")
    first = rows.groupBy("label").agg(F.min("order").alias("first"))
    return _without(docs, rows.join(first, "label").where("uid <> first.uid"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_later_copies(_one_of_each(docs), n_words=PASSAGE_WORDS).where("kept <> '' or row.text is null or row.text = ''")
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("row.text") == F.col("kept"), F.col("row.n_chars")).otherwise(F.length("kept"))}
    return kept.select(*(new.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # by single pieces and by whole values: a name that stands right after another word's capital is joined to it
    single, whole = (find_leaks(docs, benchmark, joined=j, carry=True).select("uid") for j in (False, True))
    return _without(docs, single.union(whole))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            release(before)
        before = docs
    return docs
