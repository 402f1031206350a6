"""One query for each operator: whole tables, whole texts, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofeat.llm.decontamination import LEAKS_SQL, find_leaks
from chronofeat.llm.html_wrapper import extract_main_text
from chronofeat.llm.jaccard_join import jaccard_components
from chronofeat.llm.katz import katz_scores
from chronofeat.llm.language_id import identify_language
from chronofeat.llm.packing import pack
from chronofeat.llm.suffix_dedup import repeat_digests
from chronofeat.llm.token_counts import count_tokens
from chronofeat.llm.topk_search import topk
from chronofeat.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda s, d: score_toxicity(_table(s, d, "documents"), _table(s, d, "labels")),
    "op2_html_extraction": lambda s, d: extract_main_text(_table(s, d, "pages")),
    "op3_ngram_jaccard_join": lambda s, d: jaccard_components(_table(s, d, "documents")),
    "op4_topk_search": lambda s, d: topk(_table(s, d, "embeddings")),
    "op5_decontamination": lambda s, d: find_leaks(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op6_language_id": lambda s, d: identify_language(_table(s, d, "documents")),
    "op7_token_counts": lambda s, d: count_tokens(_table(s, d, "documents")),
    "op8_packing": lambda s, d: pack(_table(s, d, "documents")),
    "op9_lm_scoring": lambda s, d: katz_scores(_table(s, d, "documents")),
    "op10_suffix_dedup": lambda s, d: repeat_digests(_table(s, d, "documents")),
}

#: DuckDB SQL where SQL can express the operator at a bearable cost.
LLM_SQL: dict[str, str] = {
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_decontamination": LEAKS_SQL,
}
