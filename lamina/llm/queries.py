"""The queries over these operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.exact_dedup import exact_duplicates
from lamina.llm.fingerprints import source_fingerprints
from lamina.llm.licenses import license_scan
from lamina.llm.mixing import KEEP, mix
from lamina.llm.near_dedup import near_groups
from lamina.llm.ngram_lm import lm_scores
from lamina.llm.token_counts import token_counts
from lamina.llm.token_shards import token_shards
from lamina.llm.toxicity import toxicity
from lamina.llm.transducer import bpe_encode


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES = {
    "op1_token_counts": lambda s, d: token_counts(_table(s, d, "documents")),
    "op2_token_shards": lambda s, d: token_shards(_table(s, d, "documents")),
    "op3_bpe": lambda s, d: bpe_encode(_table(s, d, "documents")),
    "op4_mix": lambda s, d: mix(_table(s, d, "documents"), keep=KEEP),
    "op5_licenses": lambda s, d: license_scan(_table(s, d, "documents")),
    "op6_exact_duplicates": lambda s, d: exact_duplicates(_table(s, d, "documents")),
    "op7_lm_scores": lambda s, d: lm_scores(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op8_fingerprints": lambda s, d: source_fingerprints(_table(s, d, "documents")),
    "op9_toxicity": lambda s, d: toxicity(_table(s, d, "documents"), _table(s, d, "labels")),
    "op10_near_groups": lambda s, d: near_groups(_table(s, d, "documents")),
}

ORACLE = {
    "op6_exact_duplicates": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
               CAST(CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS BIGINT) AS copies
        FROM documents""",
}
