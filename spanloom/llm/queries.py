"""The registered queries of this subpackage: query name -> function, query name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, egojoin, htmltext, minhash, packing, quality, suffixdedup, tokenstore, toxicity, warc


def tokenizer_path() -> str:
    """Default place of the byte-level vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_path(), 0, 2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeat_report(_table(spark, sf_dir, "documents"), 400, "none", suffixdedup.PASSAGE)


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), 2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op9_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.epsilon_links(_table(spark, sf_dir, "embeddings"), 0.9)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keep, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.url, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k.c > 1 AND k.keep IS NOT NULL AND p.page_id IS DISTINCT FROM k.keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.c > 1 AND k.keep IS NOT NULL AND p.page_id IS DISTINCT FROM k.keep THEN k.keep END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_toxicity, op3_suffix_dedup, op4_dart_minhash, op5_token_files, op6_warc, op7_html_text, op8_quality, op9_epsilon_grid_join, op10_decontamination)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL}
