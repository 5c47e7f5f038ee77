"""The training-corpus pipeline: quality, near duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a
stage's result as Parquet in the shared folder and rereads it for the next.  All
but the last return the columns of documents.  Defined cases are those of the operators: a null
text is junk to the first stage, repeated rows leave one copy after the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, minhash, packing, quality, suffixdedup
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of over 50 words are repeats, however few bytes they have.
PASSAGE = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    docs = docs.select(*COLUMNS)
    return quality.scored(docs, quality.train(docs)).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.near_duplicates(docs, COLUMNS).where("kept").select(*COLUMNS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of long repeated strings and of passages of PASSAGE words."""
    return suffixdedup.without_repeats(docs, words=PASSAGE).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminated(docs.select(*COLUMNS), benchmark).where("not contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in training sequences."""
    return packing.best_fit_pack(docs, tokenizer_path(), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("leaks", leak_stage),
    ("packing", packing_stage),
]

#: Learned models and hashed signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
