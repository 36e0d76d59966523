"""The subpackage's queries over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import ann, exact_dedup, langid, lm_scoring, mixing, packing, quality, superminhash, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_own(_table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100; they search all vectors."""
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify_language(docs, langid.train(docs))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_neighbours,
        op3_toxicity,
        op4_quality,
        op5_mixing,
        op6_near_duplicates,
        op7_exact_duplicates,
        op8_language,
        op9_token_files,
        op10_packing,
    )
}

ORACLES = {
    "op5_mixing": mixing.ORACLE,
    "op7_exact_duplicates": """
        SELECT doc_id, first AS duplicate_of
        FROM (SELECT doc_id, first_value(doc_id) OVER w AS first, row_number() OVER w AS n
              FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST))
        WHERE n > 1""",
}
