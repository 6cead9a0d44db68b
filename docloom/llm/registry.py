"""Queries over the driver's tables, one for each operator, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import divergence, exact_dedup, hard_negatives, html_text, mixing, near_dedup, packing, quality, substring_dedup, token_count, toxicity, url_filter, vector_search
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.mislabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_vector_search, op3_toxicity, op4_quality, op5_substring_dedup, op6_mixing, op7_packing, op8_token_count, op9_url_filter, op10_html_text,
        op11_exact_dedup, op12_hard_negatives, op13_source_divergence, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE, "op2_vector_search": vector_search.ORACLE, "op6_mixing": mixing.ORACLE, "op9_url_filter": url_filter.oracle(),
    "op11_exact_dedup": exact_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_source_divergence": divergence.ORACLE,
}
