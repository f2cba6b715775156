"""The registered queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations, collocations_sql
from .common import table
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .language import identify_languages
from .mixture_packing import pack_mixture
from .packing import pack_sequences
from .quality import quality_bands
from .sharding import place_documents, placement_sql
from .suffix_dedup import suffix_array_dedup
from .token_counts import edit_aware_counts
from .toxicity import toxicity
from .vector_codes import vector_codes


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


def op2_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_documents(table(spark, sf_dir, "documents"))


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_aware_counts(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mixture(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array_dedup,
        op2_bm25_decontamination,
        op3_html_extraction,
        op4_language_mixtures,
        op5_compression_bands,
        op6_toxicity,
        op7_lookup_sharding,
        op8_edit_aware_counts,
        op9_best_fit_packing,
        op10_jaccard_join,
        op11_mixture_packing,
        op12_vector_codes,
        op13_phrase_collocations,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    """Placement and collocations are plain SQL; the others are tested against brute force, round trips or held-out rows."""
    return {"op7_lookup_sharding": placement_sql(), "op13_phrase_collocations": collocations_sql()}
