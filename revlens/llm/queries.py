"""The corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import centroids, decontaminate, fuzzy_lines, gray_index, main_text, near_dups, packing, perplexity, ranked_search, substrings, surrogates
from revlens.llm import token_counts, toxicity
from revlens.llm.common import table
from revlens.llm.oracle import ORACLE


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("corpus.surrogate.key", "a key of the caller's own")
    return surrogates.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op6_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_index.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_main_text": op3_html_main_text,
    "op4_token_counts": op4_token_counts,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_ngram_perplexity": op6_ngram_perplexity,
    "op7_noisy_channel_toxicity": op7_noisy_channel_toxicity,
    "op8_fuzzy_lines": op8_fuzzy_lines,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroid_clusters": op13_centroid_clusters,
}

__all__ = ["ORACLE", "QUERIES"]
