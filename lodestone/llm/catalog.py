"""The queries of this folder's operators and their SQL, as ``__spark_entry__`` registers them.

op3 to op6, op9 and op10 have no SQL; tests/llm holds them against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bilinear import language_scores
from lodestone.llm.embeddings import near_duplicate_vectors
from lodestone.llm.html_text import main_text
from lodestone.llm.language import identified
from lodestone.llm.merkle import manifest
from lodestone.llm.minhash import near_duplicates
from lodestone.llm.mixing import mixed
from lodestone.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)
from lodestone.llm.packing import packed
from lodestone.llm.perplexity import judged
from lodestone.llm.phrases import collocations
from lodestone.llm.session import table
from lodestone.llm.substrings import without_repeats
from lodestone.llm.topk import best_matches
from lodestone.llm.unigram import token_counts
from lodestone.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(ship(spark), sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(ship(spark), sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(ship(spark), sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(ship(spark), sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(ship(spark), sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(ship(spark), sf_dir, "documents"), shingle_words=4)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(ship(spark), sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(ship(spark), sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(ship(spark), sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_matches(table(ship(spark), sf_dir, "embeddings")).drop("query_row")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(ship(spark), sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_substring_dedup, op3_quality_rules, op4_source_mixing, op5_token_counts,
        op6_lm_scoring, op7_minhash_near_dedup, op8_html_extraction, op9_language_id, op10_packing,
        op11_phrase_collocations, op12_exact_topk, op13_merkle_manifest,
    )
}
