"""A cleaning pipeline over ``documents``: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.minhash import without_near_duplicates
from lodestone.llm.mixing import sampled
from lodestone.llm.packing import packed
from lodestone.llm.perplexity import accepted
from lodestone.llm.session import checkpointed, table
from lodestone.llm.substrings import deduplicated_documents
from lodestone.shipping import ship

#: The tokenizer whose ids the last stage packs.
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band accept.

    Null, empty and very short texts go; a null language is a language of its own. Of rows that repeat an id all go if one is
    rejected. An empty table stays empty; other columns pass unchanged, whatever their names.
    """
    ship(spark)
    return accepted(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class at Jaccard 0.8 of 5-word shingles.

    Texts without words and rows without an id stay; of rows that repeat an id one stays. An empty table stays empty; other
    columns pass unchanged.
    """
    ship(spark)
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a smaller id has; n_chars follows the text.

    A document of which no word is left goes. Rows without an id keep their texts and remove nothing. A text that loses nothing stays
    as it is, white space included; one that does has its words joined by one space. An empty table stays empty.
    """
    ship(spark)
    return deduplicated_documents(docs, window=50).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have raked token weights.

    Null sources and languages are values of their own. Rows with one id, and those without an id, stay or go together. An
    empty table stays empty; other columns pass unchanged.
    """
    ship(spark)
    return sampled(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of 4,096 tokens.

    Null and empty texts are the end id alone; rows without an id and rows that repeat are packed each. An empty table gives no piece.
    """
    ship(spark)
    return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: SQL can express neither the language model nor the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is kept in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
