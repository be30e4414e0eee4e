"""Passages in closed form, queries, and fusion by reciprocal rank; the stored index is in `store`."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, RUNT = 1200, 80
K1, B, RRF, DEPTH = 1.2, 0.75, 60, 100


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id, source, ordinal, chunk_text, chunk_hash: windows of 1,200 characters; a last one under 80 joins the one before it.

    This is the closed form of the chunker for text without headings and blank lines.
    """
    n = F.length("text")
    windows = F.greatest(F.lit(1), F.ceil(n / TARGET))
    kept = F.when((windows > 1) & (n - (windows - 1) * TARGET < RUNT), windows - 1).otherwise(windows).cast("int")
    rows = documents.where(n > 0).select("doc_id", "source", "text", windows.cast("int").alias("w"), kept.alias("k"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ordinal"))
    start = F.col("ordinal") * TARGET + 1
    body = F.substring("text", start, F.lit(TARGET))
    runt = F.concat(body, F.lit("\n\n"), F.substring("text", start + TARGET, F.lit(TARGET)))
    text = F.when((F.col("ordinal") == F.col("k") - 1) & (F.col("k") < F.col("w")), runt).otherwise(body)
    return rows.select("doc_id", "source", F.col("ordinal").cast("long").alias("ordinal"), text.alias("chunk_text")).withColumn("chunk_hash", F.sha2(F.col("chunk_text").cast("binary"), 256))


def distinct_chunks(placed: DataFrame) -> DataFrame:
    return placed.groupBy("chunk_hash").agg(F.first("chunk_text").alias("chunk_text"), F.count(F.lit(1)).alias("placements"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_phrases(query: str) -> list[list[str]]:
    """The words of each white-space separated term; a term with punctuation inside is a phrase. Quotes separate nothing."""
    found = [re.findall(r"[^\W_]+", term.lower()) for term in query.replace('"', " ").split()]
    return [words for words in found if words]


def fused(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists of chunk_hash."""
    both = words.select("chunk_hash", "rank", F.lit(True).alias("w")).unionByName(vectors.select("chunk_hash", "rank", F.lit(False).alias("w")))
    return both.groupBy("chunk_hash").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 6).alias("rrf_score"), F.max("w").alias("in_bm25"), F.max(~F.col("w")).alias("in_vector"))
