"""The passage index as tables: what is outstanding, what a source owns, which document wins, and how targets resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def observed(documents: DataFrame) -> DataFrame:
    """source, resource, blob_sha, derived_sha, seq of each document as an observation and its derivation."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    derived = F.sha2(F.regexp_replace("text", r"[ \t\n\r\f]+", " ").cast("binary"), 256)
    return documents.where("text is not null").select("source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("resource"), sha.alias("blob_sha"), derived.alias("derived_sha"), F.col("doc_id").alias("seq"))


def worklist_extract(log: DataFrame, derived: DataFrame, underivable: DataFrame) -> DataFrame:
    """Blobs to extract: neither derived yet nor given up on by this pipeline at this version."""
    return log.select("blob_sha").distinct().join(derived, "blob_sha", "left_anti").join(underivable, "blob_sha", "left_anti")


def extract_counters(log: DataFrame, derived: DataFrame, underivable: DataFrame) -> DataFrame:
    """How many blobs are derived, given up on, and left, in one pass over the blobs."""
    blobs = log.select("blob_sha").distinct().join(derived.select("blob_sha", F.lit(1).alias("d")).distinct(), "blob_sha", "left").join(underivable.select("blob_sha", F.lit(1).alias("u")).distinct(), "blob_sha", "left")
    left = F.col("d").isNull() & F.col("u").isNull()
    return blobs.agg(F.count("d").alias("already_derived"), F.count_if(F.col("d").isNull() & F.col("u").isNotNull()).alias("already_unextractable"), F.count_if(left).alias("todo"))


def worklist_index(log: DataFrame, placed: DataFrame) -> DataFrame:
    """Addresses whose derivation has no placement yet."""
    return log.select("source", "resource", "derived_sha").distinct().join(placed, ["source", "resource", "derived_sha"], "left_anti")


def latest_derivations(derivations: DataFrame) -> DataFrame:
    """The newest derivation of each blob; of equal times the later line."""
    return derivations.groupBy("blob_sha").agg(F.max_by(F.struct("derived_sha", "at", "seq"), F.struct("at", "seq")).alias("d")).select("blob_sha", "d.*")


def blob_verified(blobs: DataFrame) -> DataFrame:
    """The blobs with their bytes checked: a row whose hash differs fails the query where its bytes are read."""
    fits = F.sha2("bytes", 256) == F.col("sha")
    return blobs.withColumn("bytes", F.when(fits, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("corrupt blob "), "sha"))))


def clear_source(placed: DataFrame, source: str) -> DataFrame:
    """Passages that still have a placement when a source's are gone."""
    return placed.where(~F.col("source").eqNullSafe(source)).select("chunk_hash").distinct()


def index_report(placed: DataFrame) -> DataFrame:
    """Per source: passages that it brought first, and those that an earlier document had.

    Placements are counted by passage and source before they meet, so a passage with very many is no single task.
    """
    counted = placed.groupBy("chunk_hash", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "ordinal", "source")).alias("first"))
    first = counted.groupBy("chunk_hash").agg(F.min("first").alias("f"))
    written = first.groupBy("f.source").agg(F.count(F.lit(1)).alias("chunks_written"))
    total = counted.groupBy("source").agg(F.sum("n").alias("n"))
    same = total["source"].eqNullSafe(written["source"])
    return total.join(written, same, "left").select(total["source"], F.coalesce("chunks_written", F.lit(0)).alias("chunks_written"), (F.col("n") - F.coalesce("chunks_written", F.lit(0))).alias("deduplicated"))


def address_times(log: DataFrame) -> DataFrame:
    """blob_sha, source, resource, first_seen: every address that ever served a blob, and when it first did."""
    return log.groupBy("blob_sha", "source", "resource").agg(F.min("at").alias("first_seen"))


def derived_addresses(derivations: DataFrame, log: DataFrame) -> DataFrame:
    """Each newest derivation (blob_sha, derived_sha, at, seq) at every address of its blob, with the earliest time there.

    Addresses are dealt by hash, so a blob at very many addresses is several tasks.
    """
    salts = 16
    at = address_times(log).withColumn("salt", F.pmod(F.xxhash64("resource"), F.lit(salts)).cast("int"))
    newest = latest_derivations(derivations).select("blob_sha", "derived_sha").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return at.join(newest, ["blob_sha", "salt"]).select("source", "resource", "blob_sha", "derived_sha", "first_seen")


def derived_from(derivations: DataFrame) -> DataFrame:
    """derived_sha, blob_sha: the original of each derived text, that of the last line where several led to one."""
    return derivations.groupBy("derived_sha").agg(F.max_by("blob_sha", "seq").alias("blob_sha"))


def index_order(derivations: DataFrame) -> DataFrame:
    """The newest derivations in the order in which they are indexed: by time, then by hash."""
    return latest_derivations(derivations).orderBy("at", "derived_sha")


def resolve_target(log: DataFrame, target: str, most: int = 10) -> DataFrame:
    """What a target names: a blob by its hash's prefix, else a derivation by its, else an address, equal before containing.

    Only the first of the three branches that finds anything is kept; position 0 is the match, the others follow up to `most`.
    """
    is_hash = F.lit(target).rlike("^[0-9a-fA-F]{8,}$")
    prefix = target.lower()
    by_blob = is_hash & F.col("blob_sha").startswith(prefix)
    by_derived = is_hash & F.col("derived_sha").startswith(prefix)
    by_address = F.contains("resource", F.lit(target))
    branch = F.when(by_blob, 0).when(by_derived, 1).when(by_address, 2)
    hits = log.select("resource", "blob_sha", branch.alias("branch")).where("branch is not null")
    best = hits.agg(F.min("branch").alias("branch"))
    kept = hits.join(F.broadcast(best), "branch")  # one row
    exact = (F.col("resource") != target).cast("int")
    top = kept.orderBy(exact, "resource").limit(most + 1)
    return top.select("resource", "blob_sha", F.col("branch").cast("int").alias("branch"), (F.row_number().over(Window.orderBy(exact, "resource")) - 1).cast("long").alias("position"))


def resolved_page(log: DataFrame, bodies: DataFrame, target: str, offset: int = 0, most: int = 20_000, source: str | None = None) -> DataFrame:
    """resource, page, total_chars, truncated: a page of the text (blob_sha, text) that a target names, within a source if one is given."""
    inside = log if source is None else log.where(F.col("source") == source)
    one = resolve_target(inside, target, 0).select("resource", "blob_sha")
    total = F.length("text")
    found = bodies.select("blob_sha", "text").join(F.broadcast(one), "blob_sha").limit(1)  # one row; equal bodies are one
    return found.select("resource", F.substring("text", offset + 1, most).alias("page"), total.cast("long").alias("total_chars"), (total > offset + most).alias("truncated"))


def resolved_bytes(log: DataFrame, bodies: DataFrame, target: str, offset: int = 0, most: int = 32_768, source: str | None = None) -> DataFrame:
    """resource, page (base64), total_bytes, truncated: the same of the bytes (blob_sha, bytes)."""
    inside = log if source is None else log.where(F.col("source") == source)
    one = resolve_target(inside, target, 0).select("resource", "blob_sha")
    total = F.octet_length("bytes")
    found = bodies.select("blob_sha", "bytes").join(F.broadcast(one), "blob_sha").limit(1)
    return found.select("resource", download_page(F.col("bytes"), offset, most).alias("page"), total.cast("long").alias("total_bytes"), (total > offset + most).alias("truncated"))


def download_page(body: Column, offset: int = 0, most: int = 32_768) -> Column:
    """Bytes from an offset, in base64 without line breaks."""
    return F.regexp_replace(F.base64(F.substring(body, offset + 1, most)), r"[\r\n]", "")


def script_bytes(html: Column) -> Column:
    """Bytes inside script elements."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), 1)
    return F.aggregate(bodies, F.lit(0), lambda s, x: s + F.octet_length(x)).cast("long")


def page_leads(pages: DataFrame) -> DataFrame:
    """Anchors, script bytes, and whether scripts are more than half of each page; a null page has none."""
    html = F.coalesce("html", F.lit(""))
    anchors = F.regexp_count(html, F.lit(r"(?i)<a\s")).cast("long")
    scripts = script_bytes(html)
    return pages.select("page_id", anchors.alias("anchors"), scripts.alias("script_bytes"), (scripts * 2 > F.octet_length(html)).alias("mostly_script"))
