"""Caption tracks: cues from their JSON, and stamped paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import segments
from lodestone.shipping import ship
from lodestone.sources.log import checkpointed

#: Copies of one cue that travel as one row.
REPEATS = 64
JSON3 = "events array<struct<tStartMs:long,dDurationMs:long,segs:array<struct<utf8:string>>>>"


def looks_like_json3(head: Column) -> Column:
    """Whether the first 4,096 characters hold a marker of the caption format."""
    return F.substring(head, 1, 4096).rlike("wireMagic|tStartMs")


def hms(ms: Column) -> Column:
    """HH:MM:SS; hours aren't wrapped, negative times are 0."""
    s = F.greatest(F.floor(ms / 1000), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def json3_cues(body: Column) -> Column:
    """Array of (start_ms, end_ms, text); cues without text are left out. Null where the body isn't of the format."""

    def cue(e: Column) -> Column:
        start = F.coalesce(e["tStartMs"], F.lit(0).cast("long"))
        text = F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
        end = start + F.greatest(F.coalesce(e["dDurationMs"], F.lit(0).cast("long")), F.lit(0).cast("long"))
        return F.struct(start.alias("start_ms"), end.alias("end_ms"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))

    return F.filter(F.transform(F.from_json(body, JSON3)["events"], cue), lambda c: c["text"] != "")


def caption_paragraphs(cues: DataFrame) -> DataFrame:
    """track, session, paragraph, start_ms, text: from cues (track, start_ms, end_ms, text), blank ones and those without a time left out.

    A silence over 10 s ends a paragraph, and so does the end of a sentence after 600 bytes, or 1,200 bytes. A session is speech
    without such a silence. Cues that repeat are each said; a null track is one of its own. Cues are put in order over all
    partitions by ranges, so a track may lie in many tasks; see segments for how they are cut. A paragraph's stretches in several
    batches are then joined; it has 1,200 bytes and one cue at most.
    """
    spark = ship(cues.sparkSession)
    order = ["track", "start_ms", "end_ms", "text"]
    times = [F.col(c).cast("long").alias(c) for c in order[1:3]]
    spoken = cues.select("track", *times, F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> '' and start_ms is not null and end_ms is not null")
    counted = spoken.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    rows = blocks.select(*order, "block", F.least(F.lit(REPEATS), F.col("n") - F.col("block") * REPEATS).cast("int").alias("times"))
    ranges = rows.repartitionByRange(*order, "block").sortWithinPartitions(*order, "block")
    stop = F.substring("text", -1, 1).isin(".", "?", "!")
    ordered = checkpointed(ranges.select(*order, F.octet_length("text").cast("long").alias("size"), stop.alias("stop"), "times", F.spark_partition_id().cast("long").alias("span")))
    levels = [checkpointed(segments.spans(ordered))]
    while levels[-1].count() > segments.FAN:
        levels.append(checkpointed(segments.composed(levels[-1])))
    states = None
    for level in reversed(levels):
        states = segments.entered(level, states)
    # Five numbers of each partition: what its tasks begin with.
    starts = {r["span"]: segments.State(*r[2:]) if r["known"] else None for r in states.toLocalIterator()}
    pieces = segments.cut(ordered, starts).groupBy("track", "session", "paragraph").agg(F.min("start_ms").alias("start_ms"), F.array_sort(F.collect_list(F.struct("place", "words"))).alias("words"))
    said = F.array_join(F.transform("words", lambda w: w["words"]), " ")
    return pieces.select("track", "session", "paragraph", "start_ms", F.concat(F.lit("["), hms(F.col("start_ms")), F.lit("] "), said).alias("text"))
