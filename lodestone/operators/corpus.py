"""Views of the observation log: latest state, liveness, versions, changes and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = {"view": "live", "click": "live", "error": "error", "signup": "gone", "purchase": "blocked"}


def observation_log(events: DataFrame) -> DataFrame:
    """natural_key, seq, at, state, fingerprint of each log row."""
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATES.items()], F.lit("error"))
    return events.select(F.col("user_id").alias("natural_key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), state.alias("state"), F.sha2(F.col("props").cast("binary"), 256).alias("fingerprint"))


def observations(log: DataFrame) -> DataFrame:
    return log.where("state = 'live'")


def latest_observations(log: DataFrame) -> DataFrame:
    """The newest observation of each address; of equal times the later in the log."""
    return observations(log).groupBy("natural_key").agg(F.max_by(F.struct("seq", "at", "fingerprint"), F.struct("at", "seq")).alias("o")).select("natural_key", "o.seq", "o.at", "o.fingerprint")


#: An address with more observations than this is put in order in up to SPANS tasks.
ORDERED, SPANS = 100_000, 256


def _in_order(rows: DataFrame) -> DataFrame:
    """Observations with their number and the fingerprint before them, by address.

    The observations of an address that has very many are dealt into spans of time (between quantiles of its own
    times), ordered within each, and joined up by what each span holds and ends with. Other addresses are one span.
    """
    many = rows.groupBy("natural_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ORDERED).select("natural_key")
    quantiles = F.array([F.lit(i / SPANS) for i in range(1, SPANS)])
    cuts = rows.join(many, "natural_key", "left_semi").groupBy("natural_key").agg(F.percentile_approx("at", quantiles, 10_000).alias("cuts"))
    placed = rows.join(cuts, "natural_key", "left")
    span = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("at"))), F.lit(0))
    placed = placed.withColumn("span", F.when(F.col("cuts").isNull(), 0).otherwise(span)).drop("cuts")
    order = Window.partitionBy("natural_key", "span").orderBy("at", "seq")
    inside = placed.withColumn("row", F.row_number().over(order)).withColumn("before", F.lag("fingerprint").over(order))
    ends = placed.groupBy("natural_key", "span").agg(F.count(F.lit(1)).alias("size"), F.max_by("fingerprint", F.struct("at", "seq")).alias("last"))
    spans_in_order = Window.partitionBy("natural_key").orderBy("span")
    earlier = ends.select("natural_key", "span", (F.sum("size").over(spans_in_order) - F.col("size")).alias("earlier"), F.lag("last").over(spans_in_order).alias("last")).where("earlier > 0")
    joined = inside.join(earlier, ["natural_key", "span"], "left")
    return joined.withColumn("version", (F.col("row") + F.coalesce("earlier", F.lit(0))).cast("long")).withColumn("from_fp", F.when(F.col("row") == 1, F.col("last")).otherwise(F.col("before")))


def change_events(log: DataFrame) -> DataFrame:
    """Appearances and modifications: an observation whose fingerprint differs from the one before it."""
    rows = _in_order(observations(log))
    kind = F.when(F.col("from_fp").isNull(), "appeared").otherwise("modified")
    return rows.where("from_fp is null or from_fp <> fingerprint").select("natural_key", "seq", kind.alias("kind"), "from_fp", F.col("fingerprint").alias("to_fp"))


def version_history(log: DataFrame) -> DataFrame:
    """Each observation's number among its address's, from 1."""
    return _in_order(observations(log)).select("natural_key", "version", "seq", "fingerprint")


def known_addresses(log: DataFrame, discovered: DataFrame) -> DataFrame:
    """Addresses that were observed, have a status, or were discovered, and in which of these ways."""
    seen = log.select("natural_key", (F.col("state") == "live").alias("observed"), (F.col("state") != "live").alias("judged"), F.lit(False).alias("discovered"))
    found = discovered.select("natural_key", F.lit(False).alias("observed"), F.lit(False).alias("judged"), F.lit(True).alias("discovered"))
    return seen.union(found).groupBy("natural_key").agg(*[F.max(c).alias(c) for c in ("observed", "judged", "discovered")])


def liveness_state(log: DataFrame) -> DataFrame:
    """state, since when (by seq of the record that entered it), failures in a row of each address.

    No address is sorted: two rounds of partial aggregates find its newest record, the newest of another state and the
    newest live one, and then what came after these. An address with a third of the log is split like any other.
    """
    place = F.struct("at", "seq")
    by_state = log.groupBy("natural_key", "state").agg(F.max(place).alias("last"))
    newest = by_state.groupBy("natural_key").agg(F.max_by("state", "last").alias("now"), F.max(F.when(F.col("state") == "live", F.col("last"))).alias("lived"))
    other = by_state.join(newest, "natural_key").where("state <> now").groupBy("natural_key").agg(F.max("last").alias("left"))
    marks = newest.join(other, "natural_key", "left").withColumnRenamed("now", "state")
    rows = log.select("natural_key", place.alias("place")).join(marks, "natural_key")
    entered = F.when(F.col("left").isNull() | (F.col("place") > F.col("left")), F.col("place"))
    failed = F.col("lived").isNull() | (F.col("place") > F.col("lived"))
    found = rows.groupBy("natural_key", "state").agg(F.min(entered).alias("entered"), F.count_if(failed).alias("consecutive_failures"))
    return found.select("natural_key", "state", F.col("entered.seq").alias("since_seq"), "consecutive_failures")


def discovery_delta(log: DataFrame) -> DataFrame:
    """Addresses found on each day, and those new and vanished against the run before it."""
    members = log.select(F.date_format("at", "yyyy-MM-dd").alias("day"), "natural_key").distinct()
    days = members.select("day").distinct().select("day", F.lag("day").over(Window.orderBy("day")).alias("previous"), F.lead("day").over(Window.orderBy("day")).alias("next"))
    placed = members.join(days, "day")  # a row a run; Spark broadcasts it by its measured size
    earlier = members.select(F.col("day").alias("previous"), "natural_key", F.lit(1).alias("was"))
    later = members.select(F.col("day").alias("next"), "natural_key", F.lit(1).alias("stays"))
    found = placed.join(earlier, ["previous", "natural_key"], "left").groupBy("day").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("was").isNull()).alias("new"))
    gone = placed.where("next is not null").join(later, ["next", "natural_key"], "left_anti").groupBy(F.col("next").alias("day")).agg(F.count(F.lit(1)).alias("vanished"))
    return found.join(gone, "day", "left").select("day", "found", "new", F.coalesce("vanished", F.lit(0)).alias("vanished"))


def source_summary(log: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """How many addresses are in each state, and how many records they have."""
    current = liveness_state(log)
    totals = log.groupBy("natural_key").agg(F.count(F.lit(1)).alias("n"))
    return current.join(totals, "natural_key").groupBy("state").agg(F.count(F.lit(1)).alias("resources"), F.sum("n").alias("records"))


def worklist_collect(log: DataFrame) -> DataFrame:
    """Addresses of the newest discovery that were never observed."""
    days = log.withColumn("day", F.to_date("at"))
    newest = days.agg(F.max("day").alias("day"))
    return days.join(F.broadcast(newest), "day").select("natural_key").distinct().join(observations(log), "natural_key", "left_anti")


def corpus_status(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """source, kind, total, distinct_bytes, missing: by source and kind, by source, by kind and over all (null where all are meant).

    ``log`` has source, kind and blob_sha of each document, ``blobs`` blob_sha and n_bytes of what is stored. Bytes of a blob
    count once in each row, so those over all are at most the sum of the sources'; a blob that isn't stored counts as missing.
    """
    own = log.groupBy("source", "kind", "blob_sha").agg(F.count(F.lit(1)).alias("n")).join(blobs.select("blob_sha", "n_bytes"), "blob_sha", "left")
    parts = []
    for keys in (["source", "kind"], ["source"], ["kind"], []):
        one = own.groupBy(*keys, "blob_sha").agg(F.sum("n").alias("n"), F.first("n_bytes").alias("bytes"))
        found = one.groupBy(*keys).agg(F.sum("n").alias("total"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("distinct_bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"))
        parts.append(found.select(F.lit("+".join(keys) or "all").alias("level"), *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("source", "kind")], "total", "distinct_bytes", "missing"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
