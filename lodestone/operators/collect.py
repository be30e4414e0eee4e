"""What a collection run asks for and what it brought: filters, counters, tallies, and the sources that there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content
from lodestone.functions.responses import link_share
from lodestone.operators import addresses, corpus, reader

#: Bytes beyond which a body is refused.
MOST_BYTES = 256 << 20


def of_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    return rows if kind is None else rows.where(F.col("kind") == kind)


def limited(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first rows in an order, each with how many are left after all of them."""
    left = rows.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0).cast("long")).alias("left"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(left))  # one row


def size_gate(bodies: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Bodies (n_bytes) with their state: one over the limit is recorded as an error and its bytes aren't kept."""
    over = F.col("n_bytes") > most
    return bodies.withColumn("state", F.when(over, "error").otherwise("live")).withColumn("detail", F.when(over, F.format_string("%d bytes, over the limit of %d", F.col("n_bytes"), F.lit(most))))


def collect_report(before: DataFrame, brought: DataFrame, members: DataFrame, matched: Column | None = None) -> DataFrame:
    """One row of counters of a run over ``members`` (natural_key): ``before`` is the log, ``brought`` the run's records.

    discovered = already_had + filtered_out + what was left to do; stored, changed and first_seen count observations against
    the latest one before the run, the kinds of refusal apart.
    """
    wanted = members.select("natural_key").distinct()
    had = corpus.observations(before).select("natural_key").distinct()
    asked = wanted.withColumn("fits", F.lit(True) if matched is None else matched).join(had.withColumn("had", F.lit(True)), "natural_key", "left")
    tried = brought.select("natural_key").distinct().withColumn("tried", F.lit(True))
    asked = asked.join(tried, "natural_key", "left")
    todo = F.col("fits") & F.col("had").isNull()
    members_ = asked.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("fits") & F.col("had").isNotNull()).alias("already_had"), F.count_if(~F.col("fits")).alias("filtered_out"),
        F.count_if(todo & F.col("tried").isNull()).alias("remaining"),
    )
    latest = corpus.latest_observations(before).select("natural_key", F.col("fingerprint").alias("was"))
    outcome = brought.join(latest, "natural_key", "left")
    live = F.col("state") == "live"
    records = outcome.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(live).alias("stored"), F.count_if(live & (F.col("was") != F.col("fingerprint"))).alias("changed"), F.count_if(live & F.col("was").isNull()).alias("first_seen"),
        F.count_if(~live).alias("failed"), *[F.count_if(F.col("state") == s).alias(name) for s, name in (("blocked", "blocked"), ("gone", "gone"), ("error", "errored"))],
    )
    return members_.join(F.broadcast(records))  # one row each


def merged_tallies(parts: DataFrame) -> DataFrame:
    """key, value of partial tallies (key, kind, seq, value): counts add up, of totals the last one stands."""
    return parts.groupBy("key", "kind").agg(F.when(F.col("kind") == "count", F.sum("value")).otherwise(F.max_by("value", "seq")).alias("value"))


def ingested(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """url, outcome of fetched addresses (url, body): failed without a body, else first_seen, changed or unchanged against the latest observation."""
    folded = F.regexp_replace(F.regexp_replace("body", r"[ \t\n\r\f]+", " "), "^ | $", "")
    rows = incoming.select("url", F.col("body").isNull().alias("failed"), F.sha2(folded.cast("binary"), 256).alias("now"))
    was = corpus.latest_observations(log).select(F.col("natural_key").alias("url"), F.col("fingerprint").alias("was"))
    outcome = F.when(F.col("failed"), "failed").when(F.col("was").isNull(), "first_seen").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return rows.join(was, "url", "left").select("url", outcome.alias("outcome"))


def checked_pages(pages: DataFrame) -> DataFrame:
    """url, kind, tool, chars, link_share, finding, enclosed, dropped: what extraction makes of given pages (page_id, url, html); nothing is stored.

    finding is null for a good read, "nothing was read", or "menu" where more than half of a page is links.
    """
    read = reader.extract_pages(pages.select("page_id", "html"))
    kinds = pages.select("page_id", "url", content.content_kind(F.lit(None).cast("string"), F.col("html").cast("binary"), F.col("url")).alias("kind"))
    own = addresses.enclosures(pages.select("url", "html")).groupBy("url").agg(F.max(F.size("enclosed")).alias("enclosed"), F.max("dropped").alias("dropped"))
    share = link_share(F.col("text"))
    finding = F.when(F.length("text") == 0, "nothing was read").when(share > 0.5, "menu")
    rows = kinds.join(read, "page_id").join(own, "url", "left")
    return rows.select("page_id", "kind", F.nullif("tool", F.lit("")).alias("tool"), F.length("text").alias("chars"), F.round(share, 6).alias("link_share"), finding.alias("finding"), F.coalesce("enclosed", F.lit(0)).alias("enclosed"), F.coalesce("dropped", F.lit(0).cast("long")).alias("dropped"))


# --- Sources ---


def source_union(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """source, place, configured, stored: those of the configuration (source, place) in its order, then the store's others by name."""
    both = configured.select("source", F.col("place").cast("long"), F.lit(True).alias("c"), F.lit(False).alias("s")).union(stored.select("source", F.lit(None).cast("long"), F.lit(False), F.lit(True)))
    return both.groupBy("source").agg(F.min("place").alias("place"), F.max("c").alias("configured"), F.max("s").alias("stored")).orderBy(F.col("place").asc_nulls_last(), "source")


def enabled_sources(configured: list[dict], named: list[str] | None = None) -> list[str]:
    """Ids to run: the enabled ones (the default), or exactly those that are named, enabled or not; an unknown name is an error."""
    known = [c["id"] for c in configured]
    if named:
        if missing := [n for n in named if n not in known]:
            raise ValueError(f"no such source: {', '.join(missing)}")
        return [i for i in known if i in named]
    return [c["id"] for c in configured if c.get("enabled", True)]


def inferred_sources(log: DataFrame) -> DataFrame:
    """source, kind, target from a log (source, seq, address, method, channel): a channel if it was listed as a playlist, or,
    without a method, has an address of the video site; else a site, whose target is the origin of its first address.

    A channel's target is the newest one that its metadata name; a source without a target has none (null).
    """
    video = F.col("address").rlike(r"(?i)^https?://([a-z0-9-]+\.)*(youtube\.com|youtu\.be)/")
    found = log.groupBy("source").agg(
        F.max(F.coalesce(F.col("method") == "playlist", F.lit(False))).alias("listed"), F.count("method").alias("methods"), F.max(F.coalesce(video, F.lit(False))).alias("video"),
        F.min_by("address", "seq").alias("first"), F.max_by("channel", F.when(F.col("channel").isNotNull(), F.col("seq"))).alias("channel"),
    )
    channel = F.col("listed") | ((F.col("methods") == 0) & F.col("video"))
    origin = F.nullif(F.regexp_extract("first", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
    return found.select("source", F.when(channel, "channel").otherwise("site").alias("kind"), F.when(channel, F.col("channel")).otherwise(origin).alias("target"))


def source_listing(log: DataFrame, most: int = 20) -> DataFrame:
    """source, resources, observations, states ("state=n" by state), problems: a summary of each source of a log (source, natural_key, ...).

    problems are the addresses that fail longest, at most ``most`` of them by name, then how many more.
    """
    keyed = log.withColumn("natural_key", F.struct("source", "natural_key"))
    live = corpus.liveness_state(keyed).select("natural_key.source", F.col("natural_key.natural_key").alias("key"), "state", "consecutive_failures")
    by_state = live.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))
    states = by_state.groupBy("source").agg(F.sum("n").alias("resources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", "n"))), lambda s: F.concat(s["state"], F.lit("="), s["n"])), " ").alias("states"))
    seen = corpus.observations(log).groupBy("source").agg(F.count(F.lit(1)).alias("observations"))
    bad = live.where("state <> 'live'")
    few = worst(bad, most).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("consecutive_failures"), "key"))), lambda p: p["key"].cast("string")), " ").alias("problems"))
    more = bad.groupBy("source").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0).cast("long")).alias("more_problems"))
    return states.join(seen, "source", "left").join(few, "source", "left").join(more, "source", "left").select("source", "resources", F.coalesce("observations", F.lit(0)).alias("observations"), "states", "problems", F.coalesce("more_problems", F.lit(0)).alias("more_problems"))


def worst(liveness: DataFrame, most: int) -> DataFrame:
    """A source's addresses that fail longest; tasks keep their own worst first, so a source with many is no single sort of all."""
    from pyspark.sql import Window

    order = [F.desc("consecutive_failures"), "key"]
    near = Window.partitionBy("source", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)
    few = liveness.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= most)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def append_decisions(rulings: DataFrame, folder: str) -> None:
    """Appends rulings (host, ruling, at, seq) as JSON lines."""
    rulings.select("host", "ruling", "at", "seq").write.mode("append").json(folder)


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All rulings; lines that can't be read are left out."""
    return spark.read.schema("host string, ruling string, at long, seq long").option("mode", "DROPMALFORMED").json(folder)
