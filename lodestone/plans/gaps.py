"""Queries of collections, sources, ledgers and derivations over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content
from lodestone.functions import responses as R
from lodestone.operators import collect, corpus, crumbs, index, runs, strategies, text
from lodestone.sources.log import append_journal, append_log, append_vectors, blob_count, put_blobs, read_log, scratch, stored_model
from lodestone.sources.tables import table
from lodestone.streaming import log as stream_log

#: Sources that a configuration names, in its order, and what an address must contain.
CONFIGURED, MATCHES = ["src3", "extra", "src1"], "7"
LIMIT, MOST_CHARS = 50, 5000


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.observation_log(table(spark, folder, "events"))


def _by_source(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).withColumn("source", F.concat(F.lit("s"), (F.col("natural_key") % 5).cast("string")))


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return index.observed(table(spark, folder, "documents")).withColumn("at", F.col("seq") % 11)


def _journal(spark: SparkSession, folder: str) -> DataFrame:
    """The events as attempts: a schedule for each address, an outcome for each type."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").when(F.col("event_type") == "purchase", "skipped").otherwise("ok")
    return table(spark, folder, "events").select(F.format_string("r%09d", F.col("event_id")).alias("run_id"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("schedule"), outcome.alias("outcome"), F.col("ts").alias("started_at"))


def _days(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log before its last day, and that day's records."""
    last = log.agg(F.max(F.to_date("at")).alias("last"))
    dated = log.join(F.broadcast(last))  # one row
    return dated.where("to_date(at) < last").drop("last"), dated.where("to_date(at) = last").drop("last")


def collect_report(spark: SparkSession, folder: str) -> DataFrame:
    before, brought = _days(_events(spark, folder))
    members = brought.where("seq % 3 <> 0").union(before.where("seq % 4 = 0"))
    return collect.collect_report(before, brought, members, F.col("natural_key").cast("string").contains(MATCHES))


def merged_tallies(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "total").otherwise("count")
    return collect.merged_tallies(table(spark, folder, "events").select(F.col("event_type").alias("key"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("user_id").alias("value")))


def worklist_limited(spark: SparkSession, folder: str) -> DataFrame:
    return collect.limited(table(spark, folder, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], LIMIT)


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as they come, against a log that has every second one, every sixth in another version."""
    pages = table(spark, folder, "pages").where("url is not null")
    folded = F.regexp_replace(F.regexp_replace("html", r"[ \t\n\r\f]+", " "), "^ | $", "")
    body = F.when(F.col("page_id") % 6 == 0, F.concat(folded, F.lit("!"))).otherwise(folded)
    log = pages.where("page_id % 2 = 0").select(F.col("url").alias("natural_key"), F.col("page_id").alias("seq"), F.col("page_id").alias("at"), F.lit("live").alias("state"), F.sha2(body.cast("binary"), 256).alias("fingerprint"))
    return collect.ingested(pages.select("url", F.when(F.col("page_id") % 5 != 0, F.col("html")).alias("body")), log)


def size_gate(spark: SparkSession, folder: str) -> DataFrame:
    return collect.size_gate(table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("n_bytes")), MOST_CHARS)


def known_addresses(spark: SparkSession, folder: str) -> DataFrame:
    log = _events(spark, folder)
    return corpus.known_addresses(log.where("seq % 2 = 0"), log.where("seq % 5 = 0").select("natural_key"))


def source_union(spark: SparkSession, folder: str) -> DataFrame:
    configured = spark.createDataFrame(list(enumerate(CONFIGURED)), "place long, source string")
    return collect.source_union(configured, table(spark, folder, "documents").select("source").where("source is not null").distinct())


def inferred_sources(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    log = pages.select(F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string")).alias("source"), F.col("page_id").alias("seq"), F.col("url").alias("address"), F.when(F.col("page_id") % 9 == 4, "playlist").alias("method"), F.when(F.col("page_id") % 18 == 4, F.concat(F.lit("https://youtube.com/c/"), "page_id")).alias("channel"))
    return collect.inferred_sources(log)


def source_listing(spark: SparkSession, folder: str) -> DataFrame:
    return collect.source_listing(_by_source(spark, folder), 3)


def problems(spark: SparkSession, folder: str) -> DataFrame:
    live = corpus.liveness_state(_by_source(spark, folder).withColumn("natural_key", F.struct("source", "natural_key")))
    bad = live.where("state <> 'live'").select("natural_key.source", F.col("natural_key.natural_key").alias("key"), "state", "consecutive_failures")
    return collect.worst(bad, 20)


def address_times(spark: SparkSession, folder: str) -> DataFrame:
    return index.address_times(_observed(spark, folder))


def derived_addresses(spark: SparkSession, folder: str) -> DataFrame:
    log = _observed(spark, folder)
    return index.derived_addresses(log.select("blob_sha", "derived_sha", "at", "seq"), log)


def derived_from(spark: SparkSession, folder: str) -> DataFrame:
    return index.derived_from(_observed(spark, folder))


def index_order(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_order(_observed(spark, folder).select("blob_sha", "derived_sha", "at", "seq")).select("derived_sha", "at")


def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """How many blobs a store holds that was given all documents twice."""
    store = scratch(spark, "blobs")
    bodies = table(spark, folder, "documents").select(F.col("text").cast("binary").alias("bytes"))
    put_blobs(bodies, store)
    put_blobs(bodies, store)
    return spark.createDataFrame([(blob_count(spark, store),)], "blobs long")


def corpus_status(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages by source and kind; the bodies of every tenth document aren't stored."""
    documents = table(spark, folder, "documents").where("text is not null").select("source", F.lit("text").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("blob_sha"), F.octet_length("text").alias("n_bytes"), (F.col("doc_id") % 10 != 0).alias("kept"))
    kind = content.content_kind(F.lit(None).cast("string"), F.col("html").cast("binary"), F.col("url"))
    pages = table(spark, folder, "pages").where("html is not null").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("source"), kind.alias("kind"), F.sha2(F.col("html").cast("binary"), 256).alias("blob_sha"), F.octet_length("html").alias("n_bytes"), F.lit(True).alias("kept"))
    log = documents.union(pages)
    return corpus.corpus_status(log, log.where("kept").select("blob_sha", "n_bytes").dropDuplicates(["blob_sha"]))


def crumbs_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's crumbs: those of every second page from the ledger, the others scanned."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("blob_sha"))
    scanned = pages.where("page_id % 2 = 0 and url is not null and html is not null").withColumn("short", crumbs.short_sha(F.col("blob_sha"))).dropDuplicates(["url", "short"])
    store = scratch(spark, "ledger")
    crumbs.append_ledger(crumbs.crumb_rows(scanned, "short").withColumn("source", F.lit("pages")), store)
    return crumbs.with_ledger(pages, spark.read.parquet(store))


def crumbs_tally(spark: SparkSession, folder: str) -> DataFrame:
    return crumbs.tally(crumbs.crumb_rows(table(spark, folder, "pages")))


def decisions_by_host(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rulings on the host of their address: an error ignores it, a signup allows it again."""
    ruling = F.when(F.col("event_type") == "error", "ignore").when(F.col("event_type") == "signup", "allow").otherwise("promote")
    rulings = table(spark, folder, "events").select((F.col("user_id") % 40).cast("string").alias("host"), ruling.alias("ruling"), (F.col("event_id") % 1000).alias("at"), F.col("event_id").alias("seq"))
    return crumbs.decisions_current(rulings)


def run_journal(spark: SparkSession, folder: str) -> DataFrame:
    """The newest failed attempts, through the stored journal, with how many older ones are left."""
    store = scratch(spark, "journal")
    append_journal(_journal(spark, folder), store)
    read = spark.read.schema("run_id string, schedule string, outcome string, started_at timestamp").option("mode", "DROPMALFORMED").json(store)
    return collect.limited(runs.run_history(read, failed=True, most=1 << 30).select("run_id", "schedule", "outcome"), [F.desc("run_id")], 20)


def journal_health(spark: SparkSession, folder: str) -> DataFrame:
    return runs.schedule_health(_journal(spark, folder))


def journal_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in ("collect", "extract", "transcribe", "embed", "discover")]), (F.col("event_id") % 5 + 1).cast("int"))
    key = F.element_at(F.array(*[F.lit(k) for k in ("new", "gone", "blocked", "errored", "vanished", "new")]), (F.col("user_id") % 6 + 1).cast("int"))
    return runs.run_arithmetic(table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), stage.alias("stage"), key.alias("key"), F.col("event_id").alias("value")))


def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of pages by what is declared, by bytes where nothing is, and from the record alone."""
    declared = F.when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8").when(F.col("page_id") % 3 == 1, "application/octet-stream")
    pages = table(spark, folder, "pages")
    return pages.select("page_id", content.content_kind(declared, F.col("html").cast("binary"), F.col("url")).alias("kind"), content.recorded_kind(declared, F.col("url")).alias("recorded"))


def html_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one kind only."""
    return collect.of_kind(page_kinds(spark, folder), "html").select("page_id")


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", R.first_heading(F.col("text")).alias("title"))


def document_quality(spark: SparkSession, folder: str) -> DataFrame:
    share = R.link_share(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.round(share, 6).alias("link_share"), (share > 0.5).alias("is_menu"))


def without_data_uris(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.sha2(R.strip_data_uris(F.col("html")).cast("binary"), 256).alias("stripped"))


def page_directories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", strategies.directory_of(F.col("url")).alias("directory"))


def page_channels(spark: SparkSession, folder: str) -> DataFrame:
    """The listings of channels named after pages; every third address is a tab already."""
    url = F.concat(F.lit("https://www.youtube.com/@p"), "page_id", F.when(F.col("page_id") % 3 == 0, "/videos").otherwise("/"))
    return table(spark, folder, "pages").select("page_id", F.explode(strategies.channel_tabs(url)).alias("tab"))


def page_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to page requests: by status, and by where they were led."""
    code = 400 + F.col("page_id") % 30
    led = F.element_at(F.array(F.col("url"), F.concat("url", F.lit("/404")), F.concat("url", F.lit("/Error/x")), F.concat("url", F.lit("/x"))), (F.col("page_id") % 4 + 1).cast("int"))
    bare = F.regexp_replace("url", r"[?#].*$", "")
    pages = table(spark, folder, "pages").withColumn("url", bare)
    return pages.select("page_id", R.liveness_class(code).alias("state"), R.soft_404(F.col("url"), led).alias("soft"))


def run_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return runs.runs_named(_journal(spark, folder), "r00000012").select("run_id", "schedule", "ambiguous")


def read_target(spark: SparkSession, folder: str) -> DataFrame:
    bodies = table(spark, folder, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("blob_sha"), "text")
    return index.resolved_page(_observed(spark, folder), bodies, "doc/7", 5, 100)


def download_target(spark: SparkSession, folder: str) -> DataFrame:
    bodies = table(spark, folder, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("blob_sha"), F.col("text").cast("binary").alias("bytes"))
    return index.resolved_bytes(_observed(spark, folder), bodies, "doc/7", 5, 100)


def check_pages(spark: SparkSession, folder: str) -> DataFrame:
    return collect.checked_pages(table(spark, folder, "pages"))


def log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The log as it is read back from its folders by source and month."""
    store = scratch(spark, "log")
    rows = _by_source(spark, folder).withColumn("natural_key", F.col("natural_key").cast("string")).withColumn("detail", F.lit(None).cast("string"))
    append_log(rows, store)
    return read_log(spark, store).select("source", "natural_key", "seq", "state", "fingerprint", "month")


def log_of_source(spark: SparkSession, folder: str) -> DataFrame:
    """One source's records since a time, counted by month."""
    return _by_source(spark, folder).where("source = 's2' and at >= timestamp'2024-01-10'").groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("records"))


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in two appends, as the table says of itself which model and width they are of."""
    store = scratch(spark, "vectors")
    vectors = table(spark, folder, "embeddings").where("embedding is not null")
    dims = vectors.select(F.size("embedding")).first()[0]
    rows = vectors.where(F.size("embedding") == dims).select(F.col("vec_id").cast("string").alias("chunk_hash"), F.col("embedding").cast("array<float>").alias("vector"), "vec_id")
    for part in (0, 1):
        append_vectors(rows.where(F.col("vec_id") % 2 == part).drop("vec_id"), store, "table", dims)
    model, width = stored_model(spark, store)
    return spark.read.parquet(store).groupBy(F.lit(model).alias("model"), F.lit(width).alias("dims")).agg(F.count(F.lit(1)).alias("vectors"))


def daily_states(spark: SparkSession, folder: str) -> DataFrame:
    """Records by day and state."""
    return stream_log.daily_counts(_events(spark, folder)).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "state", "n")


def runs_since(spark: SparkSession, folder: str) -> DataFrame:
    """A schedule's attempts since a time, newest first."""
    return runs.run_history(_journal(spark, folder), schedule="s3", since="2024-01-15 00:00:00", most=1000).select("run_id", "outcome")


def page_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Names, videos and documents that addresses speak of."""
    host, path = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.concat(F.lit("/files/"), F.col("page_id"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".html", ".XLSX", "")]), (F.col("page_id") % 4 + 1).cast("int")))
    video = F.lpad(F.col("page_id").cast("string"), 11, "x")
    address = F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&list=y"))
    prefix = F.substring(F.sha2(F.col("html").cast("binary"), 256), F.lit(1), (F.col("page_id") % 12).cast("int"))
    return table(spark, folder, "pages").select(
        "page_id", content.suggested_id(host).alias("suggested"), content.is_document(path).alias("document"), content.video_id_of(address).alias("video"), content.is_video_id(content.video_id_of(address)).alias("valid"),
        content.watch_url_at(video, F.col("page_id") * 1500).alias("watch"), content.looks_like_hash(prefix).alias("hash"),
    )


def event_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Times as site maps write them, and scores as a yes-or-no model gives them."""
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, folder, "events").select("event_id", F.date_format(content.w3c_datetime(stamp), "yyyy-MM-dd HH:mm:ss").alias("lastmod"), F.round(content.probability_of_yes(F.col("value"), F.lit(3.0)), 9).alias("p_yes"))


def title_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    return text.html_title(table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        collect_report, merged_tallies, worklist_limited, ingested, size_gate, known_addresses, source_union, inferred_sources, source_listing, problems, address_times, derived_addresses, derived_from, index_order,
        stored_blobs, corpus_status, crumbs_ledger, crumbs_tally, decisions_by_host, run_journal, journal_health, journal_arithmetic, page_kinds, html_kinds, document_titles, document_quality, without_data_uris,
        page_directories, page_channels, page_answers, run_by_prefix, read_target, download_target, check_pages, log_round_trip, log_of_source,
        stored_vectors, daily_states, runs_since, page_scalars, event_scalars,
    )
} | {
    "html_title": title_of_pages,
    "page_links": lambda spark, folder: text.page_links(table(spark, folder, "pages")),
    "page_tags": lambda spark, folder: text.page_tags(table(spark, folder, "pages")),
}

_STATE = "CASE event_type WHEN 'view' THEN 'live' WHEN 'click' THEN 'live' WHEN 'signup' THEN 'gone' WHEN 'purchase' THEN 'blocked' ELSE 'error' END"
_LOG = f'log AS (SELECT user_id AS natural_key, event_id AS seq, ts AS "at", {_STATE} AS state, sha256(props) AS fingerprint, \'s\' || (user_id % 5) AS source FROM events)'
_DAYS = f'{_LOG}, cut AS (SELECT max("at"::DATE) AS last FROM log), before AS (SELECT log.* FROM log, cut WHERE "at"::DATE < last), brought AS (SELECT log.* FROM log, cut WHERE "at"::DATE = last)'
_LIVE = f'{_LOG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY "at", seq) AS n FROM log), live AS (SELECT natural_key, any_value(source) AS source, arg_max(state, n) AS state, max(n) - coalesce(max(CASE WHEN state = \'live\' THEN n END), 0) AS consecutive_failures FROM numbered GROUP BY 1)'
_DOCS = "log AS (SELECT source, 'doc/' || doc_id AS resource, sha256(text) AS blob_sha, sha256(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS derived_sha, doc_id AS seq, doc_id % 11 AS \"at\" FROM documents WHERE text IS NOT NULL), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_sha ORDER BY \"at\" DESC, seq DESC) AS r FROM log) WHERE r = 1)"
_FOLD = "regexp_replace(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g')"
_JOURNAL = "journal AS (SELECT printf('r%09d', event_id) AS run_id, 's' || (user_id % 7) AS schedule, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' WHEN 'purchase' THEN 'skipped' ELSE 'ok' END AS outcome FROM events)"
_CRUMBS = """href AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="(https?://[^"]*)"', 1)) AS h FROM pages), away AS (SELECT url, lower(regexp_extract(h, '^https?://([^/?#:]+)', 1)) AS host, CASE WHEN regexp_matches(h, '^https?://[^/?#]+/') THEN h ELSE regexp_replace(h, '^(https?://[^/?#]+)', '\\1/') END AS h FROM href WHERE regexp_extract(h, '^https?://([^/?#:]+)', 1) <> regexp_extract(url, '^https?://([^/?#:]+)', 1)), n AS (SELECT url, host, count(*) AS links, min(h) AS example FROM away GROUP BY 1, 2)"""
_STATUS = """body AS (SELECT source, 'text' AS kind, sha256(text) AS sha, strlen(text) AS b, doc_id % 10 <> 0 AS kept FROM documents WHERE text IS NOT NULL UNION ALL SELECT regexp_extract(url, '^https?://([^/?#]+)', 1), 'html', sha256(html), strlen(html), true FROM pages WHERE html IS NOT NULL),
sized AS (SELECT source, kind, sha, max(CASE WHEN kept THEN b END) OVER (PARTITION BY sha) AS b FROM body)"""
_LEVEL = "SELECT '{0}' AS level, {1} AS source, {2} AS kind, sum(n)::BIGINT AS total, coalesce(sum(b), 0)::BIGINT AS distinct_bytes, count_if(b IS NULL) AS missing FROM (SELECT {3} sha, count(*) AS n, any_value(b) AS b FROM sized GROUP BY ALL) GROUP BY ALL"
_TAG = "unnest(regexp_extract_all(html, '(?is)(<(?:{})(?:[\\s/][^>]*)?>)', 1))"

ORACLES: dict[str, str] = {
    "collect_report": f"WITH {_DAYS}, members AS (SELECT DISTINCT natural_key FROM (SELECT natural_key FROM brought WHERE seq % 3 <> 0 UNION ALL SELECT natural_key FROM before WHERE seq % 4 = 0)), asked AS (SELECT natural_key, contains(natural_key::VARCHAR, '{MATCHES}') AS fits, natural_key IN (SELECT natural_key FROM before WHERE state = 'live') AS had, natural_key IN (SELECT natural_key FROM brought) AS tried FROM members), latest AS (SELECT natural_key, arg_max(fingerprint, struct_pack(a := \"at\", s := seq)) AS was FROM before WHERE state = 'live' GROUP BY 1) SELECT (SELECT count(*) FROM asked) AS discovered, (SELECT count_if(fits AND had) FROM asked) AS already_had, (SELECT count_if(NOT fits) FROM asked) AS filtered_out, (SELECT count_if(fits AND NOT had AND NOT tried) FROM asked) AS remaining, count(*) AS attempted, count_if(state = 'live') AS stored, count_if(state = 'live' AND was <> fingerprint) AS changed, count_if(state = 'live' AND was IS NULL) AS first_seen, count_if(state <> 'live') AS failed, count_if(state = 'blocked') AS blocked, count_if(state = 'gone') AS gone, count_if(state = 'error') AS errored FROM brought LEFT JOIN latest USING (natural_key)",
    "merged_tallies": "SELECT event_type AS key, CASE WHEN event_type = 'error' THEN 'total' ELSE 'count' END AS kind, CASE WHEN event_type = 'error' THEN arg_max(user_id, event_id) ELSE sum(user_id) END::BIGINT AS value FROM events GROUP BY event_type",
    "worklist_limited": f'SELECT doc_id, n_chars, greatest((SELECT count(*) FROM documents) - {LIMIT}, 0) AS "left" FROM documents ORDER BY n_chars, doc_id LIMIT {LIMIT}',
    "ingested": f"WITH prior AS (SELECT url, arg_max(sha256({_FOLD.format('html')} || CASE WHEN page_id % 6 = 0 THEN '!' ELSE '' END), page_id) AS was FROM pages WHERE page_id % 2 = 0 GROUP BY 1) SELECT url, CASE WHEN page_id % 5 = 0 OR html IS NULL THEN 'failed' WHEN was IS NULL THEN 'first_seen' WHEN was <> sha256({_FOLD.format('html')}) THEN 'changed' ELSE 'unchanged' END AS outcome FROM pages LEFT JOIN prior USING (url) WHERE url IS NOT NULL",
    "size_gate": f"SELECT doc_id, strlen(text)::INT AS n_bytes, CASE WHEN strlen(text) > {MOST_CHARS} THEN 'error' ELSE 'live' END AS state, CASE WHEN strlen(text) > {MOST_CHARS} THEN strlen(text) || ' bytes, over the limit of {MOST_CHARS}' END AS detail FROM documents",
    "known_addresses": f"WITH {_LOG}, seen AS (SELECT natural_key, state = 'live' AS observed, state <> 'live' AS judged, false AS discovered FROM log WHERE seq % 2 = 0 UNION ALL SELECT natural_key, false, false, true FROM log WHERE seq % 5 = 0) SELECT natural_key, bool_or(observed) AS observed, bool_or(judged) AS judged, bool_or(discovered) AS discovered FROM seen GROUP BY 1",
    "source_union": f"WITH c(place, source) AS (VALUES {', '.join(f'({i}::BIGINT, {chr(39)}{s}{chr(39)})' for i, s in enumerate(CONFIGURED))}), s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT coalesce(c.source, s.source) AS source, place, c.source IS NOT NULL AS configured, s.source IS NOT NULL AS stored FROM c FULL JOIN s ON c.source = s.source",
    "inferred_sources": "SELECT 's' || (page_id % 9) AS source, CASE WHEN page_id % 9 = 4 THEN 'channel' ELSE 'site' END AS kind, CASE WHEN page_id % 9 = 4 THEN max_by('https://youtube.com/c/' || page_id, page_id) FILTER (page_id % 18 = 4) ELSE regexp_extract(arg_min(url, page_id), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) END AS target FROM pages GROUP BY page_id % 9",
    "source_listing": f"WITH {_LIVE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY consecutive_failures DESC, natural_key) AS p FROM live WHERE state <> 'live') SELECT source, sum(n)::BIGINT AS resources, (SELECT count(*) FROM log WHERE log.source = s.source AND state = 'live') AS observations, string_agg(state || '=' || n, ' ' ORDER BY state) AS states, (SELECT string_agg(natural_key::VARCHAR, ' ' ORDER BY p) FROM ranked r WHERE r.source = s.source AND p <= 3) AS problems, greatest((SELECT count(*) FROM ranked r WHERE r.source = s.source) - 3, 0) AS more_problems FROM (SELECT source, state, count(*) AS n FROM live GROUP BY 1, 2) s GROUP BY 1",
    "problems": f"WITH {_LIVE} SELECT source, natural_key AS key, state, consecutive_failures FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY consecutive_failures DESC, natural_key) AS p FROM live WHERE state <> 'live') WHERE p <= 20",
    "address_times": f'WITH {_DOCS} SELECT blob_sha, source, resource, min("at") AS first_seen FROM log GROUP BY 1, 2, 3',
    "derived_addresses": f'WITH {_DOCS} SELECT l.source, l.resource, blob_sha, n.derived_sha, min(l."at") AS first_seen FROM log l JOIN newest n USING (blob_sha) GROUP BY 1, 2, 3, 4',
    "derived_from": f"WITH {_DOCS} SELECT derived_sha, arg_max(blob_sha, seq) AS blob_sha FROM log GROUP BY 1",
    "index_order": f'WITH {_DOCS} SELECT derived_sha, "at" FROM newest ORDER BY "at", derived_sha',
    "stored_blobs": "SELECT count(DISTINCT sha256(text)) AS blobs FROM documents",
    "corpus_status": f"WITH {_STATUS} {_LEVEL.format('source+kind', 'source', 'kind', 'source, kind,')} UNION ALL {_LEVEL.format('source', 'source', 'NULL', 'source,')} UNION ALL {_LEVEL.format('kind', 'NULL', 'kind', 'kind,')} UNION ALL {_LEVEL.format('all', 'NULL', 'NULL', '')}",
    "crumbs_ledger": f"WITH {_CRUMBS} SELECT * FROM n UNION ALL SELECT DISTINCT url, NULL, 0::BIGINT, NULL FROM pages WHERE url NOT IN (SELECT url FROM n)",
    "crumbs_tally": f"WITH {_CRUMBS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS r FROM n) SELECT host, sum(links)::BIGINT AS links, count(*) AS pages, min(example) AS example, string_agg(url, ' ' ORDER BY url) FILTER (r <= 10) AS carriers, greatest(count(*) - 10, 0) AS dropped FROM ranked GROUP BY 1",
    "decisions_by_host": "SELECT host, ruling, a AS \"at\" FROM (SELECT (user_id % 40)::VARCHAR AS host, CASE event_type WHEN 'error' THEN 'ignore' WHEN 'signup' THEN 'allow' ELSE 'promote' END AS ruling, event_id % 1000 AS a, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id % 1000 DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ruling <> 'allow'",
    "run_journal": f"WITH {_JOURNAL}, bad AS (SELECT * FROM journal WHERE outcome IN ('failed', 'partial')) SELECT *, greatest((SELECT count(*) FROM bad) - 20, 0) AS \"left\" FROM bad ORDER BY run_id DESC LIMIT 20",
    "journal_health": f"WITH {_JOURNAL}, j AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY schedule ORDER BY run_id DESC) AS good FROM journal) SELECT schedule, arg_max(outcome, run_id) AS last_outcome, max(run_id) AS last_run, count_if(good = 0 AND outcome IN ('failed', 'partial')) AS consecutive_failures FROM j GROUP BY 1",
    "journal_arithmetic": "WITH stages AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, ['collect', 'extract', 'transcribe', 'embed', 'discover'][event_id % 5 + 1] AS stage, ['new', 'gone', 'blocked', 'errored', 'vanished', 'new'][user_id % 6 + 1] AS key, event_id AS value FROM events) SELECT run_id, "
    + ", ".join(
        f"coalesce(sum(value) FILTER (key = '{k}' AND stage IN ({s})), 0)::BIGINT AS {n}"
        for k, s, n in (("new", "'collect'", "documents"), ("new", "'extract', 'transcribe'", "derived"), ("new", "'embed'", "chunks"), ("vanished", "'discover'", "vanished"), ("gone", "'collect'", "gone"), ("blocked", "'collect'", "blocked"), ("errored", "'collect'", "errored"))
    )
    + " FROM stages GROUP BY 1",
    "page_kinds": "SELECT page_id, CASE WHEN page_id % 3 = 0 OR regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html)') THEN 'html' ELSE 'other' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '^[a-z]+://[^/]+.*/[^/]*\\.html?$') THEN 'html' ELSE 'other' END AS recorded FROM pages",
    "html_kinds": "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html)')",
    "document_titles": "SELECT doc_id, regexp_replace(list_filter(string_split(text, chr(10))[1:40], lambda x: regexp_matches(x, '^\\s*#'))[1], '^[\\s#]+|\\s+$', '', 'g') AS title FROM documents",
    "document_quality": r"WITH s AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(text, '\[[^\]]*\]\([^)]*\)'), lambda x: length(x))), 0) / length(text) ELSE 0 END::DOUBLE AS share FROM documents) SELECT doc_id, round(share, 6) AS link_share, share > 0.5 AS is_menu FROM s",
    "without_data_uris": """SELECT page_id, sha256(regexp_replace(html, 'data:[^\\s,)"''<>]*,[^\\s)"''<>]*', '', 'g')) AS stripped FROM pages""",
    "page_directories": "WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), p AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)', 1) AS o, u FROM b), q AS (SELECT page_id, o, substring(u, length(o) + 1) AS p FROM p) SELECT page_id, o || CASE WHEN regexp_matches(p, '[^/]\\.[A-Za-z0-9]{1,5}$') THEN regexp_replace(p, '[^/]*$', '') WHEN ends_with(p, '/') THEN p ELSE p || '/' END AS directory FROM q",
    "page_channels": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube.com/@p' || page_id || '/videos' ELSE 'https://www.youtube.com/@p' || page_id || '/' || t END AS tab FROM pages, (VALUES ('videos', 0), ('streams', 1), ('shorts', 2)) v(t, k) WHERE page_id % 3 <> 0 OR k = 0",
    "page_answers": "SELECT page_id, CASE WHEN 400 + page_id % 30 IN (404, 410) THEN 'gone' WHEN 400 + page_id % 30 IN (401, 403, 429) THEN 'blocked' ELSE 'error' END AS state, CASE page_id % 4 WHEN 1 THEN 'gone' WHEN 2 THEN 'error' END AS soft FROM pages",
    "log_round_trip": f"WITH {_LOG} SELECT source, natural_key::VARCHAR AS natural_key, seq, state, fingerprint, strftime(\"at\", '%Y-%m') AS month FROM log",
    "log_of_source": f"WITH {_LOG} SELECT strftime(\"at\", '%Y-%m') AS month, count(*) AS records FROM log WHERE source = 's2' AND \"at\" >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "stored_vectors": "SELECT 'table' AS model, len(embedding)::INT AS dims, count(*) AS vectors FROM embeddings WHERE len(embedding) = (SELECT len(embedding) FROM embeddings WHERE embedding IS NOT NULL LIMIT 1) GROUP BY 1, 2",
    "daily_states": f"WITH {_LOG} SELECT strftime(\"at\", '%Y-%m-%d') AS day, state, count(*) AS n FROM log GROUP BY 1, 2",
    "runs_since": f"WITH {_JOURNAL} SELECT run_id, outcome FROM journal JOIN events ON run_id = printf('r%09d', event_id) WHERE schedule = 's3' AND ts >= TIMESTAMP '2024-01-15' ORDER BY run_id DESC LIMIT 1000",
    "page_scalars": "WITH p AS (SELECT page_id, html, string_split(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '(?i)^www\\.', ''), '.')[1] AS label, lpad(page_id::VARCHAR, 11, 'x') AS v FROM pages) SELECT page_id, regexp_replace(lower(label), '[^a-z0-9]', '-', 'g') AS suggested, page_id % 4 IN (0, 2) AS document, v AS video, regexp_matches(v, '^[A-Za-z0-9_-]{11}$') AS valid, 'https://www.youtube.com/watch?v=' || v || '&t=' || (page_id * 1500 // 1000) || 's' AS watch, page_id % 12 >= 8 AS hash FROM p",
    "event_scalars": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS lastmod, round(1 / (1 + exp(3.0 - value)), 9) AS p_yes FROM events",
    "run_by_prefix": f"WITH {_JOURNAL}, hit AS (SELECT run_id, schedule FROM journal WHERE starts_with(run_id, 'r00000012')) SELECT *, (SELECT count(*) FROM hit) > 1 AS ambiguous FROM hit",
    "read_target": "SELECT 'doc/' || doc_id AS resource, substring(text, 6, 100) AS page, length(text) AS total_chars, length(text) > 105 AS truncated FROM documents WHERE doc_id = 7",
    "download_target": "SELECT 'doc/' || doc_id AS resource, to_base64(encode(text)[6:105]) AS page, strlen(text) AS total_bytes, strlen(text) > 105 AS truncated FROM documents WHERE doc_id = 7",
    "html_title": """WITH t AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta\\s[^>]*property="og:title"[^>]*content="([^"]*)"', 1), ''), regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title', 1)) AS t FROM pages) SELECT page_id, nullif(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&#38;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', chr(39)), '&apos;', chr(39)), '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g'), '') AS title FROM t""",
    "page_links": f"""SELECT page_id, href FROM (SELECT page_id, nullif(regexp_extract(tag, '(?is)[^a-z0-9-]href\\s*=\\s*("[^"]*"|''[^'']*'')', 1), '') AS q, q[2:-2] AS href FROM (SELECT page_id, {_TAG.format("a")} AS tag FROM pages)) WHERE q IS NOT NULL""",
    "page_tags": f"""SELECT page_id, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS tag, count(*) AS n, count_if(regexp_matches(t, '(?is)[^a-z0-9-]href\\s*=\\s*("[^"]*"|''[^'']*'')')) AS with_href FROM (SELECT page_id, {_TAG.format("a|area|link|meta|script|img|iframe|form")} AS t FROM pages) GROUP BY 1, 2""",
}
