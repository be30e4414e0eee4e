"""Queries over literal rows: crumbs, decisions, runs, content kinds and caption cues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content
from lodestone.operators import addresses, captions, crumbs, runs

PAGES = [
    ("https://a.gov/1", '<a href="https://b.org/x">1</a><a href="/y">2</a><a href="https://b.org/w?a=1&amp;b=2">3</a>'),
    ("https://a.gov/2", '<a class="k" href="http://C.net">1</a><a href="mailto:x@b.org">2</a><a href="//b.org/z">3</a>'),
    ("https://a.gov/3", '<a href="https://a.gov/1">1</a><a href="javascript:void(0)">2</a>'),
    ("https://a.gov/4", ""),
]
PROMOTED = [("c.net",)]
DECISIONS = [("b.org", "ignore", 1, 1), ("b.org", "allow", 2, 2), ("c.net", "ignore", 1, 3), ("d.org", "ignore", 3, 4), ("d.org", "allow", 2, 5), ("e.org", "ignore", 3, 6), ("e.org", "allow", 3, 7)]
JOURNAL = [
    ("r1", "nightly", "ok"), ("r2", "nightly", "failed"), ("r3", "nightly", "skipped"), ("r4", "nightly", "partial"), ("r5", "hourly", "failed"), ("r6", "hourly", "ok"), ("r7", "weekly", "interrupted"),
]
STAGES = [
    ("r1", "collect", "new", 5), ("r1", "collect", "gone", 2), ("r1", "extract", "new", 4), ("r1", "transcribe", "new", 1), ("r1", "embed", "new", 9), ("r1", "discover", "vanished", 3), ("r2", "collect", "blocked", 1),
    ("r2", "collect", "errored", 2), ("r2", "collect", "errored", 1), ("r2", "extract", "gone", 7),
]
BODIES = [
    ("text/html; charset=utf-8", "x", "https://a.gov/"), ("APPLICATION/PDF", "x", "https://a.gov/"), ("application/json", '{"wireMagic":1}', "https://a.gov/"), ("application/json", "{}", "https://a.gov/"),
    ("audio/flac", "x", "https://a.gov/"), ("application/octet-stream", "%PDF-1.7", "https://a.gov/x"), ("application/octet-stream", "{\\rtf1", "https://a.gov/x"), ("", "  <!DOCTYPE HTML>", "https://a.gov/x"),
    ("", "PK\x03\x04zip", "https://a.gov/x.docx"), ("", "x", "https://a.gov/a/Budget.XLSX?v=1"), ("", "x", "https://a.gov/x"), ("text/rtf", "x", "https://a.gov/x"), ("", "OggS", "https://a.gov/x"),
]
MESSAGES = ["ERROR: Sign in to confirm you are old", "Video unavailable", "HTTP Error 429: video unavailable", "timed out", "This is a Private video"]
TRACKS = ['{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":" one"},{"utf8":" two "}]},{"tStartMs":2000},{"tStartMs":3723000,"dDurationMs":-5,"segs":[{"utf8":"x"}]}]}']


def _frame(rows: list[tuple], schema: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(spark.createDataFrame(rows, schema))


def _tallied(pages: DataFrame) -> DataFrame:
    return crumbs.tally(crumbs.crumb_rows(pages))


def crumbs_standing(spark: SparkSession, folder: str) -> DataFrame:
    rulings = spark.createDataFrame(DECISIONS, "host string, ruling string, at long, seq long")
    own = spark.createDataFrame(PROMOTED, "host string")
    return crumbs.listed(crumbs.standing(_tallied(spark.createDataFrame(PAGES, "url string, html string")), own, rulings)).select("host", "links", "pages", "standing")


SITEMAPS = [
    ("https://a.gov/sitemap.xml", "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://a.gov/s1.xml</loc></sitemap><sitemap><loc>https://a.gov/sitemap.xml</loc></sitemap></sitemapindex>"),
    ("https://a.gov/s1.xml", "<urlset><url><loc>https://a.gov/1</loc><lastmod>2026-01-02</lastmod></url><url><loc> https://a.gov/2 </loc></url></urlset>"),
    ("https://a.gov/s2.xml", "<urlset><url><loc>https://a.gov/3</loc></url></urlset>"),
    ("https://a.gov/s3.xml", "<html><body>not found"),
]


def sitemap_walk(spark: SparkSession, folder: str) -> DataFrame:
    bodies = spark.createDataFrame(SITEMAPS, "url string, text string").select("url", F.col("text").cast("binary").alias("body"))
    return addresses.sitemap_walk(bodies, spark.createDataFrame([SITEMAPS[0][:1]], "url string"))


def cues(tracks: DataFrame) -> DataFrame:
    return tracks.select(F.explode(captions.json3_cues(F.col("body"))).alias("c")).select("c.start_ms", "c.end_ms", "c.text", captions.hms(F.col("c.start_ms")).alias("stamp"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "crumbs": _frame(PAGES, "url string, html string", _tallied),
    "crumbs_standing": crumbs_standing,
    "decisions_current": _frame(DECISIONS, "host string, ruling string, at long, seq long", crumbs.decisions_current),
    "run_history": _frame(JOURNAL, "run_id string, schedule string, outcome string", lambda j: runs.run_history(j, failed=True)),
    "run_arithmetic": _frame(STAGES, "run_id string, stage string, key string, value long", runs.run_arithmetic),
    "schedule_health": _frame(JOURNAL, "run_id string, schedule string, outcome string", runs.schedule_health),
    "content_kind": _frame(
        BODIES, "declared string, head string, url string", lambda b: b.select("declared", "head", "url", content.content_kind(F.col("declared"), F.col("head").cast("binary"), F.col("url")).alias("kind"))
    ),
    "refusal_class": _frame([(m,) for m in MESSAGES], "message string", lambda m: m.select("message", content.refusal_class(F.col("message")).alias("state"))),
    "sitemap_walk": sitemap_walk,
    "json3_cues": _frame([(t,) for t in TRACKS], "body string", cues),
}


def _sql(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''").replace("\x03\x04", "' || chr(3) || chr(4) || '") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in rows) + f") t({names})"


def _words(words) -> str:
    return " OR ".join(f"contains(lower(message), {_sql(w)})" for w in words)


_PAGES = f"""href AS (SELECT url, replace(unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)), '&amp;', '&') AS h FROM {_values(PAGES, "url, html")}),
whole AS (SELECT url, CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN h = 'http://C.net' THEN 'http://c.net/' ELSE h END AS h FROM href),
away AS (SELECT url, regexp_extract(h, '^https?://([^/?#]+)', 1) AS host, h FROM whole WHERE regexp_matches(h, '^https?://') AND NOT starts_with(h, 'https://a.gov/')),
tallied AS (SELECT host, count(*) AS links, count(DISTINCT url) AS pages, min(h) AS example, string_agg(DISTINCT url, ' ' ORDER BY url) AS carriers, 0::BIGINT AS dropped FROM away GROUP BY 1)"""
_RULED = f'ruled AS (SELECT host, ruling, "at"::BIGINT AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "at" DESC, seq DESC) AS r FROM {_values(DECISIONS, "host, ruling, " + chr(34) + "at" + chr(34) + ", seq")}) WHERE r = 1 AND ruling <> \'allow\')'
_JOURNAL = _values(JOURNAL, "run_id, schedule, outcome")
_SUM = "coalesce(sum(value) FILTER (key = '{0}' AND stage IN ({1})), 0)::BIGINT AS {2}"
_KINDS = " ".join(f"WHEN declared_type = '{t}' THEN '{k}'" for t, k in content.TYPES.items())
_EXTENSIONS = " ".join(f"WHEN extension IN ({', '.join(map(_sql, e))}) THEN '{k}'" for k, e in content.EXTENSIONS.items())

ORACLES: dict[str, str] = {
    "crumbs": f"WITH {_PAGES} SELECT * FROM tallied",
    "crumbs_standing": f"WITH {_PAGES}, {_RULED} SELECT host, links, pages, standing FROM (SELECT t.*, CASE WHEN host = 'c.net' THEN 'promoted' WHEN ruling = 'ignore' THEN 'ignored' ELSE 'open' END AS standing FROM tallied t LEFT JOIN ruled USING (host)) WHERE standing <> 'ignored'",
    "decisions_current": f"WITH {_RULED} SELECT * FROM ruled",
    "run_history": f"SELECT * FROM {_JOURNAL} WHERE outcome IN ('failed', 'partial')",
    "run_arithmetic": "SELECT run_id, "
    + ", ".join(
        _SUM.format(*x)
        for x in (("new", "'collect'", "documents"), ("new", "'extract', 'transcribe'", "derived"), ("new", "'embed'", "chunks"), ("vanished", "'discover'", "vanished"), ("gone", "'collect'", "gone"), ("blocked", "'collect'", "blocked"), ("errored", "'collect'", "errored"))
    )
    + f" FROM {_values(STAGES, 'run_id, stage, key, value')} GROUP BY 1",
    "schedule_health": f"WITH j AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY schedule ORDER BY run_id DESC) AS good FROM {_JOURNAL}) SELECT schedule, arg_max(outcome, run_id) AS last_outcome, max(run_id) AS last_run, count_if(good = 0 AND outcome IN ('failed', 'partial')) AS consecutive_failures FROM j GROUP BY 1",
    "content_kind": f"""SELECT declared, head, url, CASE WHEN declared_type = 'application/json' AND contains(head, 'wireMagic') THEN 'captions' WHEN starts_with(declared_type, 'audio/') THEN 'audio' {_KINDS} WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(head, '{{\\rtf') THEN 'document' WHEN starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'zip-container' WHEN starts_with(head, 'OggS') THEN 'audio' WHEN starts_with(lower(ltrim(head)), '<!doctype html') THEN 'html' {_EXTENSIONS} ELSE 'other' END AS kind FROM (SELECT *, lower(trim(split_part(declared, ';', 1))) AS declared_type, lower(regexp_extract(url, '/[^/?#]*\\.([a-zA-Z]+)([?#]|$)', 1)) AS extension FROM {_values(BODIES, "declared, head, url")})""",
    "refusal_class": f"SELECT message, CASE WHEN {_words(content.REFUSED)} THEN 'blocked' WHEN {_words(content.ABSENT)} THEN 'gone' ELSE 'error' END AS state FROM {_values([(m,) for m in MESSAGES], 'message')}",
    "sitemap_walk": "SELECT * FROM (VALUES ('https://a.gov/1', '2026-01-02'), ('https://a.gov/2', NULL)) t(url, lastmod)",
    "json3_cues": "SELECT * FROM (VALUES (1000::BIGINT, 1500::BIGINT, 'one two', '00:00:01'), (3723000::BIGINT, 3723000::BIGINT, 'x', '01:02:03')) t(start_ms, end_ms, text, stamp)",
}
