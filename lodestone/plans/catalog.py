"""The engine's queries by name, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus, search, text
from lodestone.plans import gaps, literals, scalars, stored, tables, walks
from lodestone.sources.tables import table

def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(table(spark, folder, name))


def _log(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(corpus.observation_log(table(spark, folder, "events")))


def placement_addresses(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("blob_sha")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_addresses"))


def match_filter(pages: DataFrame) -> DataFrame:
    return pages.where(F.exists(F.array(F.lit("/en/"), F.lit("page=")), lambda m: F.contains(F.col("url"), m))).select("page_id", "url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chunk_documents": _on("documents", lambda d: search.chunks(d).select("doc_id", "ordinal", "chunk_hash")),
    "placement_addresses": _on("documents", placement_addresses),
    "boilerplate_lines": _on("documents", text.boilerplate_lines),
    "boilerplate_strip": _on("documents", text.boilerplate_strip),
    "blob_identity": _on("documents", text.blob_identity),
    "snippet": _on("documents", text.snippet),
    "read_page": _on("documents", text.read_page),
    "page_hosts": _on("pages", text.page_hosts),
    "match_filter": _on("pages", match_filter),
    "latest_observations": _log(corpus.latest_observations),
    "liveness_state": _log(corpus.liveness_state),
    "change_events": _log(corpus.change_events),
    "version_history": _log(corpus.version_history),
    "discovery_delta": _log(corpus.discovery_delta),
    "source_summary": _log(corpus.source_summary),
    "worklist_collect": _log(corpus.worklist_collect),
}

_CHUNKS = """
docs AS (SELECT doc_id, source, text, greatest(1, CAST(ceil(length(text) / 1200.0) AS INT)) AS w FROM documents WHERE length(text) > 0),
kept AS (SELECT *, CASE WHEN w > 1 AND length(text) - (w - 1) * 1200 < 80 THEN w - 1 ELSE w END AS k FROM docs),
cut AS (SELECT *, unnest(range(0, k)) AS ordinal FROM kept),
placed AS (SELECT doc_id, source, ordinal, substring(text, ordinal * 1200 + 1, 1200) || CASE WHEN ordinal = k - 1 AND k < w THEN chr(10) || chr(10) || substring(text, (ordinal + 1) * 1200 + 1, 1200) ELSE '' END AS chunk_text FROM cut),
chunk AS (SELECT *, sha256(chunk_text) AS chunk_hash FROM placed)"""
_LOG = """log AS (SELECT user_id AS natural_key, event_id AS seq, ts AS "at", CASE event_type WHEN 'view' THEN 'live' WHEN 'click' THEN 'live' WHEN 'signup' THEN 'gone' WHEN 'purchase' THEN 'blocked' ELSE 'error' END AS state, sha256(props) AS fingerprint FROM events),
obs AS (SELECT * FROM log WHERE state = 'live'),
numbered AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY natural_key ORDER BY "at", seq)),
live AS (SELECT natural_key, arg_max(state, n) AS state, max(CASE WHEN before IS NULL OR before <> state THEN seq END) AS since_seq, max(n) - coalesce(max(CASE WHEN state = 'live' THEN n END), 0) AS consecutive_failures FROM numbered GROUP BY 1)"""


def _fields(line: str, separator: str) -> str:
    outside = f"array_to_string(list_filter(string_split({line}, '\"'), lambda y, i: i % 2 = 1), '')"
    return f"(length({outside}) - length(replace({outside}, {separator}, '')) + 1)"


def _delimited(separator: str) -> str:
    return f"({_fields('l[1]', separator)} >= 3 AND len(r) >= 2 AND len(list_filter(r, lambda x: {_fields('x', separator)} <> {_fields('l[1]', separator)})) = 0)"


_TRIM = "regexp_replace({}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"
_LINES = f"""para AS (SELECT source, doc_id, pn, string_split(p, chr(10)) AS l, pn < np AS more FROM (SELECT source, doc_id, generate_subscripts(ps, 1) AS pn, unnest(ps) AS p, len(ps) AS np FROM (SELECT source, doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL))),
judged AS (SELECT source, doc_id, pn, list_concat(l, CASE WHEN more THEN [''] ELSE [] END) AS l, starts_with(ltrim(l[1]), '|') AND regexp_matches(trim(coalesce(l[2], '')), '^\\|[|\\-: ]*$') AND contains(coalesce(l[2], ''), '-') OR {" OR ".join(map(_delimited, ("','", "chr(9)", "';'")))} AS records
  FROM (SELECT *, list_filter(l[2:], lambda x: trim(translate(x, chr(9) || chr(13) || chr(12), '   ')) <> '')[1:5] AS r FROM para)),
numbered AS (SELECT source, doc_id, raw, records, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS last FROM (SELECT source, doc_id, pn, records, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM judged) WINDOW w AS (PARTITION BY doc_id ORDER BY pn, i)),
line AS (SELECT source, doc_id, {_TRIM.format("raw")} AS line FROM numbered WHERE NOT records),
common AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM line WHERE length(line) >= 12 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 5),
flagged AS (SELECT t.*, records OR c.line IS NULL AS kept FROM (SELECT source, doc_id, n, records, raw AS bare, raw || CASE WHEN n < last THEN chr(10) ELSE '' END AS raw, {_TRIM.format("raw")} AS line FROM numbered) t LEFT JOIN common c ON c.source IS NOT DISTINCT FROM t.source AND c.line = t.line)"""
_STRIPPED = _LINES + """,
stripped AS (SELECT doc_id, any_value(source) AS source, regexp_replace(string_agg(raw, '' ORDER BY n), '^\\s+|\\s+$', '', 'g') AS text FROM flagged WHERE kept GROUP BY doc_id),""" + _CHUNKS.replace("FROM documents", "FROM stripped")

ORACLES: dict[str, str] = {
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id, ordinal, chunk_hash FROM chunk",
    "placement_addresses": "SELECT sha256(text) AS blob_sha, min(doc_id) AS first_doc, count(*) AS n_addresses FROM documents GROUP BY 1",
    "boilerplate_lines": f"WITH {_LINES} SELECT * FROM common",
    "boilerplate_strip": f"WITH {_LINES} SELECT doc_id, coalesce(n, 0)::BIGINT AS lines_dropped, coalesce(c, 0)::BIGINT AS chars_dropped FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(bare)) AS c FROM flagged WHERE NOT kept GROUP BY 1) USING (doc_id)",
    "blob_identity": "SELECT doc_id, sha256(text) AS blob_sha, sha256(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g')) AS fingerprint FROM documents",
    "snippet": "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 400) || '…' END AS snippet FROM documents",
    "read_page": "SELECT doc_id, substring(text, 101, 500) AS page, length(text) AS total_chars, length(text) > 600 AS truncated FROM documents",
    "page_hosts": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "match_filter": "SELECT page_id, url FROM pages WHERE contains(url, '/en/') OR contains(url, 'page=')",
    "latest_observations": f'WITH {_LOG} SELECT natural_key, seq, "at", fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY "at" DESC, seq DESC) AS r FROM obs) WHERE r = 1',
    "liveness_state": f'WITH {_LOG} SELECT * FROM live',
    "change_events": f'WITH {_LOG} SELECT natural_key, seq, CASE WHEN from_fp IS NULL THEN \'appeared\' ELSE \'modified\' END AS kind, from_fp, fingerprint AS to_fp FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY natural_key ORDER BY "at", seq) AS from_fp FROM obs) WHERE from_fp IS NULL OR from_fp <> fingerprint',
    "version_history": f'WITH {_LOG} SELECT natural_key, row_number() OVER (PARTITION BY natural_key ORDER BY "at", seq) AS version, seq, fingerprint FROM obs',
    "discovery_delta": f'WITH {_LOG}, m AS (SELECT DISTINCT strftime("at", \'%Y-%m-%d\') AS day, natural_key FROM log), d AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM (SELECT DISTINCT day FROM m)) SELECT d.day AS day, (SELECT count(*) FROM m WHERE m.day = d.day) AS found, (SELECT count(*) FROM m WHERE m.day = d.day AND natural_key NOT IN (SELECT natural_key FROM m x WHERE x.day = d.previous)) AS new, (SELECT count(*) FROM m WHERE m.day = d.previous AND natural_key NOT IN (SELECT natural_key FROM m x WHERE x.day = d.day)) AS vanished FROM d',
    "source_summary": f'WITH {_LOG} SELECT state, count(*) AS resources, sum(n)::BIGINT AS records FROM live JOIN (SELECT natural_key, count(*) AS n FROM log GROUP BY 1) USING (natural_key) GROUP BY 1',
    "worklist_collect": f'WITH {_LOG} SELECT DISTINCT natural_key FROM log WHERE "at"::DATE = (SELECT max("at"::DATE) FROM log) AND natural_key NOT IN (SELECT natural_key FROM obs)',
}

QUERIES |= scalars.QUERIES | tables.QUERIES | literals.QUERIES | stored.QUERIES | gaps.QUERIES | walks.QUERIES
ORACLES |= scalars.ORACLES | tables.oracles(_CHUNKS, _LINES) | literals.ORACLES | stored.oracles(_STRIPPED, _CHUNKS) | gaps.ORACLES | walks.ORACLES
ORACLES |= {k: ORACLES["liveness_state"] for k in ("liveness_stream", "late_liveness")} | {k: ORACLES["change_events"] for k in ("change_stream", "late_changes")}
ORACLES["session_stream"] = """WITH t AS (SELECT user_id AS natural_key, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN us - before <= 10800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY natural_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(us) OVER (PARTITION BY natural_key ORDER BY us) AS before FROM t))
SELECT natural_key, min(us) AS start_us, max(us) + 10800000000 AS end_us, count(*) AS records FROM s GROUP BY natural_key, k HAVING max(us) + 10800000000 <= (SELECT max(us) // 1000 * 1000 - 172800000000 FROM t)"""
