"""Queries over literal rows for functions that the tables hold no cases of, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import responses as R

CODES = [200, 301, 401, 403, 404, 410, 429, 500, 503]
REDIRECTS = [
    ("https://a.gov/x", "https://a.gov/x"), ("https://a.gov/x", "https://a.gov/404"), ("https://a.gov/x", "https://a.gov/Page-Not-Found/x"), ("https://a.gov/404", "https://a.gov/404?y=1"),
    ("https://a.gov/x", "https://a.gov/errors/z"), ("https://a.gov/x", "https://a.gov/home?aspxerrorpath=/x"), ("https://a.gov/x", "https://a.gov/terrors"), ("https://a.gov/x", "https://a.gov/y"),
]
TEXTS = ["", "plain", "![x](data:image/png;base64,AAAA) after", "data:nothing here, though", "[a](b)[c](d) e", "[a](b) and some longer text", "# One\ntext", "text\n  ## Two  \n# Three", "data:a,b data:c,d"]


def _rows(rows: list[tuple], schema: str, **columns) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: spark.createDataFrame(rows, schema).select("*", *[make().alias(name) for name, make in columns.items()])


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows) + ")"


_TEXTS = [(t,) for t in TEXTS]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "liveness_class": _rows([(c,) for c in CODES], "code int", state=lambda: R.liveness_class(F.col("code"))),
    "soft_404": _rows(REDIRECTS, "requested string, final string", state=lambda: R.soft_404(F.col("requested"), F.col("final"))),
    "strip_data_uris": _rows(_TEXTS, "input string", output=lambda: R.strip_data_uris(F.col("input"))),
    "read_quality": _rows(_TEXTS, "input string", link_share=lambda: F.round(R.link_share(F.col("input")), 6), is_menu=lambda: R.link_share(F.col("input")) > 0.5),
    "doc_title": _rows(_TEXTS, "input string", title=lambda: R.first_heading(F.col("input"))),
}

_SHARE = r"CASE WHEN length(input) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(input, '\[[^\]]*\]\([^)]*\)'), lambda x: length(x))), 0) / length(input) ELSE 0 END"
_PATH = "regexp_extract({}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
ORACLES: dict[str, str] = {
    "liveness_class": f"SELECT code::INT AS code, CASE WHEN code IN (404, 410) THEN 'gone' WHEN code IN (401, 403, 429) THEN 'blocked' ELSE 'error' END AS state FROM {_values([(c,) for c in CODES])} t(code)",
    "soft_404": f"SELECT requested, final, CASE WHEN {_PATH.format('requested')} = {_PATH.format('final')} THEN NULL WHEN regexp_matches(lower({_PATH.format('final')}), '(^|/)(notfound|not-found|pagenotfound|page-not-found|404)(/|$)') THEN 'gone' WHEN regexp_matches(lower({_PATH.format('final')}), '(^|/)(error|errors|internalserver|servererror|500)(/|$)') OR contains(lower(final), 'aspxerrorpath=') THEN 'error' END AS state FROM {_values(REDIRECTS)} t(requested, final)",
    "strip_data_uris": f"""SELECT input, regexp_replace(input, 'data:[^\\s,)"''<>]*,[^\\s)"''<>]*', '', 'g') AS output FROM {_values(_TEXTS)} t(input)""",
    "read_quality": f"SELECT input, round({_SHARE}, 6)::DOUBLE AS link_share, {_SHARE} > 0.5 AS is_menu FROM {_values(_TEXTS)} t(input)",
    "doc_title": f"SELECT input, regexp_replace(list_filter(string_split(input, chr(10))[1:40], lambda x: regexp_matches(x, '^\\s*#'))[1], '^[\\s#]+|\\s+$', '', 'g') AS title FROM {_values(_TEXTS)} t(input)",
}
