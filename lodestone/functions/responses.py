"""Columns that classify what a site answered and clean what was read from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes and the path segments of pages that stand in for a status.
GONE_CODES, BLOCKED_CODES = (404, 410), (401, 403, 429)
GONE_SEGMENTS = ("notfound", "not-found", "pagenotfound", "page-not-found", "404")
ERROR_SEGMENTS = ("error", "errors", "internalserver", "servererror", "500")
DATA_URI = r"""data:[^\s,)"'<>]*,[^\s)"'<>]*"""
LINK = r"\[[^\]]*\]\([^)]*\)"
HEADING_LINES = 40


def liveness_class(code: Column) -> Column:
    """gone, blocked or error for the status code of a refusal."""
    return F.when(code.isin(*GONE_CODES), "gone").when(code.isin(*BLOCKED_CODES), "blocked").otherwise("error")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def soft_404(requested: Column, final: Column) -> Column:
    """gone or error where a redirect led to a page that says so; null where the path stayed or says nothing."""
    segments = F.split(F.lower(_path(final)), "/")
    said = lambda words: F.arrays_overlap(segments, F.array(*[F.lit(w) for w in words]))
    error = said(ERROR_SEGMENTS) | F.contains(F.lower(final), F.lit("aspxerrorpath="))
    return F.when(_path(requested) == _path(final), None).when(said(GONE_SEGMENTS), "gone").when(error, "error")


def strip_data_uris(text: Column) -> Column:
    return F.regexp_replace(text, DATA_URI, "")


def link_share(markdown: Column) -> Column:
    """Characters of markdown links against all; 0 for an empty text."""
    links = F.aggregate(F.regexp_extract_all(markdown, F.lit(LINK), 0), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(markdown) > 0, links / F.length(markdown)).otherwise(0.0)


def first_heading(text: Column) -> Column:
    """The first of the leading 40 lines that begins with #, without its hashes; null if there is none."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, HEADING_LINES), lambda x: x.rlike(r"^\s*#"))
    return F.regexp_replace(F.get(lines, F.lit(0)), r"^[\s#]+|\s+$", "")
