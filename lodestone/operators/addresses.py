"""Documents that pages embed, where a body is filed, and what sites list."""

from __future__ import annotations

import gzip
import hashlib
import re
import xml.etree.ElementTree as ET
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.content import ENCLOSABLE, EXTENSIONS
from lodestone.shipping import ship

MOST_PER_PAGE, MOST_NAME, MOST_DEPTH = 25, 120, 5
# The attribute of each tag that names what it embeds.
TARGETS = {"embed": "src", "object": "data", "iframe": "src", "a": "href"}
TAG = re.compile(r"<(embed|object|iframe|a)\b([^>]*)>", re.I)
SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script", re.I | re.S)
QUOTED = re.compile(r"""(\+?)\s*(["'])((?:(?!\2)[^\n\\]|\\.)*)\2\s*(\+?)""")
REFERENCES = (("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"))
DOCUMENT = re.compile(rf"(^|/)[^/]+\.({'|'.join(e for k in ENCLOSABLE for e in EXTENSIONS[k])})$", re.I)


def _candidates(html: str):
    for m in TAG.finditer(html):
        value = re.search(rf"""(?<![\w-]){TARGETS[m[1].lower()]}\s*=\s*(["'])(.*?)\1""", m[2], re.I | re.S)
        if value:
            yield value[2]
    for body in SCRIPT.findall(html):
        for before, _, text, after in QUOTED.findall(body):
            if not before and not after and DOCUMENT.search(re.split("[#?]", text)[0]):
                yield text  # a literal that the script joins to others is no address


def enclosed(html: str | None, page: str, most: int = MOST_PER_PAGE) -> tuple[list[str], int]:
    """Documents of the page's own host that it embeds, in order, and how many went past the limit."""
    found: dict[str, None] = {}
    host = urlsplit(page).hostname
    for candidate in _candidates(html or ""):
        for reference, plain in REFERENCES:
            candidate = candidate.replace(reference, plain)
        try:
            url = urldefrag(urljoin(page, candidate.strip())).url
            parts = urlsplit(url)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and parts.hostname == host and DOCUMENT.search(parts.path):
            found.setdefault(url)
    return list(found)[:most], max(0, len(found) - most)


def enclosures(pages: DataFrame, most: int = MOST_PER_PAGE) -> DataFrame:
    """url, enclosed (array), dropped of each page."""

    def scan(batches):
        for batch in batches:
            found = [enclosed(html, url, most) for html, url in zip(batch["html"], batch["url"])]
            yield pd.DataFrame({"url": batch["url"], "enclosed": [f[0] for f in found], "dropped": [f[1] for f in found]})

    ship(pages.sparkSession)
    return pages.where("url is not null").select("url", "html").mapInPandas(scan, "url string, enclosed array<string>, dropped long")


def _tag(text: str) -> str:
    return "~" + hashlib.sha256(text.encode()).hexdigest()[:8]


def safe_name(segment: str) -> str:
    """A file name: reserved and control characters replaced, dots at the ends gone, long ones cut and marked by a hash."""
    name = re.sub(r'[/\\:*?"<>|\x00-\x1f\x7f-\x9f]', "_", segment).strip(".") or "_"
    return name if len(name.encode()) <= MOST_NAME else name[: MOST_NAME - 9] + _tag(segment)


def relative_path(url: str, kind: str) -> str:
    """host/path.extension of a body; a query is kept as a hash, so addresses that differ by it don't collide."""
    parts = urlsplit(url)
    own = parts.path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    extension = {"markdown": "md", "captions": "json3", "other": "bin"}.get(kind) or EXTENSIONS[kind][0]
    if kind in ("document", "spreadsheet", "zip-container") and own in EXTENSIONS["document"] + EXTENSIONS["spreadsheet"]:
        extension = own
    if kind == "text":
        extension = "txt"
    if not parts.hostname:
        return f"{safe_name(url)}.{extension}"
    *folders, last = [s for s in parts.path.split("/") if s] or ["index"]
    stem = last[: -len(extension) - 1] if last.lower().endswith("." + extension) else last
    name = safe_name(stem) + (_tag(parts.query) if parts.query else "")
    return "/".join([safe_name(parts.hostname), *map(safe_name, folders), f"{name}.{extension}"])


def materialized_paths(pages: DataFrame) -> DataFrame:
    """url, relative_path of rows (url, kind)."""

    @F.pandas_udf("string")
    def path(url: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else relative_path(u, k or "other") for u, k in zip(url, kind)])

    ship(pages.sparkSession)
    return pages.select("url", path("url", "kind").alias("relative_path"))


def sitemap_entries(body: bytes | None) -> list[tuple[str, str, str | None]]:
    """(page or index, address, lastmod) of a site map, gzipped or not; none for a body that is no site map."""
    body = gzip.decompress(body) if body and body[:2] == b"\x1f\x8b" else body or b""
    try:
        root = ET.fromstring(body.removeprefix(b"\xef\xbb\xbf").strip())
    except ET.ParseError:
        return []
    kind = {"urlset": "page", "sitemapindex": "index"}.get(root.tag.rpartition("}")[2])
    out = []
    for entry in root if kind else []:
        fields = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in entry}
        if fields.get("loc"):
            out.append((kind, fields["loc"], fields.get("lastmod")))
    return out


def sitemap_walk(bodies: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """The pages that site maps (url, body) list, from the maps that `seeds` (url) names, through at most 5 levels of index.

    The tree of maps is walked one level at a time; each level is a join, and nothing but a count reaches the driver.
    """
    spark: SparkSession = ship(bodies.sparkSession)

    @F.pandas_udf("array<struct<kind:string,loc:string,lastmod:string>>")
    def entries(body: pd.Series) -> pd.Series:
        return body.map(lambda b: [dict(zip(("kind", "loc", "lastmod"), e)) for e in sitemap_entries(bytes(b) if b is not None else None)])

    listed = bodies.select("url", F.explode(entries("body")).alias("e")).select("url", "e.*")
    frontier, seen, pages = seeds.select("url").distinct(), seeds.select("url").distinct(), spark.createDataFrame([], "url string, lastmod string")
    for _ in range(depth + 1):
        found = listed.join(frontier, "url", "left_semi")
        pages = pages.union(found.where("kind = 'page'").select(F.col("loc").alias("url"), "lastmod"))
        frontier = found.where("kind = 'index'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.union(frontier)
    return pages.groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def robots_allows(robots: str | None, agent: str, url: str) -> bool:
    """Whether robots.txt lets an agent fetch an address: the longest rule that fits decides, a tie allows, no rules allow."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    for line in (robots or "").splitlines():
        field, _, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not groups or groups[-1][1]:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif field in ("allow", "disallow") and groups and value:
            groups[-1][1].append((field == "allow", value))
    mine = [rules for names, rules in groups if agent.lower() in names] or [rules for names, rules in groups if "*" in names]
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")

    def fits(rule: str) -> bool:
        pattern = ".*".join(map(re.escape, rule.removesuffix("$").split("*")))
        return re.match(pattern + ("$" if rule.endswith("$") else ""), path) is not None

    hits = [(len(rule), allow) for rules in mine for allow, rule in rules if fits(rule)]
    return max(hits)[1] if hits else True
