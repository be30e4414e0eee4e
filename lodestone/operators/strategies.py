"""How a seed's addresses are found: recognised strategies, directory listings, channel tabs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.content import is_document
from lodestone.operators.text import attribute, tags, unescaped

#: What the listings of common servers say; how deep a listing is walked.
MARKERS = ("<title>index of /", "<h1>index of /", "[to parent directory]")
MOST_DEPTH = 10
TABS = ("videos", "streams", "shorts")


@dataclass
class Strategy:
    """A way to enumerate addresses: whether it recognises a seed (its page and robots.txt), and how specific it is."""

    name: str
    specificity: int
    recognises: Callable[[str, str | None, str | None], bool]
    #: documents are addresses of files, pages of pages that may enclose files.
    addresses_are: str = "pages"


@dataclass
class Registry:
    """Strategies by name; the most specific one that recognises a seed wins, of equals the first by name."""

    strategies: dict[str, Strategy] = field(default_factory=dict)
    fallback: str = "sitemap"

    def register(self, strategy: Strategy) -> Strategy:
        if strategy.name in self.strategies:
            raise ValueError(f"two strategies named {strategy.name}")
        self.strategies[strategy.name] = strategy
        return strategy

    def recognised(self, url: str, page: str | None, robots: str | None) -> list[Strategy]:
        found = [s for s in self.strategies.values() if s.recognises(url, page, robots)]
        return sorted(found, key=lambda s: (-s.specificity, s.name)) or [self.strategies[self.fallback]]


def is_listing(url: str, page: str | None, robots: str | None = None) -> bool:
    """A directory listing: a server's marker and two anchors at least."""
    low = (page or "").lower()
    return any(m in low for m in MARKERS) and len(re.findall(r"<a\s", low)) >= 2


STRATEGIES = Registry()
STRATEGIES.register(Strategy("sitemap", 10, lambda url, page, robots: "sitemap:" in (robots or "").lower()))
STRATEGIES.register(Strategy("listing", 20, is_listing, "documents"))


def robots_sitemaps(robots: str | None, origin: str) -> list[str]:
    """The site maps that robots.txt names, relative ones at the origin; without one the usual address."""
    found = [urljoin(origin + "/", m.strip()) for m in re.findall(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)", robots or "")]
    return list(dict.fromkeys(found)) or [f"{origin}/sitemap.xml"]


def crawl_delay(robots: str | None, agent: str) -> float | None:
    """The crawl delay of an agent's group, or of the group of all; null if it names none."""
    named: dict[str, float] = {}
    agents: list[str] = []
    fresh = True
    for line in (robots or "").splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [value.lower()] if not fresh else [*agents, value.lower()]
            fresh = True
        elif key:
            fresh = False
            if key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                named |= {a: float(value) for a in agents if a not in named}
    return named.get(agent.lower(), named.get("*"))


# --- Directory listings ---


def directory_of(url: Column) -> Column:
    """The directory that an address lies in: itself if its last segment names no file (a stem and an extension of 1 to 5 letters or digits)."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    origin = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1)
    path = F.substring(bare, F.length(origin) + 1, F.length(bare))
    names_file = path.rlike(r"[^/]\.[A-Za-z0-9]{1,5}$")
    folder = F.when(names_file, F.regexp_replace(path, r"[^/]*$", "")).when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.concat(origin, folder)


def links_in(listings: DataFrame) -> DataFrame:
    """url, link: what each listing (url, html) links to under its own directory, on its host, itself left out.

    Relative links are joined to the directory: paths from the root, names, and full addresses; those that climb stay out.
    """
    root = directory_of(F.col("url"))
    host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    hrefs = F.filter(F.transform(tags(F.coalesce("html", F.lit("")), "a"), lambda t: unescaped(attribute(t, "href"))), lambda h: h.isNotNull() & (h != ""))
    rows = listings.select("url", root.alias("root"), host.alias("host"), F.explode(hrefs).alias("href"))
    bare = F.regexp_replace("href", r"#.*$", "")
    full = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("/"), F.concat("host", bare)).otherwise(F.concat("root", F.regexp_replace(bare, r"^(\./)+", "")))
    found = rows.where(~F.col("href").startswith("?") & ~F.col("href").startswith("#")).select("url", "root", full.alias("link"))
    inside = F.col("link").startswith(F.col("root")) & (F.col("link") != F.col("root")) & (F.col("link") != F.col("url")) & ~F.col("link").contains("..")
    return found.where(inside).select("url", "link").distinct()


def listing_walk(listings: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """The files that listings (url, html) name, from the directories that ``seeds`` (url) name, at most ``depth`` levels down.

    A link that ends in / is a directory; others are files. Each level is a join, and only a count reaches the driver.
    """
    links = links_in(listings)
    frontier = seeds.select("url").distinct()
    seen, files = frontier, links.where("false").select(F.col("link").alias("url"))
    for _ in range(depth + 1):
        found = links.join(frontier, "url", "left_semi")
        files = files.union(found.where(~F.col("link").endswith("/")).select(F.col("link").alias("url")))
        frontier = found.where(F.col("link").endswith("/")).select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return files.distinct().withColumn("is_document", is_document(F.col("url")))


# --- Channels, versions ---


def channel_tabs(url: Column) -> Column:
    """The listings of a channel's address: its three tabs, or the address itself if it names a tab or a playlist."""
    bare = F.regexp_replace(url, r"/+$", "")
    channel = bare.rlike(r"(?i)^https?://([a-z0-9-]+\.)*youtube\.com/(@[^/?#]+|(channel|c|user)/[^/?#]+)$")
    return F.when(channel, F.transform(F.array(*[F.lit(t) for t in TABS]), lambda t: F.concat(bare, F.lit("/"), t))).otherwise(F.array(url))


def staleness_days(version: str, today: date) -> int | None:
    """Age of a version that is a date (2026.01.31); null for any other."""
    m = re.match(r"(\d{4})\.(\d{1,2})\.(\d{1,2})", version)
    try:
        return (today - date(*map(int, m.groups()))).days if m else None
    except ValueError:
        return None


def is_newer(candidate: str, current: str) -> bool:
    """Whether a version of three numbers is later than another; a part that is no number counts as 0."""
    parts = lambda v: tuple(int(x) if x.isdigit() else 0 for x in [*v.lstrip("v").split("-")[0].split("."), "0", "0"][:3])
    return parts(candidate) > parts(current)


# --- Kinds of sources ---


@dataclass
class SourceKind:
    """How a kind of source names its addresses, and which sub-address marks one as collected."""

    name: str
    enumerate: Callable[[str], list[str]]
    marker: Callable[[str], str]


def _tabs(target: str) -> list[str]:
    bare = target.rstrip("/")
    return [f"{bare}/{t}" for t in TABS] if re.fullmatch(r"(?i)https?://([a-z0-9-]+\.)*youtube\.com/(@[^/?#]+|(channel|c|user)/[^/?#]+)", bare) else [target]


SOURCES = {
    "site": SourceKind("site", lambda target: [urldefrag(urljoin(target, "/sitemap.xml")).url], lambda address: address),
    "channel": SourceKind("channel", _tabs, lambda address: f"{address}#metadata"),
}


def source_kind(target: str) -> SourceKind:
    """The kind of source that a target names."""
    host = urlsplit(target).hostname or ""
    return SOURCES["channel" if re.search(r"(^|\.)(youtube\.com|youtu\.be)$", host) else "site"]
