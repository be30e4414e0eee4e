"""Bounded walks over what addresses list: one request budget and one address ceiling for each walk, spent over all partitions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.shipping import ship
from lodestone.sources.log import scratch

#: Tasks among which the rows of one walk are dealt where they meet what the walk has spent.
SALTS = 16
BUDGET, CEILING = 200, 50_000
#: Bytes of a site map that are read, unpacked, and how many are unpacked at once.
MOST_BYTES, AT_ONCE = 128 << 20, 1 << 20
_RULES = "array<struct<size:int,allow:boolean,pattern:string>>"


def _written(rows: DataFrame, path: str) -> DataFrame:
    """rows, written once and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running(rows: DataFrame, key: str, order: list[str], name: str, folder: str) -> DataFrame:
    """rows with ``name``: how many rows of the same key stand up to each, itself included, by ``order`` (unique in a key).

    A prefix sum in two steps: rows are sorted into ranges, each range numbers its own, and what the ranges before hold of
    the key is added. The ranges are kept in ``folder``, so both steps see the same ones; a key of any size is many tasks.
    """
    kept = _written(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), folder)
    sizes = kept.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(key, "_range", (F.sum("_size").over(Window.partitionBy(key).orderBy("_range")) - F.col("_size")).alias("_before"))
    own = kept.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    return own.join(before, [key, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range")


def _beside(rows: DataFrame, walks: DataFrame, by: str, how: str = "left") -> DataFrame:
    """rows with the one row of their walk; a walk with very many rows is several tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(walks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["walk", "_salt"], how).drop("_salt")


@dataclass
class Walked:
    """What walks found: ``summary`` (a row a walk), ``visited`` and ``kept`` (by level and in order)."""

    summary: DataFrame
    visited: DataFrame
    kept: DataFrame


def bounded_walk(links: DataFrame, seeds: DataFrame, budget: int = BUDGET, ceiling: int = CEILING, depth: int = 5, rules: DataFrame | None = None) -> Walked:
    """Walks from ``seeds`` (walk, url) over ``links`` (url, place, link, visit), level by level, at most ``depth`` levels below the seeds.

    A link with ``visit`` is a place to look at next, any other an address to keep unless the walk's ``rules`` (see
    ``robots_rules``) exclude it. A walk looks at each place once and at ``budget`` places at most, and keeps each address once and
    ``ceiling`` at most, in the order of levels, then addresses of places, then places of links; a place is not looked at when
    the ceiling is reached before it. A place that lists nothing costs a request like any other.

    summary: walk, visits, kept, disallowed (links that rules exclude), deep (places below the last level), out_of_budget and
    full (a walk that ends holding exactly its budget or ceiling can't know whether that was all), truncated.

    Each level is read from and written to tables in the shared folder, so plans don't grow with depth and a lost executor costs a
    level at most; ranks are prefix sums over ranges. Null walks, places and links are left out. Repeated seeds and links count once.
    """
    spark = links.sparkSession
    folder = scratch(spark, "walk")
    schemas: dict[str, object] = {}

    def put(rows: DataFrame, kind: str, level: int) -> DataFrame:
        schemas[kind] = rows.schema
        return _written(rows, f"{folder}/{kind}/level={level}")

    def upto(kind: str) -> DataFrame:
        """What all levels so far have put."""
        return spark.read.schema(StructType([*schemas[kind].fields, StructField("level", IntegerType())])).parquet(f"{folder}/{kind}")

    links = links.where("url is not null and link is not null").select(F.col("url").alias("from"), "place", "link", F.coalesce("visit", F.lit(False)).alias("visit"))
    seeds = seeds.where("walk is not null and url is not null").select("walk", "url").distinct()
    frontier = put(seeds, "frontier", 0)
    known = seeds.select("walk").distinct()
    known = known.withColumn("rules", F.array().cast(_RULES)) if rules is None else known.join(rules.select("walk", "rules"), "walk", "left").withColumn("rules", F.coalesce("rules", F.array().cast(_RULES)))
    known = put(known, "rules", 0)
    zeros = {c: F.lit(0).cast("long").alias(c) for c in ("visits", "kept", "disallowed", "deep")}
    state = known.select("walk", *zeros.values())
    for level in range(depth + 1):
        if frontier.isEmpty():
            break
        spent = known.join(state, "walk").select("walk", "rules", (budget - F.col("visits")).alias("left"), (ceiling - F.col("kept")).alias("room"))
        ranked = _beside(running(frontier, "walk", ["url"], "n", f"{folder}/ranked/{level}"), spent, "url", "inner").where("n <= left and room > 0")
        open_ = put(ranked, "open", level)
        excluded = ~F.coalesce(F.array_max(F.transform(F.filter("rules", lambda r: F.regexp_like("link", r["pattern"])), lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))["allow"], F.lit(True))
        found = links.join(open_, links["from"] == open_["url"]).select("walk", "n", "place", "link", "visit", "room", (~F.col("visit") & excluded).alias("excluded"))
        found = put(found, "found", level)
        keepers = found.where("not visit and not excluded").groupBy("walk", "link").agg(F.min(F.struct("n", "place")).alias("at"), F.max("room").alias("room")).select("walk", "link", "at.n", "at.place", "room")
        if level:
            keepers = keepers.join(upto("kept").select("walk", "link"), ["walk", "link"], "left_anti")
        fresh = running(keepers, "walk", ["n", "place", "link"], "r", f"{folder}/fresh/{level}")
        kept = put(fresh.where("r <= room").select("walk", "link", "n", "place", "r"), "kept", level)
        stops = fresh.where("r = room").select("walk", F.col("n").alias("stop"))
        seen = _beside(open_.select("walk", "url", "n"), stops, "url").where("stop is null or n <= stop").drop("stop")
        seen = put(seen, "visited", level)
        barred = _beside(found.where("excluded").groupBy("walk", "n").agg(F.count(F.lit(1)).alias("disallowed")), stops, "n").where("stop is null or n <= stop")
        onward = found.where("visit").select("walk", F.col("link").alias("url")).distinct().join(upto("visited").select("walk", "url"), ["walk", "url"], "left_anti")
        frontier = put(onward, "frontier", level + 1)
        parts = [
            seen.groupBy("walk").agg(F.count(F.lit(1)).alias("visits")), kept.groupBy("walk").agg(F.count(F.lit(1)).alias("kept")), barred.groupBy("walk").agg(F.sum("disallowed").alias("disallowed")),
        ]
        if level == depth:
            parts.append(frontier.groupBy("walk").agg(F.count(F.lit(1)).alias("deep")))
        parts = [part.select("walk", *[F.col(c).cast("long").alias(c) if c in part.columns else zero for c, zero in zeros.items()]) for part in parts]
        put(reduce(DataFrame.unionByName, parts), "spent", level)
        state = known.select("walk", *zeros.values()).unionByName(upto("spent").drop("level")).groupBy("walk").agg(*[F.sum(c).alias(c) for c in zeros])
    out, full = F.col("visits") >= budget, F.col("kept") >= ceiling
    summary = state.select("walk", "visits", "kept", "disallowed", F.when(out | full, 0).otherwise(F.col("deep")).cast("long").alias("deep"), out.alias("out_of_budget"), full.alias("full"), (out | full).alias("truncated"))
    if "visited" not in schemas:
        nothing = lambda fields: spark.createDataFrame([], fields)
        return Walked(summary, nothing("walk string, url string, n long, level int"), nothing("walk string, link string, n long, place long, r long, level int"))
    return Walked(summary, upto("visited"), upto("kept"))


def rule_pattern(rule: str) -> str:
    """The regular expression of a robots.txt path: ``*`` stands for anything, ``$`` at its end for the end."""
    body = ".*".join(re.escape(part) for part in rule.removesuffix("$").split("*"))
    return r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?" + body + ("$" if rule.endswith("$") else "")


def parsed_rules(robots: str | None, agent: str) -> list[tuple[int, bool, str]]:
    """(length, allowed, pattern) of the rules for an agent: those of the groups that name it, else of those for all."""
    groups: list[tuple[set[str], list[tuple[int, bool, str]]]] = []
    for line in (robots or "").splitlines():
        field, _, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not groups or groups[-1][1]:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif field in ("allow", "disallow") and groups and value:
            groups[-1][1].append((len(value), field == "allow", rule_pattern(value)))
    named = [rules for names, rules in groups if agent.lower() in names] or [rules for names, rules in groups if "*" in names]
    return [rule for rules in named for rule in rules]


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """walk, rules of each walk's robots.txt (walk, robots): the longest rule that fits an address decides, of equals the one that allows."""

    @F.pandas_udf(_RULES)
    def rules(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: [dict(zip(("size", "allow", "pattern"), rule, strict=True)) for rule in parsed_rules(body, agent)])

    ship(robots.sparkSession)
    return robots.select("walk", rules("robots").alias("rules"))


def _unpacked(body: bytes, most: int) -> Iterator[bytes]:
    """The body, unpacked where it is gzip, piece by piece; a piece past ``most`` bytes is not made."""
    if body[:2] != b"\x1f\x8b":
        for at in range(0, len(body), AT_ONCE):
            yield body[at : at + AT_ONCE]
        return
    unpack, held = zlib.decompressobj(31), body
    while held and not unpack.eof:
        yield unpack.decompress(held, AT_ONCE)
        held = unpack.unconsumed_tail


def map_entries(body: bytes | None, most: int = MOST_BYTES) -> tuple[list[tuple[bool, str, str | None]], str | None]:
    """(is an index, address, lastmod) of a site map, and why reading it ended early, if it did.

    The document is pulled piece by piece and no more than ``most`` bytes of it are ever unpacked; what was listed before a
    fault or the bound counts.
    """
    parser, out, size, index = ET.XMLPullParser(("start", "end")), [], 0, None
    root = None
    try:
        for piece in _unpacked((body or b"").lstrip(b"\xef\xbb\xbf \t\r\n"), most):
            size += len(piece)
            if size > most:
                return out, "larger than the bound"
            parser.feed(piece)
            for event, element in parser.read_events():
                tag = element.tag.rpartition("}")[2]
                if root is None:
                    root = element
                    if tag not in ("urlset", "sitemapindex"):
                        return [], "no site map"
                    index = tag == "sitemapindex"
                elif event == "end" and tag in ("url", "sitemap"):
                    fields = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in element}
                    if fields.get("loc"):
                        out.append((bool(index), fields["loc"], fields.get("lastmod")))
                    root.clear()
        parser.close()
    except (ET.ParseError, zlib.error) as fault:
        return out, "no site map" if root is None else f"broken: {type(fault).__name__}"
    return out, None


def listed(bodies: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """url, place, link, visit, lastmod, reason: what each site map (url, body) lists, in order; one row without a link for a map that lists nothing.

    ``reason`` says why a map was read in part. Each body is parsed once, in the task that has it; keep the result where it is read again.
    """

    def scan(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            for url, body in zip(batch["url"], batch["body"], strict=True):
                entries, reason = map_entries(None if body is None else bytes(body), most)
                rows = [(url, i, link, visit, modified, reason) for i, (visit, link, modified) in enumerate(entries)] or [(url, 0, None, None, None, reason)]
                yield pd.DataFrame(rows, columns=["url", "place", "link", "visit", "lastmod", "reason"]).astype(object)

    ship(bodies.sparkSession)
    return bodies.select("url", "body").mapInPandas(scan, "url string, place long, link string, visit boolean, lastmod string, reason string")


def discovered(bodies: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, agent: str = "*", **bounds) -> tuple[Walked, DataFrame]:
    """A bounded walk of site maps (url, body) from ``seeds`` (walk, url) under each walk's robots.txt, and the maps' entries (see ``listed``)."""
    folder = scratch(bodies.sparkSession, "maps")
    listed(bodies).write.parquet(folder)
    entries = bodies.sparkSession.read.parquet(folder)
    return bounded_walk(entries, seeds, rules=None if robots is None else robots_rules(robots, agent), **bounds), entries

