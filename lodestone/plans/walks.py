"""Bounded walks over the pages' own links and over site maps made of the pages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import walk
from lodestone.sources.tables import table

#: What a walk of links may ask for and keep, and how deep it goes; the same of site maps.
LINKS, MAPS = {"budget": 12, "ceiling": 30, "depth": 4}, {"budget": 6, "ceiling": 150, "depth": 3}
_ROBOTS = "User-agent: *\nDisallow: /page/1\nAllow: /page/1*5$\n"
_OTHERS = "User-agent: another\nDisallow: /\n\nUser-agent: *\nDisallow: /*utm_source=\n"
#: Pages of a map, maps of an index.
PAGES, INDEXED = 100, 1000


def _host() -> Column:
    return F.regexp_extract("url", r"^https?://([^/?#]+)", 1)


def _with_summary(found: walk.Walked) -> DataFrame:
    kept = found.kept.select(F.col("walk").alias("of"), "link", F.col("level").cast("long").alias("level"), "r")
    return found.summary.join(kept, F.col("walk") == F.col("of"), "left").drop("of")


def link_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Walks from each host's first page. A link leads to the page that its name's hash picks: a place to look at if the name has an even length, else one to keep."""
    pages = table(spark, folder, "pages").where("page_id is not null")
    last = F.lit(pages.agg(F.max("page_id")).first()[0] or 0) + 1
    names = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="/([^"]*)"'), 1)
    rows = pages.select(F.concat(F.lit("/page/"), F.col("page_id").cast("string")).alias("url"), F.posexplode(names).alias("place", "name"))
    target = F.pmod(F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 7), 16, 10).cast("long"), last)
    links = rows.select("url", F.col("place").cast("long").alias("place"), F.concat(F.lit("/page/"), target.cast("string")).alias("link"), (F.length("name") % 2 == 0).alias("visit"))
    seeds = pages.groupBy(_host().alias("walk")).agg(F.concat(F.lit("/page/"), F.min("page_id").cast("string")).alias("url"))
    robots = seeds.select("walk", F.when(F.col("walk").endswith("com"), _ROBOTS).otherwise(_OTHERS).alias("robots"))
    return _with_summary(walk.bounded_walk(links, seeds, rules=walk.robots_rules(robots, "reader"), **LINKS))


def _map(kind: str, entries: Column) -> Column:
    return F.concat(F.lit(f'<?xml version="1.0"?>\n<{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit(f"</{kind}>"))


def site_maps(pages: DataFrame) -> DataFrame:
    """url, body: a map of each hundred pages of a host, every seventh cut off, an index of each thousand maps, and one of these."""
    rows = pages.where("page_id is not null and url is not null").select(_host().alias("host"), F.expr(f"page_id div {PAGES}").alias("k"), "page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("loc"))
    joined = lambda name, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda e: e[name]), "")
    rows = rows.withColumn("entry", F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc></url>")))
    maps = rows.groupBy("host", "k").agg(_map("urlset", joined("entry", "page_id")).alias("whole"))
    body = F.when(F.col("k") % 7 == 3, F.expr("substring(whole, 1, length(whole) * 2 div 3)")).otherwise(F.col("whole"))
    maps = maps.select("host", "k", F.expr(f"k div {INDEXED}").alias("j"), F.concat(F.lit("https://"), "host", F.lit("/map-"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), body.alias("body"))
    index = maps.withColumn("entry", F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))).groupBy("host", "j").agg(_map("sitemapindex", joined("entry", "k")).alias("body"))
    index = index.withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/index-"), F.col("j").cast("string"), F.lit(".xml")))
    top = index.withColumn("entry", F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))).groupBy("host").agg(_map("sitemapindex", joined("entry", "j")).alias("body"))
    top = top.withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")))
    return maps.select("url", "body").unionByName(index.select("url", "body")).unionByName(top.select("url", "body")).withColumn("body", F.col("body").cast("binary"))


def sitemap_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """What each host's site maps list, under its robots.txt, within a budget; ``in_part`` counts maps that could be read in part only."""
    pages = table(spark, folder, "pages")
    seeds = pages.where("page_id is not null and url is not null").select(_host().alias("walk")).distinct().withColumn("url", F.concat(F.lit("https://"), "walk", F.lit("/sitemap.xml")))
    found, entries = walk.discovered(site_maps(pages), seeds, seeds.select("walk", F.lit(_OTHERS).alias("robots")), "reader", **MAPS)
    cut = entries.where("reason is not null").select(F.col("url").alias("cut")).distinct()
    parts = found.visited.join(cut, F.col("url") == F.col("cut")).groupBy(F.col("walk").alias("of")).agg(F.count(F.lit(1)).alias("in_part"))
    rows = _with_summary(found)
    return rows.join(parts, F.col("walk") == F.col("of"), "left").drop("of").withColumn("in_part", F.coalesce("in_part", F.lit(0)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (link_walk, sitemap_discovery)}


def _walk_sql(link: str, seed: str, excluded: str, budget: int, ceiling: int, depth: int, more: str = "", column: str = "") -> str:
    """A walk level by level; ``link`` gives (origin, place, link, visit), ``seed`` (walk, url)."""
    out = [f"link AS MATERIALIZED ({link})", f"f0 AS ({seed})", "s0 AS (SELECT DISTINCT walk, 0 AS visits, 0 AS kept, 0 AS disallowed FROM f0)"]
    for i in range(depth + 1):
        before = " UNION ALL ".join(f"SELECT walk, link FROM k{j} WHERE r <= room" for j in range(i)) or "SELECT '' AS walk, '' AS link WHERE false"
        seen = " UNION ALL ".join(f"SELECT walk, url FROM v{j}" for j in range(i + 1))
        out += [
            f"o{i} AS MATERIALIZED (SELECT walk, url, n, {ceiling} - kept AS room FROM (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY url) AS n FROM f{i}) JOIN s{i} USING (walk) WHERE n <= {budget} - visits AND kept < {ceiling})",
            f"g{i} AS MATERIALIZED (SELECT walk, n, place, link, visit, room, NOT visit AND {excluded} AS excluded FROM o{i} JOIN link ON url = origin)",
            f"k{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY n, place, link) AS r FROM (SELECT walk, link, arg_min(n, (n, place)) AS n, arg_min(place, (n, place)) AS place, any_value(room) AS room FROM g{i} WHERE NOT visit AND NOT excluded GROUP BY 1, 2) x ANTI JOIN ({before}) y USING (walk, link))",
            f"t{i} AS (SELECT walk, n AS stop FROM k{i} WHERE r = room)",
            f"v{i} AS MATERIALIZED (SELECT walk, url, n FROM o{i} LEFT JOIN t{i} USING (walk) WHERE stop IS NULL OR n <= stop)",
            f"f{i + 1} AS MATERIALIZED (SELECT DISTINCT walk, link AS url FROM g{i} WHERE visit AND (walk, link) NOT IN ({seen}))",
            f"s{i + 1} AS MATERIALIZED (SELECT walk, visits + (SELECT count(*) FROM v{i} x WHERE x.walk = s.walk) AS visits, kept + (SELECT count(*) FROM k{i} x WHERE x.walk = s.walk AND r <= room) AS kept, disallowed + (SELECT count(*) FROM g{i} x LEFT JOIN t{i} USING (walk) WHERE x.walk = s.walk AND excluded AND (stop IS NULL OR n <= stop)) AS disallowed FROM s{i} s)",
        ]
    all_kept = " UNION ALL ".join(f"SELECT walk, link, {i}::BIGINT AS level, r FROM k{i} WHERE r <= room" for i in range(depth + 1))
    every = " UNION ALL ".join(f"SELECT walk, url FROM v{i}" for i in range(depth + 1))
    ended = f"(visits >= {budget} OR kept >= {ceiling})"
    return (
        f"WITH {more}{', '.join(out)}, kept AS ({all_kept}), visited AS ({every}) SELECT s.walk AS walk, visits::BIGINT AS visits, s.kept::BIGINT AS kept, disallowed::BIGINT AS disallowed, CASE WHEN {ended} THEN 0 ELSE (SELECT count(*) FROM f{depth + 1} x WHERE x.walk = s.walk) END AS deep, "
        f"visits >= {budget} AS out_of_budget, s.kept >= {ceiling} AS full, {ended} AS truncated, link, level, r{column} FROM s{depth + 1} s LEFT JOIN kept ON kept.walk = s.walk"
    )


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_MAPS = f"""part AS (SELECT {_HOST} AS host, page_id // {PAGES} AS k, string_agg('<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>', '' ORDER BY page_id) AS entries FROM pages GROUP BY 1, 2),
map AS (SELECT host, k, 'https://' || host || '/map-' || k || '.xml' AS url, CASE WHEN k % 7 = 3 THEN substring(whole, 1, length(whole) * 2 // 3) ELSE whole END AS body FROM (SELECT *, '<?xml version="1.0"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || entries || '</urlset>' AS whole FROM part)),
"""
ORACLES: dict[str, str] = {
    "link_walk": _walk_sql(
        "SELECT '/page/' || page_id AS origin, place, '/page/' || (('0x' || substring(md5(name), 1, 7))::BIGINT % (SELECT max(page_id) + 1 FROM pages)) AS link, length(name) % 2 = 0 AS visit FROM (SELECT page_id, generate_subscripts(names, 1) - 1 AS place, unnest(names) AS name FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS names FROM pages))",
        f"SELECT {_HOST} AS walk, '/page/' || min(page_id) AS url FROM pages GROUP BY 1",
        "CASE WHEN ends_with(walk, 'com') THEN starts_with(link, '/page/1') AND NOT regexp_matches(link, '^/page/1.*5$') ELSE contains(link, 'utm_source=') END",
        **LINKS,
    ),
    "sitemap_discovery": _walk_sql(
        f"""SELECT url AS origin, generate_subscripts(l, 1) - 1 AS place, replace(unnest(l), '&amp;', '&') AS link, false AS visit FROM (SELECT url, regexp_extract_all(body, '<url><loc>([^<]*)</loc></url>', 1) AS l FROM map)
        UNION ALL SELECT 'https://' || host || '/index-' || (k // {INDEXED}) || '.xml', k, url, true FROM map
        UNION ALL SELECT DISTINCT 'https://' || host || '/sitemap.xml', k // {INDEXED}, 'https://' || host || '/index-' || (k // {INDEXED}) || '.xml', true FROM map""",
        f"SELECT DISTINCT {_HOST} AS walk, 'https://' || {_HOST} || '/sitemap.xml' AS url FROM pages",
        "contains(link, 'utm_source=')",
        **MAPS,
        more=_MAPS,
        column=", (SELECT count(*) FROM visited v JOIN map m ON m.url = v.url WHERE v.walk = s.walk AND k % 7 = 3) AS in_part",
    ),
}
