"""Bounded walks against a walk in plain Python, and what site maps and robots rules are read as."""

import gzip
import random

import pytest

from lodestone.operators import walk


def plain_walk(links, seeds, budget, ceiling, depth, excluded):
    """{walk: (visits, kept addresses in order, disallowed, deep, truncated)}."""
    out = {}
    for name in {w for w, _ in seeds}:
        level, seen, kept, barred, visits = sorted({u for w, u in seeds if w == name}), set(), [], 0, 0
        for _ in range(depth + 1):
            found = set()
            for url in level:
                if visits >= budget or len(kept) >= ceiling:
                    break
                visits += 1
                seen.add(url)
                for _, link, onward in sorted(links.get(url, []), key=lambda x: (x[0], x[1])):
                    if onward:
                        found.add(link)
                    elif excluded(name, link):
                        barred += 1
                    elif link not in kept and len(kept) < ceiling:
                        kept.append(link)
            if visits >= budget or len(kept) >= ceiling:
                level = []
                break
            level = sorted(found - seen)
        out[name] = (visits, kept, barred, len(level), visits >= budget or len(kept) >= ceiling)
    return out


@pytest.mark.parametrize("budget, ceiling, depth", [(15, 1000, 3), (200, 25, 3), (10_000, 100_000, 2)])
def test_bounded_walk(spark, budget, ceiling, depth):
    rng = random.Random(budget + ceiling)
    links = {f"/{i}": [(k, f"/{rng.randrange(200)}", rng.random() < 0.5) for k in range(6)] for i in range(150)}
    links["/0"] += [(0, "/0", True), (9, "/1", True), (9, "/1", False)]  # itself, and one address in both ways
    seeds = [("a", "/0"), ("a", "/0"), ("b", "/7"), ("b", "/9"), ("c", "/nothing"), (None, "/1"), ("d", None)]
    rules = spark.createDataFrame([("a", "User-agent: *\nDisallow: /1\nAllow: /1*5$"), ("b", None)], "walk string, robots string")
    table = spark.createDataFrame([(u, k, link, onward, 1) for u, found in links.items() for k, link, onward in found] + [(None, 1, "/3", True, 1), ("/0", 1, None, True, 1)], "url string, place long, link string, visit boolean, walk int")
    got = walk.bounded_walk(table.drop("walk"), spark.createDataFrame(seeds, "walk string, url string"), budget, ceiling, depth, walk.robots_rules(rules, "reader"))
    kept = {}
    for r in sorted(got.kept.collect(), key=lambda r: (r.walk, r.level, r.r)):
        kept.setdefault(r.walk, []).append(r.link)
    want = plain_walk(links, [s for s in seeds if None not in s], budget, ceiling, depth, lambda name, link: name == "a" and link.startswith("/1") and not link.endswith("5"))
    assert {r.walk: (r.visits, kept.get(r.walk, []), r.disallowed, r.deep, r.truncated) for r in got.summary.collect()} == want


def test_plans_do_not_grow_with_depth(spark):
    links = spark.createDataFrame([(f"/{i}", 0, f"/{i + 1}", True) for i in range(30)], "url string, place long, link string, visit boolean")
    seeds = spark.createDataFrame([("a", "/0")], "walk string, url string")
    sizes = [len(walk.bounded_walk(links, seeds, depth=d).kept._jdf.queryExecution().optimizedPlan().toString()) for d in (1, 5)]
    assert abs(sizes[0] - sizes[1]) < 50
    nothing = walk.bounded_walk(links, seeds.where("false"))
    assert nothing.summary.count() == nothing.kept.count() == nothing.visited.count() == 0


def test_running(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 3), (None, 4)], "k string, x int")
    got = walk.running(rows.repartition(7), "k", ["x"], "n", str(tmp_path / "r")).where("k is not null").collect()
    assert all(r.n == (r.x + 1 if r.k == "a" else 1) for r in got) and len(got) == 501


def test_site_maps_are_read_within_a_bound():
    head, entry = b'<?xml version="1.0"?><urlset>', b"<url><loc>https://h/a&amp;b</loc><lastmod>2026-01-02</lastmod></url>"
    assert walk.map_entries(head + entry + b"</urlset>") == ([(False, "https://h/a&b", "2026-01-02")], None)
    assert walk.map_entries(b"\xef\xbb\xbf" + gzip.compress(head + entry * 3 + b"</urlset>"))[0][2][1] == "https://h/a&b"
    entries, reason = walk.map_entries(gzip.compress(head + entry + b" " * (64 << 20) + b"</urlset>"), most=4 << 20)
    assert entries == [(False, "https://h/a&b", "2026-01-02")] and reason == "larger than the bound"
    assert walk.map_entries(head + entry + b"<url><loc>") == ([(False, "https://h/a&b", "2026-01-02")], "broken: ParseError")
    assert walk.map_entries(gzip.compress(head + entry)[:-12])[0] in ([], [(False, "https://h/a&b", "2026-01-02")])
    assert walk.map_entries(b"<html></html>") == ([], "no site map") and walk.map_entries(b"plain")[1] == "no site map" and walk.map_entries(None)[0] == []


def test_site_maps_walk(spark):
    index = b"<sitemapindex><sitemap><loc>https://h/2.xml</loc></sitemap><sitemap><loc>https://h/1.xml</loc></sitemap></sitemapindex>"
    bodies = spark.createDataFrame([("https://h/1.xml", bytearray(index)), ("https://h/2.xml", bytearray(b"<urlset><url><loc>https://h/p</loc></url></urlset>")), ("https://h/3.xml", None)], "url string, body binary")
    got, entries = walk.discovered(bodies, spark.createDataFrame([("h", "https://h/1.xml")], "walk string, url string"))
    assert [(r.link, r.level) for r in got.kept.collect()] == [("https://h/p", 1)] and got.summary.first().visits == 2
    assert {r.reason for r in entries.collect()} == {None, "no site map"}


def test_rules():
    robots = "User-agent: a\nUser-agent: Reader\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /"
    assert [(n, ok) for n, ok, _ in walk.parsed_rules(robots, "reader")] == [(2, False), (4, True)]
    assert [(n, ok) for n, ok, _ in walk.parsed_rules(robots, "other")] == [(1, False)] and walk.parsed_rules(None, "other") == []
