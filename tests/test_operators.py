"""Operators that SQL doesn't express, and their edge cases, against brute force and worked examples."""

import datetime
import gzip
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import content
from lodestone.functions.cron import Cron, jitter_offset
from lodestone.functions.records import is_records
from lodestone.functions.stem import stemmed
from lodestone.operators import addresses, captions, chunker, collect, corpus, crumbs, embed, index, reader, runs, store, strategies, text
from lodestone.operators.vectors import VectorStore
from lodestone.plans import catalog, stored
from lodestone.sources import log as sources
from lodestone.streaming import log as streams

UTC = datetime.UTC
TEXTS = st.lists(st.sampled_from(["# A\n", "### B c\n", "#tag\n", "word " * 30, "\n\n", "a,b,c\n", '1,"x,y",3\n', "x" * 200, "\n", " ", "| a | b |\n", "|---|---|\n"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_chunks_cover_every_word(text):
    """Spans are in the text, in order, and leave nothing out but headings and white space."""
    found = chunker.chunked(text, target=300, overlap=40, runt=30)
    covered = [False] * len(text)
    for _, lo, hi, piece in found:
        assert 0 <= lo < hi <= len(text) and piece.strip()
        covered[lo:hi] = [True] * (hi - lo)
    for m in chunker.HEADING.finditer(text):
        covered[m.start() : m.end()] = [True] * (m.end() - m.start())
    assert not "".join(c for c, done in zip(text, covered) if not done).strip()


def test_chunk_headings_and_rows():
    assert [c[0] for c in chunker.chunked("a\n# A\nb\n### C\nc\n## D\nd\n#no\n")] == ["", "A", "A >  > C", "A > D"]
    rows = "h1,h2,h3\n" + "".join(f'{i},"a,b",c\n' for i in range(300))
    found = chunker.chunked(rows)
    assert all(c[3].startswith("h1,h2,h3\n") for c in found)
    assert "".join(c[3].removeprefix("h1,h2,h3\n") + "\n" for c in found) == rows.removeprefix("h1,h2,h3\n")
    assert chunker.chunked(None) == chunker.chunked("  \n") == []


#: Prose of three lines, each of three clauses: what the chunker would take for rows under a header.
CLAUSES = "\n".join(", ".join(f"{w} clause {i} " + "of a sentence " * 12 for w in ("one", "two", "three")) + "." for i in range(3))


def test_prose_with_even_commas_is_cut_as_prose(spark, tmp_path):
    want = [CLAUSES[:1200], CLAUSES[1200:]]
    assert len(CLAUSES) > 1280 and chunker.header_length(CLAUSES) and [c[3] for c in chunker.chunked(CLAUSES)] != want
    assert [c[3] for c in chunker.chunked(CLAUSES, records=False)] == want
    docs = spark.createDataFrame([(i, CLAUSES, f"src{i}") for i in range(2)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {hashlib.sha256(x.encode()).hexdigest() for x in want}
    for name in ("chunk_markdown", "chunk_documents", "chunk_dedup", "chunks_in_source"):
        assert {r.chunk_hash for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == hashes, name


@pytest.mark.parametrize(
    ("header", "row"),
    [("id,name,note", '{},"Doe, Jane of {}",A remark on it.'), ("id\tname\twhy?", "{}\tname of {}\tyes"), ("Id;Name;Amt.", "{};name of {};12.50"), ("| id | name |\n|---|:--|", "| {} | A name of {}. |"), ("| Id, no. |\n|---|", "| {}, {}, it. |")],
)
def test_query_cuts_records_at_rows(spark, tmp_path, header, row):
    """Packed by hand: whole rows under the header, beside prose in the same section."""
    rows = [row.format(i, f"a place that has the number {i * 7919}") for i in range(80)]
    pieces, held = [], []
    for r in rows:
        if held and len("\n".join([*held, r])) + 1 + len(header) > 1200:
            pieces.append("\n".join([header, *held]))
            held = []
        held.append(r)
    pieces.append("\n".join([header, *held]))
    assert len(pieces) > 2 and len(held) > 3
    texts = ["\n".join([header, *rows]), f"# Filed\n\n{CLAUSES}\n\n" + "\n".join([header, *rows])]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["chunk_markdown"](spark, str(tmp_path)).orderBy("doc_id", "ordinal").collect()
    under = [f"Filed\n\n{p}" for p in [CLAUSES[:1200], CLAUSES[1200:], *pieces]]
    assert [(r.doc_id, r.ordinal, r.chunk_hash) for r in found] == [(d, i, hashlib.sha256(p.encode()).hexdigest()) for d, ps in enumerate((pieces, under)) for i, p in enumerate(ps)]


def test_ends_of_sentences():
    assert all(map(chunker.ends_sentence, ["so it is.", "is it?!\r\n", '"It is."', "it is (so.) \n", "ends!! with.###", "."]))
    assert not any(map(chunker.ends_sentence, ["", " \n", "id,name,note", "12.50", "No. of it", '1,2,"x"', "..." * 200_000 + "x" + "#" * 200_000 + " " * 200_000]))


def test_chunk_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "x", None)], "doc_id long, text string, source string").withColumn("ordinal", F.lit(9))
    assert [(r.doc_id, r.chunk_text) for r in chunker.chunk_markdown(docs).collect()] == [(3, "x")]
    assert chunker.chunk_markdown(docs.where("false")).count() == 0


def test_stems():
    # Examples of the publication.
    for word, stem in {"ponies": "poni", "hopping": "hop", "falling": "fall", "relational": "relat", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky"}.items():
        assert stemmed(word) == stem
    assert stemmed("reviewing") == stemmed("review") and stemmed("applications") == stemmed("application")


def _indexed(spark, folder, texts, source="s"):
    made = store.IndexStore(spark, str(folder))
    made.build(store.derivations(spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "doc_id long, text string, source string")))
    return made


def test_stemmed_search(spark, tmp_path):
    texts = ["the budget-2026 review", "2026 budget reviewing", "applications and a review of budget 2026", "nothing", None, "  \n"]
    made = _indexed(spark, tmp_path / "index", texts)
    bodies = {r.chunk_hash: texts.index(r.chunk_text) for r in made.table("chunk").collect()}
    find = lambda q, **k: sorted(bodies[r.chunk_hash] for r in store.word_search(made, q, **k).collect())
    assert find("reviews") == [0, 1, 2] and find("review", stems=False) == [0, 2]
    assert find("budget-2026") == [0, 2]
    assert find('"application" review') == [2]
    assert find("") == find("absent") == [] and find("review", source="other") == []


def brute_bm25(bodies, phrases, stems):
    """Scores of passages (hash: text) that hold all phrases."""
    import math

    words = {h: [stemmed(w) if stems else w for w in re.findall(r"[^\W_]+", b.lower())] for h, b in bodies.items()}
    want = [[stemmed(w) if stems else w for w in p] for p in phrases]
    tf = {h: [sum(ws[i : i + len(p)] == p for i in range(len(ws))) for p in want] for h, ws in words.items()}
    df = [sum(t[k] > 0 for t in tf.values()) for k in range(len(want))]
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    part = lambda h, k: math.log((n - df[k] + 0.5) / (df[k] + 0.5) + 1) * tf[h][k] * 2.2 / (tf[h][k] + 1.2 * (0.25 + 0.75 * len(words[h]) / mean))
    return {h: round(sum(part(h, k) for k in range(len(want))), 6) for h in tf if all(tf[h])}


def test_stemmed_search_against_brute_force(spark):
    made = stored.index_of(spark, "/root/testdata/sf0.001")
    bodies = {r.chunk_hash: r.chunk_text for r in made.table("chunk").collect()}
    for query, phrases in (("the and-the", [["the"], ["and", "the"]]), ("thing er", [["thing"], ["er"]])):
        want = sorted(brute_bm25(bodies, phrases, True).items(), key=lambda x: (-x[1], x[0]))
        got = [(r.chunk_hash, r.score) for r in store.word_search(made, query, depth=10_000).orderBy("rank").collect()]
        assert [h for h, _ in got] == [h for h, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_index_builds_only_what_is_missing(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    furniture = "All rights reserved here"
    rows = [(i, f"# Title {i}\n{furniture}\nBody number {i % 3} of the corpus", "a") for i in range(6)] + [(9, furniture, "a"), (10, "h1,h2,h3\n1,2,3\n" + "4,5,6\n" * 3, "b")]
    docs = spark.createDataFrame(rows, schema)
    learnt = text.boilerplate_lines(docs)
    made = store.IndexStore(spark, str(tmp_path / "index"))
    assert made.counts().first().chunks == 0 and made.table("posting").count() == 0
    made.build(store.derivations(docs.where("doc_id < 4")), learnt)
    before = made.table("placement").count()
    made.build(store.derivations(docs.where("doc_id < 4")), learnt)
    assert made.table("placement").count() == before
    made.build(store.derivations(docs), learnt)
    whole = store.IndexStore(spark, str(tmp_path / "whole"))
    whole.build(store.derivations(docs), learnt)
    for name, columns in (("chunk", ["chunk_hash", "chunk_text", "chars", "dl"]), ("placement", ["resource", "ordinal", "chunk_hash", "char_start", "char_end", "title", "heading_path"]), ("posting", ["stem", "term", "chunk_hash", "dl"])):
        assert sorted(map(tuple, made.table(name).select(columns).collect())) == sorted(map(tuple, whole.table(name).select(columns).collect())), name
    for r in made.table("placement").join(made.table("chunk"), "chunk_hash").collect():
        source = dict((i, t) for i, t, _ in rows)[r.doc_id]
        body = source[r.char_start : r.char_end]
        assert furniture not in r.chunk_text and body.startswith(r.chunk_text.removeprefix(f"{r.heading_path}\n\n")[:4]) and (r.title is None or r.title.startswith("Title"))
    made.clear("a")
    assert {r.source for r in made.table("placement").collect()} == {"b"} and made.table("chunk").count() == made.table("placement").select("chunk_hash").distinct().count()
    made.clear()
    assert made.counts().first().placements == 0


def _read(spark, rows, version=None):
    """Derivations (id, text, time, blob) at an address each."""
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b", at, blob) for i, t, at, blob in rows], "doc_id long, text string, source string, at timestamp, blob_sha string")
    made = store.derivations(docs, F.col("at"))
    return made.join(docs.select("doc_id", "blob_sha"), "doc_id").select(*made.columns, "blob_sha")


def test_newer_extractions_supersede(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n, tzinfo=UTC)
    made = store.IndexStore(spark, str(tmp_path / "index"))
    found = lambda index, q: {r.chunk_hash for r in store.word_search(index, q).collect()}
    made.build(_read(spark, [(1, "the budget", day(1), "x"), (1, "the zoning", day(2), "x"), (2, "the budget", day(1), "y"), (3, "shared budget", None, "z"), (4, "shared budget", day(3), "w")]))
    assert len(found(made, "zoning")) == 1 and len(found(made, "budget")) == 2  # one of two extractions of a blob; others have the word too
    before = made.snapshot()
    made.build(_read(spark, [(2, "the harbour", day(2), "y"), (3, "better harbour", day(1), "z"), (1, "the budget", day(1), "x")]))
    assert len(found(made, "harbour")) == 2 and len(found(made, "zoning")) == 1
    assert {r.chunk_text for r in made.table("chunk").collect()} == {"the zoning", "the harbour", "better harbour", "shared budget"}  # another address still has the last
    assert len(found(before, "budget")) == 2 and not found(before, "harbour")  # a snapshot stays what it was
    made.build(_read(spark, [(2, "the budget", day(1), "y"), (1, "the budget", day(1), "x")]))
    assert "the budget" not in {r.chunk_text for r in made.table("chunk").collect()}  # a rebuild doesn't bring it back
    made.build(_read(spark, [(2, "the budget", day(9), "y")]))
    assert {r.chunk_text for r in made.table("chunk").collect()} == {"the zoning", "the budget", "better harbour", "shared budget"}
    live = {x: sorted(map(str, made.table(x).collect())) for x in ("chunk", "placement", "posting")}
    made.compact()
    assert {x: sorted(map(str, made.table(x).collect())) for x in live} == live and len(made.generations()) == 1


def test_an_extraction_without_a_passage_is_not_superseded_by_an_older_one(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n, tzinfo=UTC)
    made = store.IndexStore(spark, str(tmp_path / "index"))
    texts = lambda: {r.chunk_text for r in made.table("chunk").collect()}
    made.build(_read(spark, [(1, "", day(2), "x"), (2, " \n", day(2), "y"), (3, "kept", day(2), "z")]))
    made.build(_read(spark, [(1, "older", day(1), "x"), (2, "newer", day(3), "y"), (3, "older too", day(1), "z")]))
    assert texts() == {"newer", "kept"}
    made.compact()
    made.build(_read(spark, [(1, "older", day(1), "x"), (2, "older", day(2), "y")]))
    assert texts() == {"newer", "kept"} and made.table("bare").count() == 1
    made.clear("a")
    made.build(_read(spark, [(1, "older", day(1), "x")]))
    assert texts() == {"newer", "older"}


def test_postings_are_stored_by_batches(spark, tmp_path):
    """A stored row of postings is a word with all passages of a batch that hold it; read, it is a row each, and words count live passages."""
    texts = ["the budget and the review", "the", "review of reviews", "the budget and the review"]
    made = _indexed(spark, tmp_path / "index", texts)
    (g,) = made.generations()
    assert spark.read.parquet(f"{g['home']}/{g['generation']}/posting").count() < made.table("posting").count() == 8
    bodies = {r.chunk_hash: r.chunk_text for r in made.table("chunk").collect()}
    for r in made.table("posting").collect():
        words = bodies[r.chunk_hash].split()
        assert r.dl == len(words) and r.positions == [i for i, w in enumerate(words) if w == r.term] and r.stem == stemmed(r.term)
    assert {tuple(r) for r in made.words().collect()} == {("the", 2, 3), ("budget", 1, 1), ("and", 1, 1), ("review", 2, 2), ("of", 1, 1), ("reviews", 1, 1)}
    source = made.table("placement").first().source
    made.clear(source)
    assert made.words().count() == made.table("posting").count() == 0


def test_clearing_a_source_writes_names_alone(spark, tmp_path):
    rows = [(i, f"text number {i // 2} " * 40, datetime.datetime(2026, 1, 1, tzinfo=UTC), f"b{i}") for i in range(60)] + [(100, "only here", None, "c")]
    made = store.IndexStore(spark, str(tmp_path / "index"))
    made.build(_read(spark, rows))
    fork = made.fork(str(tmp_path / "fork"))
    fork.clear("b")
    texts = {r.chunk_text.split(" text")[0] for r in fork.table("chunk").collect()}
    assert "only here" not in texts and len(texts) == 30 and {r.source for r in fork.table("placement").collect()} == {"a"}
    assert not fork.table("posting").where("term = 'only'").count() and made.table("posting").where("term = 'only'").count() == 1
    fork.clear("a")
    assert fork.counts().first().chunks == 0 and made.counts().first().placements == 61
    fork.build(_read(spark, rows[:2]))
    assert fork.counts().first().placements == 2 and fork.counts().first().chunks == 1


def test_an_unfinished_build_is_not_read(spark, tmp_path):
    made = _indexed(spark, tmp_path / "index", ["one two", "three"])
    broken = spark.createDataFrame([(7, "x", "s")], "doc_id long, text string, source string").withColumn("text", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        made.build(store.derivations(broken))
    assert made.counts().first().chunks == 2


def test_vector_store(spark, tmp_path, monkeypatch):
    """Blocks hold each passage once, other widths are refused, and the nearest are those of a plain sort, however many are stale."""
    import numpy as np

    from lodestone.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(0)
    rows = [(f"h{i:03}", [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(300)] + [("zero", [0.0] * 5)]
    rows += [(f"t{i}", rows[0][1]) for i in range(40)]  # ties
    kept = VectorStore(spark, str(tmp_path / "vectors"))
    assert kept.hashes().count() == 0 and kept.top([1.0] * 5, 3, set) == []
    frame = lambda some: spark.createDataFrame([*some, (None, [1.0] * 5)], "chunk_hash string, vector array<double>").repartition(6)
    kept.append(frame(rows[:200]), 5)
    kept.append(frame(rows[150:] + rows[-3:]), 5)
    assert sorted(r.chunk_hash for r in kept.hashes().collect()) == sorted(h for h, _ in rows)
    q = [float(x) for x in rng.normal(size=5)]
    cosine = lambda v: round(float(np.dot(v, q) / np.sqrt(np.dot(v, v) * np.dot(q, q))), 6)
    for depth, stale in ((10, 0), (10, 60), (400, 5)):
        order = sorted(((h, cosine(v)) for h, v in rows if h != "zero"), key=lambda x: (-x[1], x[0]))
        gone = {h for h, _ in order[:stale]}
        got = kept.top(q, depth, lambda hashes, gone=gone: set(hashes) - gone)
        assert [h for h, _ in got] == [h for h, _ in order if h not in gone][:depth] and [s for _, s in got] == pytest.approx([s for h, s in order if h not in gone][:depth], abs=2e-6)
    assert kept.scores(q).count() == len(rows) - 1
    with pytest.raises(ValueError, match="of 5 numbers"):
        kept.append(frame(rows[:1]), 4)
    with pytest.raises(Exception, match="finite"):
        kept.append(frame([("new", [1.0] * 4)]), 5)
    with pytest.raises(Exception, match="finite"):
        kept.append(frame([("nan", [float("nan")] * 5)]), 5)


def test_hybrid_reranks_and_says_why_not(spark, tmp_path):
    made = _indexed(spark, tmp_path / "index", ["alpha beta", "alpha gamma", "alpha delta"])
    hashes = {r.chunk_text: r.chunk_hash for r in made.table("chunk").collect()}
    vectors, asked = VectorStore(spark, str(tmp_path / "vectors")), [1.0, 0.1]
    vectors.append(spark.createDataFrame([(hashes["alpha beta"], [1.0, 0.0]), (hashes["alpha gamma"], [0.0, 1.0]), ("gone", [1.0, 0.0])], "chunk_hash string, vector array<double>"), 2)
    plain = store.hybrid(made, "alpha", vectors, asked).orderBy("rank").collect()
    assert plain[0].chunk_hash == hashes["alpha beta"] and len(plain) == 3 and plain[0].method == "bm25+vector→rrf" and plain[0].no_rerank
    better = store.hybrid(made, "alpha", vectors, asked, reranker=lambda texts: [float("delta" in t) for t in texts]).orderBy("rank").collect()
    assert better[0].chunk_hash == hashes["alpha delta"] and better[0].method.endswith("→rerank") and better[0].no_rerank is None
    short = store.hybrid(made, "alpha", vectors, asked, reranker=lambda texts: [1.0]).collect()
    assert short[0].no_rerank == "1 scores for 3 passages"
    assert store.hybrid(made, "alpha", vectors, asked, source="none").count() == 0


def test_boilerplate_spares_records(spark):
    row = "alpha one, beta two, gamma three"
    table = "name of it, value of it, note on it\n" + "\n".join([row] * 3)
    docs = spark.createDataFrame([(i, f"Shared line of prose\n\n{table}\n\n{row}\nown {i}", "s") for i in range(6)] + [(7, None, "s"), (8, "", None)], "doc_id long, text string, source string")
    assert {(r.line, r.n_docs) for r in text.boilerplate_lines(docs).collect()} == {("Shared line of prose", 6), (row, 6)}
    assert text.boilerplate_lines(docs, sample_docs=4).count() == 0
    got = {r.doc_id: r.text for r in text.boilerplate_text(docs).collect()}
    assert got[0] == f"\n{table}\n\nown 0" and got[7] is None and got[8] == ""


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_records_in_columns_and_in_python_agree(text_):
    RECORDS.append(text_)


RECORDS: list[str] = []


def test_records_agree(spark):
    paragraphs = sorted({p for t in RECORDS for p in t.split("\n\n")} | {"a;b;c\n1;2;3\n4;5;6", "a,b,c\n1,2,3", "| a |\n|---|", '"x,y",b,c\n1,2,3\n"p,q",2,3', "a,b\n1,2\n3,4"})
    found = spark.createDataFrame([(p,) for p in paragraphs], "p string").select("p", is_records(F.col("p")).alias("r")).collect()
    assert all(bool(r.r) == (chunker.header_length(r.p) > 0) for r in found) and any(r.r for r in found)


def test_strategies_and_listings(spark):
    page = "<html><title>Index of /docs/</title><a href='../'>up</a><a href='a.pdf'>a</a><A HREF=\"sub/\">s</A><a href='/docs/b.txt#x'>b</a><a href='https://o.org/docs/c.pdf'>c</a><a href='?C=N'>sort</a></html>"
    sub = "<h1>Index of /docs/sub/</h1><a href='/docs/'>up</a><a href='d.docx'>d</a><a href='./e'>e</a>"
    assert [s.name for s in strategies.STRATEGIES.recognised("https://h.org/docs/", page, "Sitemap: /s.xml")] == ["listing", "sitemap"]
    assert [s.name for s in strategies.STRATEGIES.recognised("https://h.org/", "<p>", None)] == ["sitemap"]
    with pytest.raises(ValueError):
        strategies.STRATEGIES.register(strategies.Strategy("listing", 1, lambda *_: True))
    pages = spark.createDataFrame([("https://h.org/docs/", page), ("https://h.org/docs/sub/", sub), ("https://h.org/x", None)], "url string, html string")
    seeds = spark.createDataFrame([("https://h.org/docs/",)], "url string")
    assert {(r.url, r.is_document) for r in strategies.listing_walk(pages, seeds).collect()} == {("https://h.org/docs/a.pdf", True), ("https://h.org/docs/b.txt", False), ("https://h.org/docs/sub/d.docx", True), ("https://h.org/docs/sub/e", False)}
    assert {r.url for r in strategies.listing_walk(pages, seeds, depth=0).collect()} == {"https://h.org/docs/a.pdf", "https://h.org/docs/b.txt"}
    assert strategies.robots_sitemaps("User-agent: *\nSitemap: /a.xml\nsitemap: https://x.org/b.xml", "https://h.org") == ["https://h.org/a.xml", "https://x.org/b.xml"]
    assert strategies.robots_sitemaps(None, "https://h.org") == ["https://h.org/sitemap.xml"]
    assert strategies.crawl_delay("User-agent: *\nCrawl-delay: 5\nUser-agent: me\nDisallow: /x\nCrawl-delay: 2.5", "Me") == 2.5 and strategies.crawl_delay("", "me") is None
    assert strategies.staleness_days("2026.01.01", datetime.date(2026, 1, 31)) == 30 and strategies.staleness_days("nightly", datetime.date(2026, 1, 1)) is None
    assert strategies.is_newer("1.10.0", "1.9.9") and not strategies.is_newer("1.0", "1.0.0")
    assert strategies.source_kind("https://www.youtube.com/@x").enumerate("https://www.youtube.com/@x/")[1].endswith("/@x/streams") and strategies.source_kind("https://h.org").name == "site"


def test_ledger_and_decisions(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    pages = spark.createDataFrame([("https://h.org/1", '<a href="https://o.org/x">x</a>', "a" * 64), ("https://h.org/2", "<p>none", "b" * 64)], "url string, html string, blob_sha string")
    want = sorted(map(tuple, crumbs.crumb_rows(pages).select("url", "host", "links", "example").collect()), key=repr)
    recorded = crumbs.crumb_rows(pages.where("blob_sha like 'a%'")).withColumn("short", F.lit("a" * 12)).withColumn("source", F.lit("s"))
    crumbs.append_ledger(recorded, folder)
    crumbs.append_ledger(recorded.withColumn("source", F.lit("t")).limit(0), folder)
    unread = pages.withColumn("html", F.when(F.col("blob_sha").startswith("a"), F.lit(None)).otherwise(F.col("html")))
    assert sorted(map(tuple, crumbs.with_ledger(unread, spark.read.parquet(folder)).collect()), key=repr) == want
    crumbs.rewrite_ledger(spark.createDataFrame([("https://h.org/1", None, 0, None, "c" * 12, "s")], "url string, host string, links long, example string, short string, source string"), folder)
    assert [r.short for r in spark.read.parquet(folder).collect()] == ["c" * 12]
    rulings = spark.createDataFrame([("h", "ignore", 1, 1), ("h", "allow", 2, 2), ("i", "ignore", 1, 3)], "host string, ruling string, at long, seq long")
    collect.append_decisions(rulings, str(tmp_path / "d"))
    assert [r.host for r in crumbs.decisions_current(collect.read_decisions(spark, str(tmp_path / "d"))).collect()] == ["i"]


def test_ledger_counts_pages_of_one_address_together(spark, tmp_path):
    """Pages at one address, of which some are recorded, and a body that is at two addresses."""
    link = lambda *hosts: "".join(f'<a href="https://{h}.org/x">x</a>' for h in hosts)
    rows = [(2, "https://h.org/1", link("o", "p")), (3, "https://h.org/1", link("o", "o")), (4, "https://h.org/1", link("o", "p")), (5, "https://h.org/2", link("o", "p")), (6, "https://h.org/3", "none"), (7, "https://h.org/3", "no"), (8, "https://h.org/4", "none"), (9, "https://h.org/4", link("q"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["crumbs_ledger"](spark, str(tmp_path)).collect()
    want = {("https://h.org/1", "o.org", 4), ("https://h.org/1", "p.org", 2), ("https://h.org/2", "o.org", 1), ("https://h.org/2", "p.org", 1), ("https://h.org/3", None, 0), ("https://h.org/4", "q.org", 1)}
    assert {(r.url, r.host, r.links) for r in got} == want and len(got) == len(want)


def test_enabled_sources():
    configured = [{"id": "a"}, {"id": "b", "enabled": False}, {"id": "c", "enabled": True}]
    assert collect.enabled_sources(configured) == ["a", "c"] and collect.enabled_sources(configured, ["b"]) == ["b"]
    with pytest.raises(ValueError):
        collect.enabled_sources(configured, ["z"])


def test_versions_of_one_hot_address(spark, monkeypatch):
    monkeypatch.setattr(corpus, "ORDERED", 50)
    at = datetime.datetime(2026, 1, 1)
    rows = [(0 if n % 3 == 0 else n, n, at + datetime.timedelta(hours=n // 4), "live", f"f{n // 7}") for n in range(900)]
    log = _log(spark, rows)
    hot = sorted((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[1]))
    got = {r.seq: r.version for r in corpus.version_history(log).where("natural_key = 0").collect()}
    assert got == {r[1]: i for i, r in enumerate(hot, 1)}
    changed = {r.seq: r.from_fp for r in corpus.change_events(log).where("natural_key = 0").collect()}
    assert changed == {r[1]: b[4] if b else None for b, r in zip([None, *hot], hot) if b is None or b[4] != r[4]}


def test_hot_passages_and_sources(spark):
    placed = spark.createDataFrame([("h", "s", i, 0) for i in range(300)] + [("k", "t", 5, 1), ("h", "t", 1, 3)], "chunk_hash string, source string, doc_id long, ordinal long")
    got = {r.chunk_hash: r for r in store.first_placements(placed, ["h", "k"]).collect()}
    assert [p.doc_id for p in got["h"].few] == list(range(9)) and got["h"].also_at_total == 300 and len(got["k"].few) == 1
    assert {(r.source, r.chunks_written, r.deduplicated) for r in index.index_report(placed).collect()} == {("s", 1, 299), ("t", 1, 1)}


def _log(spark, rows):
    return spark.createDataFrame(rows, "natural_key long, seq long, at timestamp, state string, fingerprint string")


def test_streams_resume_and_match_the_batch(spark, tmp_path):
    at = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=n)
    rows = [(n % 3, n, at(n), "live" if n % 4 else "gone", f"f{n // 5}") for n in range(30)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:11], rows[11:12], rows[12:]):
        _log(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(_log(spark, []).schema).parquet(folder)
        streams.resumed(streams.liveness_stream(stream), f"{out}/live", f"{out}/c1")
        streams.resumed(streams.change_stream(stream), f"{out}/change", f"{out}/c2")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    order = ["natural_key", "state", "since_seq", "consecutive_failures"]
    assert key(streams.latest(spark.read.parquet(f"{out}/live")).select(order)) == key(corpus.liveness_state(_log(spark, rows)).select(order))
    assert key(spark.read.parquet(f"{out}/change").drop("batch")) == key(corpus.change_events(_log(spark, rows)))


def test_a_table_of_part_files_streams_like_one_file(spark, tmp_path):
    rows = [(n % 3, n, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=n), "live" if n % 4 else "gone", f"f{n // 5}") for n in range(20)]
    _log(spark, rows).repartitionByRange(4, "seq").write.parquet(str(tmp_path / "many" / "log.parquet"))
    (tmp_path / "one").mkdir()
    _log(spark, rows).toPandas().to_parquet(tmp_path / "one" / "log.parquet", coerce_timestamps="us")
    for kind in ("many", "one"):
        streams.resumed(streams.table_stream(spark, str(tmp_path / kind), "log", files=4), str(tmp_path / kind / "out"), str(tmp_path / kind / "cp"))
        assert spark.read.parquet(str(tmp_path / kind / "out")).count() == 20


def test_log_round_trip(spark, tmp_path):
    rows = [("s1", "k", 1, datetime.datetime(2026, 1, 31), "live", "f", None), ("s2", "k", 2, datetime.datetime(2026, 2, 1), "gone", None, "404")]
    records, folder = spark.createDataFrame(rows, sources.LOG_SCHEMA), str(tmp_path / "log")
    sources.append_log(records, folder)
    sources.append_log(records.limit(0), folder)
    assert sorted(map(tuple, sources.read_log(spark, folder).drop("month").select(records.columns).collect())) == sorted(rows)
    assert sources.read_log(spark, folder, "s2").count() == 1 and sources.read_log(spark, folder, "none").count() == 0


def test_blobs_are_stored_once(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    incoming = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (None,)], "bytes binary")
    sources.put_blobs(incoming, folder)
    sources.put_blobs(incoming.union(spark.createDataFrame([(b"c",)], "bytes binary")), folder)
    assert sorted(bytes(r.bytes) for r in spark.read.parquet(folder).collect()) == [b"a", b"b", b"c"]


def test_vectors_of_another_model_are_refused(spark, tmp_path):
    folder = str(tmp_path / "vectors")
    rows = spark.createDataFrame([("h", [1.0, 2.0])], "chunk_hash string, vector array<float>")
    sources.append_vectors(rows, folder, "m", 2)
    assert sources.stored_model(spark, folder) == ("m", 2)
    for model, dims in (("n", 2), ("m", 3)):
        with pytest.raises(ValueError):
            sources.append_vectors(rows, folder, model, dims)
    with pytest.raises(Exception, match="another width"):
        sources.append_vectors(rows.withColumn("vector", F.array(F.lit(1.0).cast("float"))), folder, "m", 2)


def test_embedding_retries_one_by_one(spark):
    class Picky(embed.HashingEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return super().embed(texts)

    rows = spark.createDataFrame([("1", "good one"), ("2", "bad"), ("3", None)], "chunk_hash string, chunk_text string")
    found = {r.chunk_hash: (r.vector is not None, r.reason) for r in embed.embedded(rows, Picky).collect()}
    assert found == {"1": (True, None), "2": (False, "refused"), "3": (True, None)}
    with pytest.raises(ValueError):
        embed.checked([[float("nan")]], 1, 1)
    hits = [("a", 0.3, "x"), ("b", 0.2, "y")]
    assert embed.reranked(hits, lambda t: [0.1, 0.9]) == ([("b", 0.9), ("a", 0.1)], None)
    assert embed.reranked(hits, lambda t: [0.1]) == ([("a", 0.3), ("b", 0.2)], "1 scores for 2 passages")


def test_caption_paragraphs(spark):
    cues = [(1, 0, 1000, "one"), (1, 2000, 3000, " "), (1, 4000, 5000, "two"), (1, 15001, 16000, "after"), (1, 16000, 17000, "x" * 600 + "."), (1, 17000, 18000, "end"), (2, -5, 5, "z")]
    found = captions.caption_paragraphs(spark.createDataFrame(cues, "track long, start_ms long, end_ms long, text string")).orderBy("track", "session", "paragraph").collect()
    assert [r.text for r in found] == ["[00:00:00] one two", "[00:00:15] after " + "x" * 600 + ".", "[00:00:17] end", "[00:00:00] z"]


def test_line_counts_are_a_fold(spark):
    """Counts of two builds joined teach what all documents do; copies of a line within a document, and of its id, count once."""
    lines = ["a line that some share", "another line of theirs", "short"]
    docs = spark.createDataFrame([(i % 11, f"s{i % 2}" if i % 5 else None, "\n".join([lines[i % 2], lines[i % 3], lines[0], f"its own line {i % 13}"])) for i in range(40)] + [(99, "s0", None)], "doc_id long, source string, text string")
    want = {}
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            if len(line) >= 12:
                want.setdefault((r.source, line), set()).add(r.doc_id)
    want = {k: len(v) for k, v in want.items() if len(v) >= 5}
    first, rest = text.line_counts(docs.where("doc_id % 3 = 0")), text.line_counts(docs.where("doc_id % 3 <> 0"))
    for found in (text.boilerplate_lines(docs), text.boilerplate_lines(docs, counts=text.merged_counts(first, rest))):
        assert {(r.source, r.line): r.n_docs for r in found.collect()} == want and want


@pytest.mark.parametrize("blank", ["", "\n \t\n", "\n" * 20_000])
def test_records_behind_blank_lines(spark, blank):
    rows = ["a,b,c", blank + "1,2,3", "4,5,6"]
    cases = ["\n".join(rows), "\n".join([*rows, "7,8,9", "1,1,1", "2,2,2", "not a record", "x" * 100_000]), "\n".join([*rows[:2], "no"]), "a,b,c" + blank, "| a |" + blank + "\n|---|"]
    found = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(is_records(F.col("t"))).collect()]
    assert found == [True, True, False, False, blank == ""]


def paragraphs_by_hand(cues):
    """Sessions and paragraphs of cues, one after the other."""
    out, before = [], None
    for track, start, end, said in sorted((t, s, e, x.strip()) for t, s, e, x in cues if x and x.strip() and s is not None and e is not None):
        if before is None or before[0] != track:
            session, paragraph, words = 1, 0, None
        elif start - before[1] > 10_000:
            session, paragraph, words = session + 1, 0, None
        if words is None:
            out.append([track, session, paragraph, start, said])
        else:
            out[-1][4] += " " + said
        words = out[-1][4]
        size = len(words.encode())
        if size >= 1200 or (size >= 600 and words[-1] in ".?!"):
            paragraph, words = paragraph + 1, None
        before = (track, end)
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_caption_paragraphs_by_spans(spark, seed, monkeypatch):
    """A hot track over many partitions and a tree of several levels, cues that repeat, and many small tracks."""
    monkeypatch.setattr(captions.segments, "FAN", 3)
    dice = random.Random(seed)
    cues, at = [], 0
    for _ in range(3000):
        at += dice.choice([500, 500, 500, 2000]) if dice.random() > 0.004 else 30_000
        cues.append((7 if dice.random() > 0.3 else dice.randrange(12), at, at + dice.randrange(1500), "wörd " * dice.randrange(0, 30) + dice.choice(["end.", "more", "so?", " ", "x" * 1300 if dice.random() < 0.02 else "y"])))
    cues += [(7, 40_000, 40_100, "again and again.")] * 700 + [(7, 1, None, "never"), (3, None, 5, "never"), (4, 5, 6, None)]
    df = spark.createDataFrame(cues, "track long, start_ms long, end_ms long, text string").repartition(5)
    for parts in ("1", "16"):
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
        try:
            for k, v in zip(before, (parts, "false", "50" if parts == "16" else "10000")):
                spark.conf.set(k, v)
            found = captions.caption_paragraphs(df).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert all(r.text.startswith("[") for r in found)
        assert sorted((r.track, r.session, r.paragraph, r.start_ms, r.text.split("] ", 1)[1]) for r in found) == paragraphs_by_hand(cues)
    assert captions.caption_paragraphs(df.where("false")).count() == 0


def test_readers():
    text, title, tool, notes, fallback = reader.read_html("<title>T &amp; U</title><nav>menu</nav><main><nav>sub</nav><h2>Head</h2><p>a <a href='/x'>link</a></p><ul><li>i<li>j</ul></main>")
    assert (text, title, tool, notes, fallback) == ("# T & U\n\n## Head\n\na link\n\n- i\n\n- j", "T & U", "marked", "", False)
    text, _, tool, notes, fallback = reader.read_html("<div><p>" + "word " * 60 + "</p></div><div><a href='/'>home</a></div>")
    assert tool == "densest" and fallback and "home" not in text and notes
    assert reader.read_html("<div>bare</div>")[2] == "whole"
    assert reader.read_html(None)[0] == reader.read_html("<script>x</script>")[0] == ""
    table = reader.Tree("<table><tr><th>a<th>b|c</tr><tr><td>1</td></tr></table>").root
    assert reader.table_markdown(table) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert reader.read_html(deep)[0] == "x"


def test_enclosures_and_paths():
    html = """<embed src="/a.pdf#view=Fit"><iframe src='https://b.org/b.pdf'></iframe><a href="c.DOCX?x=1&amp;y=2">c</a><a href="/page">p</a><a href="/.pdf">n</a>
    <script>var u = "/d.csv"; var v = "/e.pdf" + name; var w = x + ".pdf";</script><object data="/a.pdf"></object>"""
    assert addresses.enclosed(html, "https://a.gov/dir/") == (["https://a.gov/a.pdf", "https://a.gov/dir/c.DOCX?x=1&y=2", "https://a.gov/d.csv"], 0)
    assert addresses.enclosed(html, "https://a.gov/dir/", most=1)[1] == 2
    assert addresses.enclosed(None, "https://a.gov/") == ([], 0)
    path = addresses.relative_path
    assert path("https://x.gov/docs/Report.pdf", "pdf") == "x.gov/docs/Report.pdf" and path("https://x.gov/Report.aspx", "html") == "x.gov/Report.aspx.html"
    assert path("https://x.gov/", "html") == "x.gov/index.html" and path("https://x.gov/v?id=1", "html") != path("https://x.gov/v?id=2", "html")
    assert path("https://x.gov/a.pptx", "document") == "x.gov/a.pptx" and path("legistar:matter:1", "json") == "legistar_matter_1.json"
    assert len(addresses.safe_name("x" * 500)) == 120 and addresses.safe_name("..") == "_"


def test_sitemaps_and_robots():
    body = b"\xef\xbb\xbf<urlset><url><loc>u</loc></url><url><lastmod>x</lastmod></url></urlset>"
    assert addresses.sitemap_entries(gzip.compress(body)) == [("page", "u", None)]
    assert addresses.sitemap_entries(b"<rss/>") == addresses.sitemap_entries(b"<html>") == addresses.sitemap_entries(None) == []
    robots = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: me\nDisallow: /"
    for url, allowed in {"/": True, "/a": False, "/a/b": True, "/x.pdf": False, "/x.pdf?y": True}.items():
        assert addresses.robots_allows(robots, "other", f"https://a.gov{url}") is allowed
    assert not addresses.robots_allows(robots, "Me", "https://a.gov/z") and addresses.robots_allows(None, "me", "https://a.gov/z")


def test_cron():
    after = datetime.datetime(2026, 1, 1, tzinfo=UTC)
    nxt = lambda text, zone="UTC", at=after: Cron.parse(text).next_after(at, zone)
    assert nxt("0 0 * * *") == datetime.datetime(2026, 1, 2, tzinfo=UTC)
    assert nxt("0 0 13 * fri") == datetime.datetime(2026, 1, 2, tzinfo=UTC)
    assert nxt("0 0 */2 * 7") == datetime.datetime(2026, 1, 11, tzinfo=UTC)
    assert nxt("5/20 3 * * *") == datetime.datetime(2026, 1, 1, 3, 5, tzinfo=UTC)
    assert nxt("30 2 * * *", "America/New_York", datetime.datetime(2026, 3, 8, tzinfo=UTC) + datetime.timedelta(hours=6)) == datetime.datetime(2026, 3, 8, 7, 30, tzinfo=UTC)
    assert nxt("30 1 * * *", "America/New_York", datetime.datetime(2026, 11, 1, 5, 30, tzinfo=UTC)) == datetime.datetime(2026, 11, 2, 6, 30, tzinfo=UTC)
    assert nxt("0 0 30 2 *") is None
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            Cron.parse(bad)
    assert jitter_offset("a", "b", 0) == 0 and jitter_offset("a", "b", 600) == jitter_offset("a", "b", 600) < 600


def test_columns_with_nulls(spark):
    row = spark.range(1).select(
        content.content_kind(F.lit(None), F.lit(None).cast("binary"), F.lit(None)).alias("kind"),
        content.is_document(F.lit("/a/.pdf")).alias("stemless"),
        content.is_document(F.lit("/a/b.PDF")).alias("named"),
        content.suggested_id(F.lit("www.City-Hall.gov")).alias("id"),
        content.w3c_datetime(F.lit("2026-01-02")).alias("day"),
        content.video_id_of(F.lit("https://y/watch?v=abc&t=1")).alias("video"),
        captions.hms(F.lit(360_000_000)).alias("hms"),
    ).first()
    assert tuple(row) == ("other", False, True, "city-hall", datetime.datetime(2026, 1, 2), "abc", "100:00:00")


def test_crumbs_of_a_linkless_table(spark):
    empty = spark.createDataFrame([], "url string, html string")
    assert crumbs.tally(crumbs.crumb_rows(empty)).count() == 0
    pages = spark.createDataFrame([("https://a.gov/", None), ("https://a.gov/2", "".join(f'<a href="https://h{i % 2}.org/{i}">x</a>' for i in range(50)))], "url string, html string")
    assert {(r.url, r.host, r.links) for r in crumbs.crumb_rows(pages).collect()} == {("https://a.gov/", None, 0), ("https://a.gov/2", "h0.org", 25), ("https://a.gov/2", "h1.org", 25)}


def test_history_filters(spark):
    rows = [(f"r{i}", "s", ["ok", "failed", "skipped"][i % 3], datetime.datetime(2026, 1, 1 + i)) for i in range(9)]
    journal = spark.createDataFrame(rows, "run_id string, schedule string, outcome string, started_at timestamp")
    assert [r.run_id for r in runs.run_history(journal, failed=True, since="2026-01-03").collect()] == ["r7", "r4"]
    assert [r.run_id for r in runs.run_history(journal, run="r8").collect()] == ["r8"]
