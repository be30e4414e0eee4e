"""Phrases, exact top-k and the Merkle manifest against brute-force versions, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, phrases, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, f long, part string, row long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)] + ["The", "ÉTÉ", "x y"]
    weights = 1 / np.arange(1, 16)
    texts = [" ".join(rng.choice(words, 60, p=weights / weights.sum())) for _ in range(90)]
    texts = [t.replace("w3", "w3,").replace("w7", "w7.\n") for t in texts] + [None, "", " \n ", "ha " * 500, "alpha beta gamma. " * 40, texts[0], texts[0], "w1\tw2" + " w1 w2" * 3000]
    return [(i, t, ["en", None, "und", "fr"][i % 4], ["s", None][i % 2]) for i, t in enumerate(texts)]


def brute_phrases(rows, least, longest, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= percent * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest, top", [(3, 2000), (3, 5), (5, 2000)])
def test_phrases(spark, rows, longest, top, monkeypatch):
    monkeypatch.setattr(phrases, "FRAGMENTS", 2000)
    monkeypatch.setattr(phrases, "OF_PIVOT", 300)  # frequent pivots have several partitions
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(phrases, "FREQUENT", 50)
    got = phrases.collocations(frame(spark, rows), longest=longest, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 10, longest, 50, top)


def test_phrases_of_large_counts_and_empty_tables(spark, rows):
    assert phrases.collocations(frame(spark, rows).where("false")).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, "en", "s"), (2, " ", None, "s")])).count() == 0
    everything = phrases.collocations(frame(spark, rows), top=None)
    assert everything.where("rank is not null").count() == 0 and everything.count() == len(brute_phrases(rows, 10, 3, 50, 10**9))


def test_fragments_own_each_ngram_once():
    rng = np.random.default_rng(0)
    for longest in (2, 3, 4):
        x = rng.integers(-1, 4, 400)
        found = phrases.fragments(x, longest)
        got = Counter()
        for g, n in phrases.owned(found, np.ones(found.shape[1], np.int64), longest, 1):
            got.update({tuple(c): int(k) for c, k in zip(g.T.tolist(), n)})
        want = Counter(tuple(x[i : i + n].tolist()) for n in range(2, longest + 1) for i in range(len(x) - n + 1) if (x[i : i + n] >= 0).all())
        assert got == want
    wide = np.array([[1 << 40, 5, 1 << 40], [7, 7, 7]])
    assert phrases._sums(wide, np.array([1, 2, 3]))[1].sum() == 6 and phrases._sums(wide, np.array([1, 2, 3]))[0].shape == (2, 2)


def brute_matches(vectors, k=10):
    good = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and i % 100 == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, y)), 2**63 - 1), -(2**63)), math.inf if j is None else j) for m, j, y in good if m != n and len(y) == len(q))
            out += [(i, rank, None if j == math.inf else j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<{}>, label int, row string, block int, d int, run int"


@pytest.mark.parametrize("kind", ["double", "float"])
def test_exact_topk(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 12))
    vectors = [(i * 10, [float(np.float32(x)) for x in centre[i % 6] + rng.normal(size=12) * 0.3]) for i in range(300)]
    vectors += [(3001, vectors[0][1]), (0, vectors[10][1]), (0, vectors[0][1]), (None, vectors[0][1]), (100, None), (200, [None] * 12), (300, [float("nan")] * 12), (400, [float("inf")] * 12)]
    vectors += [(500, [0.0] * 12), (600, [-0.25] * 12), (700, [1.0, 2.0]), (701, [1.0, -2.0]), (800, []), (801, []), (900, [5.0])]
    if kind == "double":
        vectors += [(1000, [1e200] + [1.0] * 11), (1001, [-1e200] + [1.0] * 11), (1002, [1e-310] * 12), (1003, [1e306] * 12)]
    monkeypatch.setattr(topk, "QUERIES", 7)
    df = spark.createDataFrame([(i, v, 1, "r", 1, 1, 1) for i, v in vectors], VECTORS.format(kind))
    got = [tuple(r)[:4] for r in topk.best_matches(df).collect()]
    assert sorted(got, key=repr) == brute_matches(vectors)
    assert topk.best_matches(df.where("false")).count() == 0 and topk.best_matches(df.where("vec_id = 3001")).count() == 0


def test_maxscore_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    y = np.floor(1024 * np.where(rng.random((4000, 30)) < 0.2, rng.normal(size=(4000, 30)), 0))
    shard = topk.Shard(np.arange(4000), np.arange(4000), y)
    for q in y[:50]:
        whole = y @ q
        floor = np.sort(whole)[-10]
        at, score = shard.at_least(q, float(floor))
        assert set(np.flatnonzero(whole >= floor)) == set(at.tolist()) and (score == whole[at]).all()


def brute_manifest(rows):
    H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(enc(v) for v in (r[0], r[3], r[2], len(r[1] or ""), text))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def fold(levels, place, value, siblings):
        for level in levels[:-1]:
            low = place // 8 * 8
            run = level[low : low + 8]
            siblings += run[: place - low] + run[place - low + 1 :]
            value, place = H([*run[: place - low], value, *run[place - low + 1 :]]), place // 8
        return value

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {lang: tree([leaf(r, r[1]) for r in groups[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for place, r in enumerate(groups[lang]):
            broken = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            siblings = []
            value = fold(trees[lang], place, leaf(r, r[1].translate(LOWER) if broken and r[1] is not None else r[1]), siblings)
            value = fold(top, n, value, siblings)
            out.append((r[0], leaf(r, r[1]), trees[lang][-1][0], top[-1][0], H(siblings), value, value == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("each", [1 << 15, 11])
def test_manifest(spark, each, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", each)
    monkeypatch.setattr(merkle, "FAN", 3)
    rows = [(i * 7 % 500, f"Text {i} É", ["en", "en", "en", "fr", None, f"l{i % 40}"][i % 6], ["s", None][i % 2]) for i in range(500)]
    rows += [(None, "NULL id", "en", "s"), (None, "NULL id", "en", "s"), (3, "again", "en", "s"), (3, "again", "en", "s"), (1000, None, "", None), (1001, "", "zz", "s"), (1002, "Ünï" * 50_000, "fr", "s")]
    got = merkle.manifest(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)
    assert merkle.manifest(frame(spark, rows).where("false")).count() == 0
    one = merkle.manifest(frame(spark, rows[:1])).first()
    assert one.leaf == one.root == one.subroot and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_forest_merges_in_any_order():
    rng = np.random.default_rng(2)
    sizes = {0: 100, 1: 1, 2: 65, merkle.TOP: 3}
    leaves = [((t, 0, i), merkle.digest([f"{t} {i}"])) for t in (0, 1, 2) for i in range(sizes[t])]
    roots = set()
    for _ in range(5):
        forest = merkle.Forest(sizes)
        for k in rng.permutation(len(leaves)):
            forest.add(*leaves[k])
        (root,) = forest.unresolved()
        roots.add(forest.nodes[root])
    assert len(roots) == 1
