"""The operators of the llm folder against brute-force versions, on fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embeddings, html_text, language, minhash, mixing, packing, perplexity, substrings, unigram
from lodestone.llm.bilinear import language_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, _id string, component_id string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{rng.integers(400)}" for _ in range(80)) for _ in range(30)]
    texts = []
    for i in range(90):
        w = base[i % 30].split()
        for k in rng.integers(0, 80, i % 6):
            w[k] = f"x{i}{k}"
        texts.append(" ".join(w) + ("\nSame line here\nSame line here" if i % 7 == 0 else ""))
    texts += [None, "", "  \n\t", "One two", "one Two", "a b c d", "The é über ñandú 東京   x", "ha " * 300, "long " + "z" * 5000, base[0], base[0]]
    out = [(i * 3 % 101, t, ["en", "fr", None][i % 3], ["s", "t", None, "s"][i % 4], 0, "x", "y", "z") for i, t in enumerate(texts)]
    assert len({r[0] for r in out}) == len(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_minhash(spark, docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    want = classes(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, shingle_words=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())
    assert minhash.near_duplicates(empty).count() == 0 and minhash.without_near_duplicates(empty).count() == 0
    doubled = docs.union(docs)
    left = minhash.without_near_duplicates(doubled, shingle_words=4)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({v for v in want.values()})


def test_minhash_repeated_and_null_ids(spark):
    rng = np.random.default_rng(5)
    a, b = (" ".join(f"w{rng.integers(900)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, "far away from all the others"), (4, b + " z"), (None, a), (5, a), (5, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == sorted([(1, 57, 1), (1, 57, 1), (2, 58, 1), (3, 58, 1), (3, 3, 3), (4, 58, 1), (0, 57, 0), (5, 57, 1), (5, 57, 1)])


def test_substrings(docs, rows, empty):
    first = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    for base in (4, 13):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(docs, base=base).collect()} == want
    assert substrings.without_repeats(empty).count() == 0


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in perplexity.judged(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert perplexity.judged(empty).count() == 0


def brute_kneser_ney(grams, order, symbols, least=1):
    """Interpolated modified Kneser-Ney from a Counter of tuples: the probability of a symbol after a context, as a function.

    Of each length only n-grams that occur ``least`` times are stored; discounts and totals are those of all.
    """
    counts, occur = {order: dict(grams)}, {order: Counter(grams)}
    for n in range(order - 1, 0, -1):
        counts[n] = dict(Counter(g[1:] for g in counts[n + 1]))
        occur[n] = Counter()
        for g, c in occur[n + 1].items():
            occur[n][g[1:]] += c

    def discounts(n):
        n1, n2, n3, n4 = (sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0
        d = [k - (k + 1) * y * b / a if a and y else 0.75 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [min(max(x, 0.01), top) for x, top in zip(d, (0.99, 1.99, 2.99), strict=True)]

    ds = {n: discounts(n) for n in counts}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / symbols
        after = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        own = {g: (c - ds[n][min(c, 3) - 1]) / sum(after.values()) for g, c in after.items() if occur[n][g] >= least}
        return own.get(gram, 0) + (1 - sum(own.values())) * p(gram[1:])

    return p


def levels_of(codes, order):
    """The levels of a model that stores every n-gram."""
    levels, none = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams, counts = np.unique(codes, return_counts=True)
    for n in range(order, 0, -1):
        levels.insert(0, perplexity.Level(grams, counts, np.ones(len(grams)), none, np.bincount(counts, minlength=5)[1:5]))
        grams, counts = np.unique(perplexity.lower_order(grams, n - 1), return_counts=True)
    return levels


def split(code, order):
    return tuple(int(code) >> 16 * k & 0xFFFF for k in range(order - 1, -1, -1))


def test_kneser_ney():
    rng = np.random.default_rng(0)
    text = np.array([97, 98, 99, 0x431, 0x4E1C], np.uint16)[rng.integers(0, 5, 400)]
    codes, _ = perplexity.gram_codes(text, np.array([0, 400]), 3)
    model = perplexity.kneser_ney(levels_of(codes, 3))
    p = brute_kneser_ney(Counter(split(c, 3) for c in codes), 3, 2**16)
    odd = [*np.unique(codes)[:60].tolist(), 97 << 32 | 98 << 16 | 0x7A, 0x7A << 32 | 0x7A << 16 | 97, 0x7A << 32 | 98 << 16 | 97]
    assert np.allclose(10 ** model.score(np.array(odd, np.uint64)).astype(float), [p(split(c, 3)) for c in odd], rtol=1e-4)
    for context in (int(codes[50]) >> 16, 0x7A << 16 | 97, 0x7A << 16 | 0x7B):
        every = np.uint64(context) << np.uint64(16) | np.arange(2**16, dtype=np.uint64)
        assert abs((10 ** model.score(every).astype(float)).sum() - 1) < 1e-3


@pytest.mark.parametrize("most_grams", [1 << 20, 300])
def test_models_discount_by_all_counts(spark, most_grams):
    """Counted by Spark, rare n-grams stored or not: as brute force, and each context's probabilities sum to one."""
    from pyarrow import array

    from lodestone.llm.textcore import Words, column_bytes

    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdé東"), rng.integers(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(pool, 40, p=1 / np.arange(1, 61) / sum(1 / np.arange(1, 61)))) for _ in range(60)]
    models = perplexity.language_models(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), most_grams=most_grams, spread=False)
    words = Words(*column_bytes(array(texts)))
    symbols, bounds = perplexity.folded(words)
    codes, doc = perplexity.gram_codes(symbols, bounds, 4)
    for half in (0, 1):
        mine = codes[(perplexity.halves(words, words.hashes()) == half)[doc]]
        least = max(1, int(np.ceil(len(mine) / most_grams)))
        p = brute_kneser_ney(Counter(split(c, 4) for c in mine), 4, 2**16, least)
        some = rng.choice(np.unique(codes), 150, replace=False)
        model = models.of("en", half)
        assert np.allclose(10 ** model.score(some).astype(float), [p(split(c, 4)) for c in some], rtol=1e-3)
        for context in some[:3]:
            every = context >> np.uint64(16) << np.uint64(16) | np.arange(2**16, dtype=np.uint64)
            assert abs((10 ** model.score(every).astype(float)).sum() - 1) < 1e-3
    assert least == 1 or len(np.unique(mine)) > sum(c >= least for c in Counter(mine.tolist()).values()) > 0  # something is left out, and something isn't


@pytest.mark.parametrize("most_filed", [1 << 21, 300, 1])
def test_quality_scores_by_all_ngrams(spark, most_filed):
    """Perplexities are those of brute force in which every n-gram teaches, however few have their scores in the file."""
    from pyarrow import array

    from lodestone.llm.textcore import Words, column_bytes

    rng = np.random.default_rng(6)
    pool = ["".join(rng.choice(list("abcdé東"), rng.integers(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(pool, 25, p=1 / np.arange(1, 61) / sum(1 / np.arange(1, 61)))) for _ in range(40)] + ["", None, "zz yy"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, texts[i], "xx") for i in range(20)] + [(200, texts[0], "one")] * 2
    got = perplexity.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_filed=most_filed, spread=False).collect()
    assert len(got) == len(rows) and all(r.perplexity is None for r in got if r.doc_id == 200)  # no other half
    for lang, first, mine in (("en", 0, texts), ("xx", 100, texts[:20])):
        words = Words(*column_bytes(array(mine)))
        codes, doc = perplexity.gram_codes(*perplexity.folded(words), 4)
        half, found = perplexity.halves(words, words.hashes()), {r.doc_id - first: r.perplexity for r in got if r.lang == lang}
        p = [brute_kneser_ney(Counter(split(c, 4) for c in codes[(half == h)[doc]]), 4, 2**16) for h in (0, 1)]
        for i in (0, 1, 5, 12, 19, *((40, 41, 42) if lang == "en" else ())):
            each = [np.log10(p[1 - half[i]](split(c, 4))) for c in codes[doc == i]]
            assert np.isclose(found[i], 10 ** -np.mean(each or [0]), rtol=1e-9)


def test_symbols_of_every_script():
    texts = ["Ab 12", "Где Ñu", "東京", "a😀b", "", None, "x"]
    from pyarrow import array

    from lodestone.llm.textcore import Words, column_bytes

    symbols, bounds = perplexity.folded(Words(*column_bytes(array(texts))))
    got = ["".join(map(chr, symbols[a:b])) for a, b in itertools.pairwise(bounds.tolist())]
    grin = chr(0xD800 + 0x1F600 % 2048)
    assert got == [" ab 00 ", " где ñu ", " 東京 ", f" a{grin}b ", "", "", " x "]


def test_quality_bands_reject_on_both_sides(spark):
    rng = np.random.default_rng(9)
    vocabulary = {script: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(2000)] for script, letters in (("en", "etaoinshrdlucmwf"), ("ru", "оеаинтсрвлкмдпуя"), ("el", "αβγδεζηθικλμνξοπ"))}
    rows, schema, often = [], "doc_id long, text string, lang string", 1 / np.arange(4, 2004)
    for lang, words_ in vocabulary.items():
        rows += [(k, " ".join(rng.choice(words_, rng.integers(60, 300), p=often / often.sum())), lang) for k in range(len(rows), len(rows) + 150)]
    clean = len(rows)
    # A form whose fields repeat with words between them, so no eight words repeat; and letters in another order.
    form = lambda lang: " ".join(f"{vocabulary[lang][0]} {vocabulary[lang][1]} {vocabulary[lang][0]} {vocabulary[lang][1]} {vocabulary[lang][0]} {w}" for w in rng.permutation(vocabulary[lang])[:40])
    rows += [(1000 + i, form(lang), lang) for i, lang in enumerate(vocabulary)]
    rows += [(2000 + i, " ".join("".join(rng.permutation(list("etaoinshrdlucmwfоеаинтсрвл"))[:6]) for _ in range(120)), lang) for i, lang in enumerate(vocabulary)]
    got = {r.doc_id: r for r in perplexity.judged(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[i].kept for i in range(clean))
    for i in (1000, 1001, 1002):
        assert not got[i].base_failed and not got[i].kept and got[i].perplexity < got[i].low
    for i in (2000, 2001, 2002):
        assert not got[i].kept and got[i].perplexity > got[i].high


def test_quality_keeps_near_copies_of_clean_text(spark):
    rng = np.random.default_rng(10)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(vocabulary, 150)), "en") for i in range(200)]
    for i in range(100):  # a third of all rows
        w = rows[0][1].split()
        w[rng.integers(150)] = f"{i}"
        rows.append((1000 + i, " ".join(w), "en"))
    assert all(r.kept for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in rows}
    got = packing.packed(docs, path, sequence=64).collect()
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(empty, path).count() == 0


def brute_mixing(rows, powers, share):
    """Rates by cell: raking of a dictionary of cells, and a bisection for the level."""
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    weight = {c: float(n) for c, n in cells.items()}
    wants = []
    for axis, power in enumerate(powers):
        own = Counter()
        for c, n in cells.items():
            own[c[axis]] += n
        total = sum(v**power for v in own.values() if v)
        wants.append({k: v**power / total if v else 0.0 for k, v in own.items()})
    for _ in range(300):
        for axis, want in enumerate(wants):
            sums = Counter()
            for c, w in weight.items():
                sums[c[axis]] += w
            weight = {c: w * want[c[axis]] / sums[c[axis]] if sums[c[axis]] else 0.0 for c, w in weight.items()}
    raw = {c: weight[c] / n if n else 0.0 for c, n in cells.items()}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * raw[c]) for c, n in cells.items()) < share * sum(cells.values()) else (low, mid)
    return {c: min(1, high * raw[c]) for c in cells}


def test_mixing(spark, docs, rows, empty):
    full = docs.where("doc_id % 5 <> 1 or source = 's' or text is null")  # weights that differ by axis
    got = mixing.mixed(full, rounds=300).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(words(t)) for i, t, _, s, *_ in rows if i % 5 != 1 or s == "s" or t is None}
    want = brute_mixing(got, (0.7, 0.9, 0.9), 0.8)
    assert all(r.rate == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-5, abs=1e-9) for r in got)
    assert all(r.residual < 1e-6 for r in got) and 1 < len({r.topic for r in got}) <= 9 and all((r.topic is None) == (r.n_tokens == 0) for r in got)
    for r in got:
        assert r.kept == (int(hashlib.md5(f"{r.doc_id}:0".encode()).hexdigest()[:13], 16) / 16**13 < r.rate)
    assert mixing.mixed(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_mixing_to_asked_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 60))), "abc"[i % 3], "xy"[i % 7 % 2], "pqr"[i % 11 % 3], 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, target double")
    targets = {"source": {"a": 2, "b": 1, "c": 1}, "lang": {"x": 0.7, "y": 0.3}, "topic": {"p": 1, "q": 1, "r": 2}}
    got = mixing.mixed(df, topic_column="topic", targets=targets, share=0.2, rounds=100).collect()
    total = sum(r.rate * r.n_tokens for r in got)
    for axis, want in targets.items():
        for value, share in want.items():
            assert sum(r.rate * r.n_tokens for r in got if r[axis] == value) / total == pytest.approx(share / sum(want.values()), rel=1e-6)
    assert total == pytest.approx(0.2 * sum(r.n_tokens for r in got))
    with pytest.raises(ValueError):
        mixing.mixed(df, topic_column="topic", targets={"lang": {"z": 1}})


def test_learnt_topics_follow_the_words(spark):
    rng = np.random.default_rng(3)
    vocabulary = [[f"{k}w{i}" for i in range(30)] for k in range(2)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2], 80)), "s", "en" if i % 4 < 2 else "fr") for i in range(200)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    seen = Counter((r.topic, r.doc_id % 2) for r in got)
    assert sum(n for (_, k), n in seen.items() if n == max(v for (t, j), v in seen.items() if j == k)) > 190 and len({t for (t, _), n in seen.items() if n > 50}) == 2


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.vocabulary(path)
    least = min(s for _, s in pieces)
    for fallback, more in ((False, []), (True, [(f"<0x{b:02X}>", least) for b in range(256)])):
        model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *more], unk_id=0, byte_fallback=fallback))
        want = {i: len(model.encode([unigram.SPACE + w for w in words(t)], is_pretokenized=True).ids) if words(t) else 0 for i, t, *_ in rows}
        assert {r.doc_id: r.n_tokens for r in unigram.token_counts(docs, path, byte_fallback=fallback).collect()} == want
    own = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs, pieces=[(unigram.SPACE, -1.0), ("a", -2.0)], byte_fallback=False).collect()}
    assert own[next(i for i, t, *_ in rows if t == "a b c d")] == 8
    assert unigram.token_counts(empty, path).count() == 0


def test_viterbi_ties():
    from tokenizers import Tokenizer, models

    pieces = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)]
    model, own = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False)), unigram.UnigramCounter(pieces)
    for n in range(1, 6):
        for word in map("".join, itertools.product("abz", repeat=n)):
            assert own.count("▁" + word)[0] == len(model.encode(["▁" + word], is_pretokenized=True).ids), word


def test_language_model(docs, rows, empty):
    texts = {i: [*words((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(x for i, w in texts.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for r in language_scores(docs).collect():
        w = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
    assert language_scores(empty).count() == 0


def test_language_model_sums_to_one_and_learns(spark):
    from lodestone.llm import bilinear

    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, 400, dtype=np.uint64)
    numbers = np.sort(rng.integers(20, 900, 400))[::-1].copy()
    tails, sizes = np.full(bilinear.ENDINGS, 50_000, np.int64), np.full(bilinear.ENDINGS, 40, np.int64)
    vocabulary = bilinear.Vocabulary.build(keys, numbers, 7, tails + 0, sizes + 0)
    assert vocabulary.counts.sum() == 7 + tails.sum() and (vocabulary.of(keys) > bilinear.ENDINGS).all() and len(set(vocabulary.of(keys).tolist())) == 400
    model = bilinear.LogBilinear.new(vocabulary, vocabulary.shares())
    for name in ("context", "target", "scale", "word"):
        model.parts[name][:] += rng.normal(0, 0.3, model.parts[name].shape).astype(np.float32)
    ids = np.concatenate([np.arange(1 + bilinear.ENDINGS), np.sort(vocabulary.ids)])
    for context in rng.integers(0, 200, (3, bilinear.CONTEXT)):
        assert abs((10 ** model.log10(ids, np.repeat(context[:, None], len(ids), axis=1), vocabulary.group_sizes())).sum() - 1) < 1e-3
    got = language_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    score, base = sum(r.score for r in got), sum(r.base_score for r in got)
    assert score > base + 0.1 * sum(r.n_tokens for r in got) and sum(r.score > r.base_score for r in got) > 0.95 * len(got)


def test_language_model_repeated_and_null_ids(spark):
    rows = [(None, "a b"), (None, "c d"), (1, "a b"), (1, "e"), (2, None), (3, ""), (4, "A b a")]
    got = language_scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit("x")).withColumn("chunk", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (0, 3), (1, 2), (1, 3), (2, 1), (3, 1), (4, 4)]


def test_language_id(spark, empty):
    data = "/root/testdata/sf0.01/documents.parquet"
    source = spark.read.parquet(data)
    got = language.identified(source).join(source.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert max(r.score for r in got) <= 1
    scripts = {"en": "the quick fox a", "ru": "бурая лиса я", "el": "αλεπού καφέ η", "hi": "भूरी लोमड़ी क", "zh": "棕色狐狸 是", "xx": "𐐀𐐁𐐂 𐐃"}
    rows = [(i, text, lang) for i, (lang, text) in enumerate(list(scripts.items()) * 40)] + [(1000 + i, text.split()[-1], None) for i, text in enumerate(scripts.values())]
    told = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(told[i].lang_pred == lang for i, lang in enumerate(list(scripts) * 40))
    assert all(told[1000 + i].lang_pred == lang and told[1000 + i].score > 0 for i, lang in enumerate(scripts))  # one letter between two edges
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "hello there", "en"), (5, "x", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identified(odd).collect()}[1] == "und"
    assert language.identified(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(size=16) * 0.1 * (i % 5)).astype(np.float32).tolist() for i in range(200)]
    rows = [(i * 7 % 211, v, None if i % 50 == 9 else i % 2) for i, v in enumerate(vectors)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1), (305, [1.0], 1), (306, vectors[0], 0), (307, vectors[0], 0)]
    good = {i: np.array(v, float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}

    def linked(a, b):
        if a not in good or b not in good or label[a] != label[b] or len(good[a]) != len(good[b]):
            return False
        return good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.93

    ids = sorted(label)
    want, links = classes(ids, linked), {i: sum(linked(i, j) for j in ids if j != i) for i in ids}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicate_vectors(df, block=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], want[i], want[i] == i) for i in ids}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embeddings_repeated_ids(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [(1, v(1, 0, 0), "x"), (1, v(0, 1, 0), "x"), (2, v(1, 0.1, 0), "x"), (3, v(0, 1, 0.1), "x"), (1, v(1, 0, 0), "y"), (None, v(1, 0, 0), "x"), (4, v(0, 0, 1), "x")]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(*r, "d", 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, doc string, n long, component long"))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_html(spark):
    page = (
        '<html><head><title>T</title></head><body><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav><article><h1>Caf&eacute;  &amp; more</h1>'
        "<p>First  words\n here, with some length to it.<p>Second one<br>goes on for a while.</article><div id=comments class=comments><div class=comment><p>Nice post!</p></div></div>"
        "<footer>&copy; us</footer><script>x='<p>no</p>'</script></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>"), (5, "x", "<div>" * 300 + "t")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[1].text == "Café & more\n\nFirst words here, with some length to it.\n\nSecond one goes on for a while."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == "" and got[5].n_chars in (0, 1)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_quality_counts_every_document(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(300)]

    def prose(n, joint=" "):
        return joint.join(rng.choice(vocabulary, n))

    rows = [(i, prose(150), "en") for i in range(200)] + [(1000 + i, prose(150, "### ") + "###", "en") for i in range(10)]
    rows += [(2000 + i, prose(60, " | "), "tables") for i in range(30)] + [(3000 + i, prose(8), None) for i in range(30)] + [(3100, prose(60), None)]
    got = {r.doc_id: r for r in perplexity.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.perplexity is not None for r in got.values())  # languages of tables or short texts only have a model too
    assert all(r.kept for i, r in got.items() if i < 1000 or 2000 <= i < 3000)
    assert not any(r.kept for i, r in got.items() if 1000 <= i < 2000)  # what few documents are full of teaches nothing


def test_quality_band_ignores_copies(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(200)]
    copied = " ".join(rng.choice(vocabulary[:60], 150))
    schema = "doc_id long, text string, lang string"
    got = perplexity.judged(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + [copied] * 300)], schema)).collect()
    clean = [r for r in got if r.doc_id < 200]
    assert all(r.kept for r in clean)  # copies of one text make neither the median nor the spread
    assert all(r.high / r.low > 1.5 for r in got)
    got = perplexity.judged(spark.createDataFrame([(i, texts[0], "en") for i in range(50)], schema)).collect()
    assert all(r.kept and r.perplexity is None and r.low is None for r in got)  # all copies share a half: no other text to judge them by


def test_html_without_optional_tags():
    def text(html):
        return [t for _, t in html_text.Page(html).texts]

    assert text("<html><head><title>T</title><article><h1>One</h1><p>Two</article>") == ["One", "Two"]
    assert text("<head><meta charset=utf-8><title>T</title>Bare text<p>Two") == ["Bare text", "Two"]
    assert text("<head><template><div>no</div></template><script>x</script></head><body><p>Yes") == ["Yes"]
    assert text("<body><p>a <math><mi>x</mi><annotation>\\x</annotation></math> b <object>c</object> <noscript>d</noscript>") == ["a x b c d"]


def article_of(page):
    """The article of a generated page without its adverts, by regular expressions: blocks end at block tags, <br> is a space."""
    import html

    body = re.search(r"(?s)<article[^>]*>(.*)</article>", page)
    body = re.sub(r'(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<div class="ad">.*?</div>', "", body[1]) if body else ""
    blocks = re.split(r"</?(?:h[1-6]|p|div|ul|ol|li|blockquote|pre|table|tr|td|figure|figcaption|article|section)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n\n".join(x for x in texts if x)


def test_html_equals_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_html_hidden_elements_and_clashing_columns(spark):
    page = "<body><article><h1>A title of it</h1><p>Some words that stay here, for a while.</p><div hidden><p>Not this one.</p>nor this</div><p>More words of the article follow.</p></article>"
    df = spark.createDataFrame([(1, "u", page, "x", 3)], "page_id long, url string, html string, text string, n_chars long")
    assert [r.text for r in html_text.main_text(df).collect()] == ["A title of it\n\nSome words that stay here, for a while.\n\nMore words of the article follow."]


def test_null_ids_and_clashing_columns(spark, rows):
    odd = [(None, "a b c d e f", "en"), (None, None, None), (1, "a b c d e f", None), (1, "a b c d e f", "en"), (2, "", "en")]
    df = spark.createDataFrame([(*r, i, "x", None) for i, r in enumerate(odd)], "doc_id long, text string, lang string, n_words long, chunk string, source string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for found in (substrings.without_repeats(df), minhash.near_duplicates(df), perplexity.judged(df), mixing.mixed(df), language.identified(df), unigram.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"))):
        assert sorted(r.doc_id or 0 for r in found.collect()) == [0, 0, 1, 1, 2]
    pieces = packing.packed(df, path).collect()
    assert sorted(r.doc_id or 0 for r in pieces) == [0, 0, 1, 1, 2] and all(r.length == r.doc_tokens for r in pieces)
    assert language.identified(df.withColumn("held_out", F.lit("x")).withColumn("score", F.lit(1))).count() == 5


def test_filters_of_empty_tables(empty):
    for found in (perplexity.accepted(empty), minhash.without_near_duplicates(empty), substrings.deduplicated_documents(empty), mixing.sampled(empty)):
        assert found.columns == empty.columns and found.count() == 0


def brute_packs(lengths, sequence):
    """How many packs pieces need when each goes, longest first, into the pack with most room that it fits."""
    import heapq

    rooms, packs = [], 0
    for n in sorted(lengths, reverse=True):
        if rooms and -rooms[0] >= n:
            heapq.heapreplace(rooms, rooms[0] + n)
        else:
            packs += 1
            heapq.heappush(rooms, n - sequence)
    return packs


def test_packing_is_longest_first_into_most_room():
    rng = np.random.default_rng(12)
    for sequence in (16, 64):
        for _ in range(40):
            lengths = rng.integers(1, sequence + 1, rng.integers(1, 120)).tolist()
            found = packing.patterns(Counter(lengths), sequence)
            placed = Counter()
            for pattern, count in found:
                assert sum(pattern) <= sequence
                for n in pattern:
                    placed[n] += count
            assert placed == Counter(lengths)
            # New packs take several of a length at once, so a few packs more or less than one at a time.
            assert abs(sum(c for _, c in found) - brute_packs(lengths, sequence)) <= max(1, 0.05 * brute_packs(lengths, sequence))


def test_embeddings_of_extreme_size(spark):
    """Vectors whose squares vanish or pass all bounds link by their directions, and spoil no others."""
    rows = [(1, [1.0, 0.1]), (2, [1.0, 0.11]), (3, [0.1, 1.0]), (4, [0.11, 1.0]), (5, [1e-200, 1e-200]), (6, [1e-310, 1e-310]), (7, [1e200, 1e200]), (8, [1e308, -1e308]), (9, [1e-200, 0.0])]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (1, 3), 4: (1, 3), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8), 9: (2, 1)}


def test_deduplicated_documents_of_repeated_ids(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(1, shared), (2, f"{shared} alpha beta"), (2, f"gamma {shared} delta"), (2, "untouched text of its own"), (2, "untouched text of its own"), (None, shared), (3, shared)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.text) for r in substrings.deduplicated_documents(docs, window=50).collect())
    assert got == sorted([(0, shared), (1, shared), (2, "alpha beta"), (2, "gamma delta"), (2, "untouched text of its own"), (2, "untouched text of its own")])


def test_packing_deals_null_ids_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 100)
    docs = spark.createDataFrame([(None, "same text")] * 1500 + [(7, "other words")] * 1500, "doc_id long, text string")
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), sequence=64).collect()
    assert len(rows) == 3000
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in itertools.pairwise(spans))
