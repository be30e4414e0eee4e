"""Language identification against a version that takes one document, trigram and vector at a time."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import language


def trigrams(text):
    """Trigrams of a text's letters and marks, in lower case; runs of all else, start and end are one edge."""
    known = [int(language._SYMBOL[ord(c)]) for c in text]
    line = [0, *known, 0]
    line = [s for i, s in enumerate(line) if not i or s or line[i - 1]]
    line += [0] if line[-1] else []
    return Counter(tuple(line[i - 1 : i + 2]) for i in range(1, len(line) - 1) if line[i])


def bundle(grams):
    total = np.zeros(language.DIMENSIONS)
    for gram, n in grams.items():
        bound = np.ones(language.DIMENSIONS)
        for distance, symbol in zip((2, 1, 0), gram):
            bound *= np.roll(language.Letters(np.array([symbol], np.uint64)).rotated[0][-1], distance)
        total += n * bound
    return total


@pytest.mark.parametrize("kept", [32_768, 5])
def test_identified_by_brute_force(spark, kept, monkeypatch):
    dice = random.Random(4)
    letters = {"a": "abcé", "b": "cdeÀ", "c": "жзи"}
    rows = [(i, "".join(dice.choice(letters[lang] + " ,1") for _ in range(dice.randrange(60))), lang) for i, lang in enumerate(dice.choice("abc") for _ in range(60))]
    rows += [(100, None, "a"), (101, "", "b"), (102, "12 ,.", "c"), (103, "Abc cab", None), (103, "Abc cab", None)]
    sums = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + bundle(trigrams(text or ""))
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    monkeypatch.setattr(language, "_KEPT", kept)
    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)).collect()
    assert len(found) == len(rows)
    want = {i: text for i, text, _ in rows}
    for r in found:
        mine = bundle(trigrams(want[r.doc_id] or ""))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in want[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {k: float(v @ mine / np.linalg.norm(mine)) for k, v in prototypes.items()}
        assert r.score == pytest.approx(max(0.0, max(cosines.values())), abs=1e-9) and cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-9)


@pytest.mark.parametrize("n,most", [(0, 5), (300, 6), (500, 65_536)])
def test_gram_counts(n, most):
    """Small and large alphabets: one sort over documents and trigrams, and two where they don't fit one number."""
    dice = np.random.default_rng(n)
    symbols, bounds = dice.integers(0, most, n).astype(np.uint16), np.sort(np.concatenate([[0, n], dice.integers(0, n + 1, 6)]))
    want = []
    for d in range(len(bounds) - 1):
        line = [0, *symbols[bounds[d] : bounds[d + 1]].tolist(), 0]
        line = [s for i, s in enumerate(line) if not i or s or line[i - 1]]
        line += [0] if line[-1] else []
        want += [(d, a << 32 | b << 16 | c, k) for (a, b, c), k in sorted(Counter(tuple(line[i - 1 : i + 2]) for i in range(1, len(line) - 1) if line[i]).items())]
    assert [tuple(map(int, x)) for x in zip(*language.gram_counts(symbols, bounds), strict=True)] == want
