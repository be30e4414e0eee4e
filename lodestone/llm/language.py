"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import id_remainder
from lodestone.llm.textcore import CONTINUATION, batches, code_points, column_bytes, mix, released

DIMENSIONS, BITS = 1024, 16
UNDETERMINED = "und"
_HELD = 2
#: N-grams that are bundled at once, and those of a batch whose vectors are kept while its documents are bundled.
_RUN, _KEPT = 8192, 32_768


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each 16-bit code point: the lower-case letter or mark that stands for it, else 0; and whether it is a letter."""
    symbols, letters = np.zeros(1 << BITS, np.uint16), np.zeros(1 << BITS, bool)
    for c in range(1 << BITS):
        low = chr(c).lower()[:1]
        if unicodedata.category(low)[0] in "LM":
            symbols[c] = ord(low)
            letters[c] = low.isalpha()
    return symbols, letters


_SYMBOL, _LETTER = _tables()


def symbols_of(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the documents' code points, their bounds, and whether each document has a letter.

    Letters beyond 16 bits share the 2,048 numbers of the surrogates, which no text holds.
    """
    at = np.flatnonzero(~CONTINUATION[raw])
    bounds = np.searchsorted(at, docs)
    points = code_points(raw, at)
    far = points >= 1 << BITS
    near = np.where(far, 0, points)
    out, letter = _SYMBOL[near], _LETTER[near]
    if far.any():
        values, back = np.unique(points[far], return_inverse=True)
        known = np.array([v < 0x110000 and chr(v).isalpha() for v in values.tolist()])[back]
        out[far], letter[far] = np.where(known, 0xD800 + points[far] % 2048, 0), known
    letters = np.append(0, np.cumsum(letter))
    return out, bounds, letters[bounds[1:]] > letters[bounds[:-1]]


def gram_counts(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, trigram and count, in order. Runs of other characters are one edge, as are a document's start and end; each trigram has a letter in its middle."""
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    s, d = np.zeros(len(symbols) + n_docs + 1, np.uint64), np.zeros(len(symbols) + n_docs + 1, np.int64)
    place = np.arange(len(symbols)) + doc + 1
    s[place], d[place] = symbols, doc
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s, d = s[keep], d[keep]
    middle = np.flatnonzero(s > 0)
    used = np.flatnonzero(np.bincount(s.astype(np.int64), minlength=1))
    if n_docs * len(used) ** 3 < 1 << 62:  # a document and its trigram in one number, by the symbols that the batch has: one sort
        small = np.zeros(1 << BITS, np.int64)
        small[used] = np.arange(len(used))
        t = small[s.astype(np.int64)]
        key, count = np.unique(((d[middle] * len(used) + t[middle - 1]) * len(used) + t[middle]) * len(used) + t[middle + 1], return_counts=True)
        of, a, b, c = key // len(used) ** 3, *(used[key // len(used) ** k % len(used)].astype(np.uint64) for k in (2, 1, 0))
        return of, a << np.uint64(2 * BITS) | b << np.uint64(BITS) | c, count
    codes = s[middle - 1] << np.uint64(2 * BITS) | s[middle] << np.uint64(BITS) | s[middle + 1]
    distinct, back = np.unique(codes, return_inverse=True)
    key, count = np.unique(d[middle] * max(1, len(distinct)) + back, return_counts=True)
    return key // max(1, len(distinct)), distinct[key % max(1, len(distinct))], count


class Letters:
    """Random vectors of +1 and -1 of the symbols in some n-grams, from the symbols' numbers, and their rotations by one and two places."""

    def __init__(self, codes: np.ndarray):
        mask = np.uint64((1 << BITS) - 1)
        self.symbols = np.unique(np.concatenate([codes >> np.uint64(2 * BITS), codes >> np.uint64(BITS) & mask, codes & mask]))
        words = mix(self.symbols[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(1))
        signs = np.unpackbits(words.view(np.uint8).reshape(len(self.symbols), DIMENSIONS // 8), axis=1).astype(np.int8) * 2 - 1
        self.rotated = [np.roll(signs, k, axis=1) for k in range(3)]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """N-gram vectors: the product of the letters' vectors, each rotated by its distance from the end."""
        a, b, c = (np.searchsorted(self.symbols, codes >> np.uint64(BITS * k) & np.uint64((1 << BITS) - 1)) for k in (2, 1, 0))
        return self.rotated[2][a] * self.rotated[1][b] * self.rotated[0][c]

    def bundled(self, codes: np.ndarray, counts: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """The sum of the n-gram vectors, each as often as it was counted."""
        return _summed(lambda i: self.grams(codes[i : i + _RUN]), counts, kind)


def _summed(vectors: Callable[[int], np.ndarray], counts: np.ndarray, kind: type) -> np.ndarray:
    """The sum of vectors as often as they were counted; ``vectors(i)`` are _RUN of them from i."""
    total = np.zeros(DIMENSIONS, kind)
    for i in range(0, len(counts), _RUN):
        total += counts[i : i + _RUN].astype(kind) @ vectors(i).astype(kind)
    return total


class Bundles:
    """Documents' bundles within a batch: the vectors of its n-grams that most documents have are made once."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.letters, self.codes, self.counts = Letters(codes), codes, counts
        distinct, back = np.unique(codes, return_inverse=True)
        often = np.sort(np.argsort(-np.bincount(back, minlength=len(distinct)), kind="stable")[:_KEPT])
        self.kept = self.letters.grams(distinct[often])
        place = np.full(len(distinct), -1)
        place[often] = np.arange(len(often))
        self.place = place[back]

    def of(self, first: int, upto: int) -> np.ndarray:
        """The bundle of the n-grams of a document, which are these of the batch."""
        place, codes, counts = self.place[first:upto], self.codes[first:upto], self.counts[first:upto]
        rare = place < 0
        if not rare.any():
            return _summed(lambda i: self.kept[place[i : i + _RUN]], counts, np.float32)
        near = place[~rare]
        return _summed(lambda i: self.kept[near[i : i + _RUN]], counts[~rare], np.float32) + self.letters.bundled(codes[rare], counts[rare])


@released
def _profiles(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's n-gram vectors by language: whole numbers, so their sum over tasks is exact in any order."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches(stream, "text"):
        languages = np.array(batch.column("lang").to_pylist(), object)
        symbols, bounds, _ = symbols_of(*column_bytes(batch.column("text")))
        doc, codes, counts = gram_counts(symbols, bounds)
        letters = Letters(codes)
        for language in sorted(set(languages.tolist())):
            mine = (languages == language)[doc]
            distinct, back = np.unique(codes[mine], return_inverse=True)
            totals[language] = totals.get(language, 0) + letters.bundled(distinct, np.bincount(back, counts[mine], len(distinct)), np.float64)
    for language, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(total.astype(np.int64))], names=["lang", "i", "s"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from (lang, text). Spark sums the vectors of every text's n-grams; a language's 1,024 sums come to the driver."""
    sums = docs.mapInArrow(_profiles, "lang string, i long, s long").groupBy("lang", "i").agg(F.sum("s").alias("s")).toArrow()
    names, back = np.unique(np.array(sums["lang"].to_pylist(), str), return_inverse=True)
    vectors = np.zeros((len(names), DIMENSIONS))
    vectors[back, sums["i"].to_numpy()] = sums["s"].to_numpy()
    return names.tolist(), vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-30)[:, None]


def _predicted(languages: list[str], vectors: np.ndarray):
    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            symbols, bounds, lettered = symbols_of(*column_bytes(batch.column("text")))
            doc, codes, counts = gram_counts(symbols, bounds)
            bundles = Bundles(codes, counts)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            names, scores = [], []
            for d in range(batch.num_rows):
                if not lettered[d] or not languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = bundles.of(cuts[d], cuts[d + 1]).astype(np.float64)
                cosines = vectors @ total / max(np.linalg.norm(total), 1e-30)
                best = int(np.argmax(cosines))
                names.append(languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language whose prototype has the largest cosine with the document.

    Letters and marks of every script have random vectors of their own, upper case those of lower case; a trigram's vector binds its letters' rotated vectors, a text's
    bundles its trigrams'. Prototypes bundle all texts with a language whose crc32(id) modulo 4 is
    not 2 (held_out marks the others). Ties go to the language first in order. A text without a letter,
    null or empty, is ``und`` with score 0, and so is every text if nothing could be learned. Null
    languages teach nothing. Rows that repeat are judged each; other columns are not looked at.
    """
    held = id_remainder(id_column, 4) == _HELD
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    languages, vectors = prototypes(source.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    return source.select("doc_id", "held_out", "text").mapInArrow(_predicted(languages, vectors), "doc_id long, held_out boolean, lang_pred string, score double")
