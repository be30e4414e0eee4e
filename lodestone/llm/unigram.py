"""Token counts of a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that carries counts only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textcore import Words, batches, column_bytes, group_sums, released

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker remembers (16 bytes each).
REMEMBERED = 4_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model file with Zipf log-probabilities by rank; control, unknown and byte pieces left out.

    No unigram file is at hand: the public one is of another kind (its scores are merge ranks), so a piece of rank r gets
    ln(1 / (r + 1)) less ln of the sum over all. Counts by these scores are no published tokenizer's; ``token_counts``
    takes the pieces and scores of a real unigram model as a parameter.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return [(p, -math.log(r + 1) - total) for r, p in enumerate(pieces)]


class UnigramCounter:
    """Counts pieces of words as a unigram tokenizer does.

    Of several segmentations the one with the largest sum of scores counts; at equal sums, the one
    whose last piece began earlier. A character that is no piece itself may be unknown, at the
    smallest score less 10; unknown characters in a row are one token, or with ``byte_fallback`` one for each of their bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.forget()

    def forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int32)

    def count(self, word: str) -> tuple[int, int]:
        """Tokens and unknown tokens of one word, which begins with the space mark."""
        n = len(word)
        scores, counts, unknowns, open_ = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, best, length, single = 0, -math.inf, 0, False

        def settle(upto: int) -> None:
            nonlocal done, best, length, single
            while done < upto:
                end = done + 1
                chance = scores[done] + self.unknown
                if not single and chance > best:
                    joined = open_[done]
                    own = len(word[done].encode("utf-8", "replace")) if self.byte_fallback else not joined
                    scores[end], counts[end], unknowns[end], open_[end] = chance, counts[done] + own, unknowns[done] + (not joined), True
                else:
                    start = end - length
                    scores[end], counts[end], unknowns[end] = best, counts[start] + 1, unknowns[start]
                done, best, length, single = end, -math.inf, 0, False

        for last, (size, score) in self.automaton.iter(word):
            if last > done:
                settle(last)
            chance = scores[last + 1 - size] + score
            if chance > best or (chance == best and size > length):
                best, length = chance, size
            if size == 1:
                single = True
        settle(n)
        return counts[n], unknowns[n]

    def __call__(self, words: Words) -> np.ndarray:
        """Tokens and unknown tokens of every word; a word is looked at once and remembered by its hash."""
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        inside = at < len(self.hashes)
        new = np.ones(len(hashes), bool)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            data = words.raw.tobytes()
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)
            found = np.array([self.count(SPACE + data[a:b].decode("utf-8", "replace")) for a, b in spans], np.int32)
            self.hashes, self.counts = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.counts, at[new], found, axis=0)
            at = np.searchsorted(self.hashes, hashes)
        return self.counts[at][back]


_known: dict[tuple, UnigramCounter] = {}


def _counted(path: str | None, pieces: tuple[tuple[str, float], ...] | None, byte_fallback: bool):
    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, hash(pieces), byte_fallback)
        if key not in _known:
            _known.clear()
            _known[key] = UnigramCounter(list(pieces) if pieces is not None else vocabulary(path), byte_fallback)
        for batch in batches(stream, "text"):
            words = Words(*column_bytes(batch.column("text")))
            counts = _known[key](words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts()), pa.array(group_sums(counts[:, 0], words.bounds)), pa.array(group_sums(counts[:, 1], words.bounds))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )
        _known[key].forget()

    return run


def token_counts(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", pieces: list[tuple[str, float]] | None = None, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: how many pieces each text has under a unigram vocabulary.

    The vocabulary is ``pieces`` with their scores, or else that of a model file (see ``vocabulary``). Words
    ``[^\\x20\\x09-\\x0D]+`` are taken as they are, each with the space mark before it; pieces don't cross words. A
    character that is no piece counts as its UTF-8 bytes, or without ``byte_fallback`` a run of them as one; n_unknown
    counts runs. No token strings or ids are made. Null and empty texts have no tokens. Rows that repeat, and null ids,
    come back each. An empty table gives an empty result; other columns are not looked at.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    given = None if pieces is None else tuple((str(p), float(s)) for p, s in pieces)
    return source.mapInArrow(_counted(model_path, given, byte_fallback), "doc_id long, n_words long, n_tokens long, n_unknown long")
