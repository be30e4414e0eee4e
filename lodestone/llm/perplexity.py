"""Quality rules: document statistics and language-specific bands of n-gram perplexity.

The n-gram model is a modified Kneser-Ney model over code points. Spark counts all n-grams and gives each its
probability by joins with its context and its suffix; none is left out. The scores of frequent n-grams lie in one file
that every executor gets and its Python workers map into memory, so workers share the pages and a task touches the scores of its
own texts' languages alone; the few places of other n-grams meet their scores in a join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed
from lodestone.llm.textcore import CONTINUATION, SPACES, Words, batches, code_points, column_bytes, group_sums, mix, released, span_hashes, spans_hash, windows

ORDER, BITS = 4, 16
#: The edge of a word, which also stands before a text.
EDGE = 0x20
#: Documents with fewer words fail; they teach the model all the same.
LEAST_WORDS = 20
#: N-grams that are one in this many of all symbols or more have their scores in the file, so this many at most; those of the others come by a join.
FILED = 1 << 21
#: A language's texts fall in two halves; each is judged by what the other taught.
HALVES = 2
#: A symbol is bursty in under this share of the documents that its count would reach if it were spread evenly.
SPREAD = 0.25
#: The quartiles of held-out perplexity say no less than this share of a symbol's deviation, so texts that are alike make no narrow band.
LEAST_SPREAD = 0.5
#: Tasks among which a language's rows are dealt where they meet what is known of the language.
SALTS = 64
#: A language with fewer distinct texts that pass the base rules has no bands.
LEAST_TEXTS = 40
#: Text that a task works on at once.
BATCH_BYTES = 1 << 20
#: N-grams that a counting task holds before it sends them on.
HELD_GRAMS = 1 << 19
#: Kinds of counted rows: n-grams; documents that have a symbol; documents by size, two bins for each power of two.
GRAMS, HAVING, SIZES = 0, 1, 2
#: More kinds, of rows that build a model: what a context's n-grams have that aren't stored; counts of counts.
REST, COUNTS = 3, 4
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>"]] = True


def _fold_table() -> np.ndarray:
    """Each 16-bit code point's symbol: its lower-case letter where that is one such code point; all ASCII digits are 0."""
    out = np.arange(1 << BITS, dtype=np.uint16)
    for c in range(1 << BITS):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < 1 << BITS:
            out[c] = ord(low)
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_FOLD = _fold_table()


def folded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (16 bits) of all documents and their bounds: the words' code points, an edge before each word and after the last.

    Code points beyond 16 bits share the 2,048 numbers of the surrogates, which no text holds.
    """
    raw = words.raw
    keep = ~SPACES[raw] & ~CONTINUATION[raw]
    edges = np.zeros(len(raw), np.int32)
    edges[words.starts] = 1
    # A word's first byte brings an edge; places of symbols follow from running sums.
    ends = np.cumsum(keep + edges)
    last = (words.counts() > 0).astype(np.int64)
    extra = np.append(0, np.cumsum(last))
    bounds = np.append(0, ends)[words.docs] + extra
    out = np.full(int(bounds[-1]), EDGE, np.uint16)
    at = np.flatnonzero(keep)
    points = code_points(raw, at)
    points = np.where(points < 1 << BITS, points, 0xD800 + points % 2048)
    shift = np.repeat(extra[:-1], np.diff(words.docs))
    out[ends[at] - 1 + shift[at]] = _FOLD[points]
    return out, bounds


def gram_codes(symbols: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (at most 4 symbols) that ends at each symbol, as one number; before a document's start are edges. Also which document each is of."""
    sizes = np.diff(bounds)
    into = np.arange(len(symbols), dtype=np.int32 if len(symbols) < 2**31 else np.int64)
    into -= np.repeat(bounds[:-1], sizes).astype(into.dtype)
    codes = symbols.astype(np.uint64)
    for back in range(1, order):
        earlier = np.full(len(symbols), EDGE, np.uint64)
        earlier[back:] = symbols[: len(symbols) - back]
        earlier[into < back] = EDGE
        codes |= earlier << np.uint64(BITS * back)
    return codes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def halves(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The half of each document: a bit of the least hash of its three-word windows, which copies and most near copies share."""
    grams, at = windows(hashes, words.bounds, 3)
    counts = words.counts()
    out = spans_hash(hashes, words.bounds)
    some = np.flatnonzero(counts >= 3)
    if len(some):
        out[some] = np.minimum.reduceat(grams, np.searchsorted(at, words.bounds[:-1][some]))
    return (mix(out) >> np.uint64(63)).astype(np.int64)


def _languages(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def _grouped(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, list[tuple[str, int]], np.ndarray]:
    """A batch's words and their hashes; the (language, half) that occur, and which of them each document has."""
    words = Words(*column_bytes(batch.column("text")))
    hashes = words.hashes()
    pairs = list(zip(_languages(batch.column("lang")), halves(words, hashes).tolist(), strict=True))
    names = sorted(set(pairs))
    place = {name: i for i, name in enumerate(names)}
    return words, hashes, names, np.array([place[p] for p in pairs], np.int64)


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of distinct codes with the sums of their counts."""
    codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(codes)
    codes = codes[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


_COUNTS = "lang string, half long, kind int, gram long, n long"


def _counted(order: int):
    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for (language, half, kind), parts in held.items():
            codes, counts = added_up(parts)
            one = lambda x, t: pa.array(np.full(len(codes), x), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), one(half, pa.int64()), one(kind, pa.int32()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "half", "kind", "gram", "n"])
        held.clear()

    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = pending = 0
        for batch in batches(stream, "text", BATCH_BYTES):
            words, _, names, group = _grouped(batch)
            symbols, bounds = folded(words)
            codes, doc = gram_codes(symbols, bounds, order)
            having = np.unique(doc.astype(np.uint64) << np.uint64(BITS) | symbols)
            lengths = np.diff(bounds)
            for g, (language, half) in enumerate(names):
                mine = group == g
                bins = (2 * np.log2(lengths[mine & (lengths > 0)])).astype(np.uint64)
                for kind, values in ((GRAMS, codes[mine[doc]]), (HAVING, having[mine[(having >> np.uint64(BITS)).astype(np.int64)]] & np.uint64((1 << BITS) - 1)), (SIZES, bins)):
                    found = np.unique(values, return_counts=True)
                    held.setdefault((language, half, kind), []).append(found)
                    pending += len(found[0])
            if pending > HELD_GRAMS:
                held = {k: [added_up(parts)] for k, parts in held.items()}
                size, pending = sum(len(p[0][0]) for p in held.values()), 0
                if size > HELD_GRAMS:
                    yield from sent(held)
        yield from sent(held)

    return run


def _evenness(counts: np.ndarray, having: np.ndarray, bins: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """What part of each count the number of documents that have it explains: 1, or less for a bursty one (see ``evenness``)."""
    each = 2 ** ((bins + 0.5) / 2)
    share = each / (each * documents).sum()
    grid = np.append(0, np.geomspace(0.01, max(1, counts.max(initial=0)) * 1.001, 600))
    reached = sum(n * -np.expm1(-grid * s) for n, s in zip(documents, share, strict=True))
    bursty = (counts > 0) & (having < SPREAD * np.interp(counts, grid, reached))
    out = np.ones(len(counts))
    out[bursty] = np.minimum(1, np.interp(having[bursty], reached, grid) / counts[bursty])
    return out


def evenness(symbols: np.ndarray, counts: np.ndarray, having: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What part of its probability each symbol teaches.

    Every document counts. But what stands often in few documents and nowhere in the others (a mark behind each word) is
    no habit of the language: where the documents with a symbol are fewer than a quarter of those that its count would
    reach if it were spread evenly over all text, n-grams with it teach as if it were as frequent everywhere as the number
    of documents that have it implies, and the rest of their probability goes to shorter n-grams. What most documents have
    keeps its probability, whatever it is. ``having``: symbols (sorted) and the documents that have them; ``sizes``: bins and
    how many texts have a size of each.
    """
    at = np.searchsorted(having[0], symbols)
    return _evenness(counts, having[1][at], sizes[0].astype(float), sizes[1]) if len(symbols) else np.ones(0)


def least_even(grams: np.ndarray, symbols: np.ndarray, even: np.ndarray, order: int) -> np.ndarray:
    """The least evenness of each n-gram's symbols."""
    out = np.ones(len(grams))
    for back in range(order if len(symbols) else 0):
        symbol = grams >> np.uint64(BITS * back) & np.uint64((1 << BITS) - 1)
        at = np.minimum(np.searchsorted(symbols, symbol), len(symbols) - 1)
        out = np.minimum(out, np.where(symbols[at] == symbol, even[at], 1))
    return out


def level_hashes(codes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of n-grams of one length (level n) or of contexts that back off (level order + n)."""
    return mix(mix(codes) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))


@dataclass
class HashModel:
    """Log10 probabilities of n-grams of all orders in one array of hashes, sorted; back-off weights beside them.

    ``jump`` holds where hashes with each value of their leading bits begin, so a look-up touches a few places.
    """

    order: int
    hashes: np.ndarray
    log_p: np.ndarray
    back_off: np.ndarray
    jump: np.ndarray
    probes: int
    floor: float

    PARTS = (("hashes", np.uint64), ("log_p", np.float32), ("back_off", np.float32), ("jump", np.int32))

    @classmethod
    def build(cls, order: int, hashes: np.ndarray, log_p: np.ndarray, back_off: np.ndarray, floor: float) -> HashModel:
        """floor: log10 probability of a symbol that was never seen."""
        at = np.argsort(hashes)
        bits = max(1, int(len(hashes)).bit_length())
        jump = np.searchsorted(hashes[at] >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)
        return cls(order, hashes[at], log_p[at].astype(np.float32), back_off[at].astype(np.float32), jump, int(np.diff(jump).max(initial=0)), floor)

    def stored(self) -> bytes:
        return b"".join(np.ascontiguousarray(getattr(self, name)).tobytes() for name, _ in self.PARTS)

    @classmethod
    def mapped(cls, path: str, offset: int, order: int, entries: int, jumps: int, probes: int, floor: float) -> HashModel:
        """The model at ``offset`` of a file, which is mapped and not read."""
        arrays = []
        for (_, kind), n in zip(cls.PARTS, (entries, entries, entries, jumps), strict=True):
            arrays.append(np.memmap(path, kind, "r", offset, (n,)) if n else np.zeros(0, kind))
            offset += n * np.dtype(kind).itemsize
        return cls(order, *arrays, probes, floor)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        bits = max(1, (len(self.jump) - 1).bit_length() - 1)
        lead = (wanted >> np.uint64(64 - bits)).astype(np.int64)
        at, end = self.jump[lead], self.jump[lead + 1]
        found = np.full(len(wanted), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        for _ in range(self.probes):
            hit = self.hashes[at[open_]] == wanted[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return found

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of the last symbol of each n-gram given those before it, with back-off."""
        out = np.zeros(len(codes), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            part = lower_order(codes[left], n)
            at = self.find(level_hashes(part, n))
            known = at >= 0
            out[left[known]] += self.log_p[at[known]]
            left, part = left[~known], part[~known]
            if n > 1 and len(left):
                context = self.find(level_hashes(part >> np.uint64(BITS), self.order + n))
                out[left] += np.where(context >= 0, self.back_off[np.maximum(context, 0)], 0)
        out[left] += np.float32(self.floor)
        return out


def lower_order(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of n-grams."""
    return codes & np.uint64(2 ** (BITS * n) - 1)


@dataclass
class Level:
    """The n-grams of one length (sorted) that a model stores, and what is known of all.

    ``counts``: occurrences at the highest order, below it the different symbols before an n-gram, over the whole corpus.
    ``share``: the part of each n-gram's probability that it teaches. ``rest``: contexts (sorted) and the counts of their n-grams
    that aren't stored. ``of_counts``: how many n-grams, stored or not, have a count of 1, 2, 3 and 4.
    """

    codes: np.ndarray
    counts: np.ndarray
    share: np.ndarray
    rest: tuple[np.ndarray, np.ndarray]
    of_counts: np.ndarray

    def discounts(self) -> np.ndarray:
        return discounts(self.of_counts)


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2, and 3 or more lose; 0.75 where a count of counts is zero."""
    n1, n2, n3, n4 = (float(n) for n in of_counts)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = np.array([0.0, *(k - (k + 1) * y * b / a if a and y else 0.75 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])
    d[1:] = np.clip(d[1:], 0.01, [0.99, 1.99, 2.99])
    return d


def kneser_ney(levels: list[Level]) -> HashModel:
    """A modified Kneser-Ney model (Chen and Goodman, 1998) from its levels, shortest n-grams first.

    Discounts and the totals of contexts are those of all n-grams, stored or not: what an n-gram that isn't stored has, and what an
    uneven one doesn't teach, is its context's back-off weight, so probabilities sum to one. A suffix of a stored n-gram is stored.
    The lowest order shares its discounts among all 2**16 symbols.
    """
    order = len(levels)
    hashes, logs, backs = [], [], []
    lower, lower_codes = np.full(1, 2.0**-BITS), np.zeros(1, np.uint64)
    floor = 2.0**-BITS
    for n, level in enumerate(levels, 1):
        codes = level.codes
        contexts, place = np.unique(codes >> np.uint64(BITS), return_inverse=True)
        totals = np.bincount(place, level.counts, len(contexts))
        if len(contexts) and len(level.rest[0]):
            at = np.minimum(np.searchsorted(level.rest[0], contexts), len(level.rest[0]) - 1)
            totals += np.where(level.rest[0][at] == contexts, level.rest[1][at], 0)
        own = level.share * (level.counts - level.discounts()[np.minimum(level.counts, 3)]) / totals[place]
        gamma = np.maximum(1 - np.bincount(place, own, len(contexts)), 1e-12)
        p = own + gamma[place] * (lower[np.searchsorted(lower_codes, lower_order(codes, n - 1))] if n > 1 else lower[0])
        hashes.append(level_hashes(codes, n))
        logs.append(np.log10(p))
        backs.append(np.zeros(len(codes)))
        if n == 1:
            floor = (gamma[0] if len(gamma) else 1.0) * 2.0**-BITS
        else:  # the back-off weights of order n have hashes of their own
            hashes.append(level_hashes(contexts, order + n))
            logs.append(np.zeros(len(contexts)))
            backs.append(np.log10(gamma))
        lower, lower_codes = p, codes
    return HashModel.build(order, np.concatenate(hashes), np.concatenate(logs), np.concatenate(backs), float(np.log10(floor)))


_BUILT = "lang string, half long, entries long, jumps long, probes long, floor double, model binary"


def _built(order: int, spread: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The model that one half of a language teaches, from the n-grams that ``model_rows`` stores."""
        kind, level = rows["kind"].to_numpy(), rows["level"].to_numpy()
        gram, n, c = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy(), rows["c"].to_numpy()

        def of(k: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = np.flatnonzero((kind == k) & (level == at))
            mine = mine[np.argsort(gram[mine])]
            return gram[mine], n[mine], c[mine]

        symbols, occurrences, _ = of(GRAMS, 1)
        even = evenness(symbols, occurrences, of(HAVING, 0)[:2], of(SIZES, 0)[:2]) if spread else np.ones(len(symbols))
        levels = []
        for at in range(1, order + 1):
            codes, _, counts = of(GRAMS, at)
            contexts, _, rest = of(REST, at)
            k, _, number = of(COUNTS, at)
            of_counts = np.zeros(5, np.int64)
            of_counts[k.astype(np.int64)] = number
            levels.append(Level(codes, counts, least_even(codes, symbols, even, at), (contexts, rest), of_counts[1:]))
        model = kneser_ney(levels)
        values = [key[0].as_py(), key[1].as_py(), len(model.hashes), len(model.jump), model.probes, model.floor, model.stored()]
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_ARROW_BUILT, values, strict=True)})

    return run


_ARROW_BUILT = pa.schema([("lang", pa.string()), ("half", pa.int64()), ("entries", pa.int64()), ("jumps", pa.int64()), ("probes", pa.int64()), ("floor", pa.float64()), ("model", pa.binary())])


@dataclass
class StoredModels:
    """Models in a file that Spark has sent to every executor, by language and the half that taught them."""

    name: str
    places: dict[tuple[str, int], tuple[int, int, int, int, float]]
    order: int

    def of(self, language: str, half: int) -> HashModel | None:
        place = self.places.get((language, half))
        if place is None:
            return None
        offset, entries, jumps, probes, floor = place
        return HashModel.mapped(SparkFiles.get(self.name), offset, self.order, entries, jumps, probes, floor)


def model_rows(counts: DataFrame, order: int, most_grams: int) -> DataFrame:
    """lang, half, kind, level, gram, n, c: what each model is built from, of rows counted by ``_counted``.

    For models of a bounded size alone; no query uses it. GRAMS: the n-grams of each length (level) that occur n times, one in ``most_grams`` of their
    language's and half's symbols or more, and their Kneser-Ney counts c. REST: of each context of these, what its other n-grams count. COUNTS: how many
    n-grams, stored or not, count 1 to 4. HAVING and SIZES as they are.
    """
    grams = counts.where(F.col("kind") == GRAMS).select("lang", "half", "gram", "n", F.col("n").alias("c"))
    levels = [grams.withColumn("level", F.lit(order))]
    for n in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(2 ** (BITS * n) - 1)).alias("gram")
        grams = checkpointed(grams.groupBy("lang", "half", suffix).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")))
        levels.append(grams.withColumn("level", F.lit(n)))
    # Totals meet their n-grams by a salted key, so that one language isn't one task.
    totals = grams.groupBy("lang", "half").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = reduce(DataFrame.unionByName, levels).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS).cast("long"))).join(totals, ["lang", "half", "salt"])
    found = found.withColumn("stored", F.col("n").cast("double") * most_grams >= F.col("total"))
    rest = found.groupBy("lang", "half", "level", F.shiftrightunsigned("gram", BITS).alias("gram")).agg(F.sum(F.when(~F.col("stored"), F.col("c"))).alias("c"), F.max("stored").alias("stored"))
    rest = rest.where("stored and c is not null").withColumn("kind", F.lit(REST)).withColumn("n", F.lit(0).cast("long"))
    few = found.groupBy("lang", "half", "level").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)])
    few = few.select("lang", "half", F.lit(COUNTS).alias("kind"), "level", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("gram"), F.lit(0).cast("long").alias("n"), F.col(f"n{k}").alias("c")) for k in range(1, 5)])).alias("r")).select("lang", "half", "kind", "level", "r.*")
    columns = ["lang", "half", "kind", "level", "gram", "n", "c"]
    others = counts.where(F.col("kind") != GRAMS).withColumn("level", F.lit(0)).withColumn("c", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, [df.select(columns) for df in (found.where("stored").withColumn("kind", F.lit(GRAMS)), rest, few, others)])


def language_models(docs: DataFrame, order: int = ORDER, *, most_grams: int, spread: bool = True) -> StoredModels:
    """Models that score any text, of each language of ``docs`` (lang, text), one taught by each half of its texts.

    They are cut to a size: n-grams rarer than one in ``most_grams`` of their language's and half's symbols go to the back-off
    weights (see ``model_rows``). What judges the texts of ``docs`` themselves leaves nothing out: see ``text_scores``.
    With ``spread``, what only a few documents are full of teaches less (see ``evenness``). A task builds one model.
    """
    kept = model_rows(gram_counts(docs, order), order, most_grams)
    built = kept.groupBy("lang", "half").applyInArrow(_built(order, spread), _BUILT)
    return StoredModels(*_sent(docs.sparkSession, built, ["entries", "jumps", "probes", "floor"]), order)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, half, kind, gram, n: the n-grams of every document, the documents that have a symbol, the documents by size."""
    return checkpointed(docs.mapInArrow(_counted(order), _COUNTS).groupBy("lang", "half", "kind", "gram").agg(F.sum("n").alias("n")))


def _sent(spark: SparkSession, rows: DataFrame, columns: list[str]) -> tuple[str, dict[tuple[str, int], tuple]]:
    """A file of the rows' ``model``, which Spark hands to the executors, and where each language and half lies in it, with ``columns``.

    The driver takes one partition of rows at a time to write it.
    """
    name, places, offset = f"models-{uuid.uuid4().hex}.bin", {}, 0
    path = Path(tempfile.mkdtemp(prefix="lodestone-")) / name  # the driver's own copy; executors get theirs from Spark
    with path.open("wb") as out:
        for r in checkpointed(rows).toLocalIterator():
            places[r["lang"], r["half"]] = offset, *(r[c] for c in columns)
            out.write(r["model"])
            out.write(b"\0" * (-len(r["model"]) % 8))
            offset = out.tell()
    spark.sparkContext.addFile(str(path))
    return name, places


_PAIR = range(HALVES)


def gram_levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """For each length, shortest first: lang, gram, how often it occurs in each half (n0, n1), and its Kneser-Ney counts there (c0, c1)."""
    grams = counts.where(F.col("kind") == GRAMS).groupBy("lang", "gram").agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"n{h}") for h in _PAIR])
    levels = [checkpointed(grams.select("*", *[F.col(f"n{h}").alias(f"c{h}") for h in _PAIR]))]
    for n in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit(2 ** (BITS * n) - 1)).alias("gram")
        levels.insert(0, checkpointed(levels[0].groupBy("lang", suffix).agg(*[F.sum(f"n{h}").alias(f"n{h}") for h in _PAIR], *[F.count_if(F.col(f"n{h}") > 0).alias(f"c{h}") for h in _PAIR])))
    return levels


_SYMBOLS = "lang string, gram long, q0 double, q1 double, share0 double, share1 double"


def _symbols(spread: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Of a language's symbols (at most 2**16): their probability in the model of each half, and the part of it that they teach."""
        half, kind = rows["half"].to_numpy(), rows["kind"].to_numpy()
        gram, n, c = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy(), rows["c"].to_numpy()

        def of(k: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = np.flatnonzero((kind == k) & (half == h))
            mine = mine[np.argsort(gram[mine])]
            return gram[mine], n[mine], c[mine]

        every = np.unique(gram[kind == GRAMS])
        q, share = np.full((HALVES, len(every)), np.nan), np.ones((HALVES, len(every)))
        for h in _PAIR:
            symbols, occurrences, counts = of(GRAMS, h)
            if not len(symbols):
                continue  # no text, no model
            at = np.searchsorted(every, symbols)
            if spread:
                share[h, at] = evenness(symbols, occurrences, of(HAVING, h)[:2], of(SIZES, h)[:2])
            own = share[h, at] * (counts - discounts(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])[np.minimum(counts, 3)]) / counts.sum()
            q[h] = max(1 - own.sum(), 1e-12) * 2.0**-BITS
            q[h, at] += own
        columns = [pa.array([key[0].as_py()] * len(every), pa.string()), pa.array(every.view(np.int64)), *(pa.array(x, from_pandas=True) for x in q), *map(pa.array, share)]
        return pa.table(columns, names=["lang", "gram", "q0", "q1", "share0", "share1"])

    return run


def _discounts(c: str) -> Column:
    """As ``discounts``, of counts 1, 2, and 3 or more: an aggregate."""
    n = [F.count_if(F.col(c) == k).cast("double") for k in range(1, 5)]
    y = F.nullif(F.try_divide(n[0], n[0] + 2 * n[1]), F.lit(0.0))
    return F.array(*[F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(n[k], n[k - 1]), F.lit(0.75)), F.lit(0.01)), F.lit(k - 0.01)) for k in range(1, 4)])


def interpolated(level: DataFrame, lower: DataFrame, n: int) -> DataFrame:
    """The n-grams of one length with their probability in the model of each half (q0, q1; null: no model) and the part of it that they teach.

    ``lower``: the same of n-grams one shorter; every suffix and every context is among these. A context and a suffix has at most
    2**16 n-grams, so no key of these joins and of the window is more than that.
    """
    salt = F.pmod(F.xxhash64("gram"), F.lit(SALTS).cast("long"))  # so that one language isn't one task
    known = level.groupBy("lang").agg(*[_discounts(f"c{h}").alias(f"d{h}") for h in _PAIR]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = level.withColumn("salt", salt).join(known, ["lang", "salt"]).withColumn("suffix", F.col("gram").bitwiseAND(F.lit(2 ** (BITS * (n - 1)) - 1))).withColumn("context", F.shiftrightunsigned("gram", BITS))
    rows = rows.join(lower.select("lang", F.col("gram").alias("suffix"), *[F.col(f"q{h}").alias(f"lower{h}") for h in _PAIR], *[F.col(f"share{h}").alias(f"last{h}") for h in _PAIR]), ["lang", "suffix"])
    rows = rows.join(lower.select("lang", F.col("gram").alias("context"), *[F.col(f"share{h}").alias(f"first{h}") for h in _PAIR]), ["lang", "context"])
    for h in _PAIR:
        c = F.col(f"c{h}")
        rows = rows.withColumn(f"share{h}", F.least(f"first{h}", f"last{h}"))
        rows = rows.withColumn(f"own{h}", F.when(c > 0, F.col(f"share{h}") * (c - F.get(f"d{h}", F.least(c, F.lit(3)).cast("int") - 1))).otherwise(0.0))
    context = Window.partitionBy("lang", "context")
    rows = rows.select("*", *[F.nullif(F.sum(f"c{h}").over(context), F.lit(0)).alias(f"total{h}") for h in _PAIR], *[F.sum(f"own{h}").over(context).alias(f"taught{h}") for h in _PAIR])
    part = lambda x, h: F.coalesce(F.col(f"{x}{h}") / F.col(f"total{h}"), F.lit(0.0))  # noqa: E731  (a context that the half never had teaches nothing)
    q = [(part("own", h) + F.greatest(1 - part("taught", h), F.lit(1e-12)) * F.col(f"lower{h}")).alias(f"q{h}") for h in _PAIR]
    return rows.select("lang", "gram", *[f"n{h}" for h in _PAIR], *q, *[f"share{h}" for h in _PAIR])


_FILED = "lang string, half long, entries long, model binary"


def _filed(key: tuple, rows: pa.Table) -> pa.Table:
    """Sorted n-grams and their scores, one array behind the other; a score without a model is NaN."""
    grams, scores = rows["gram"].to_numpy().view(np.uint64), rows["score"].to_numpy()
    at = np.argsort(grams)
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([grams[at].tobytes() + scores[at].astype(np.float64).tobytes()], pa.binary())], names=["lang", "half", "entries", "model"])


@dataclass
class FiledScores:
    """Scores of frequent n-grams in a file that Spark has sent to every executor, by language and the half whose texts they score."""

    name: str
    places: dict[tuple[str, int], tuple[int, int]]

    def of(self, language: str, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams and their scores, mapped and not read."""
        offset, entries = self.places.get((language, half), (0, 0))
        if not entries:
            return np.zeros(0, np.uint64), np.zeros(0)
        path = SparkFiles.get(self.name)
        return np.memmap(path, np.uint64, "r", offset, (entries,)), np.memmap(path, np.float64, "r", offset + 8 * entries, (entries,))


def text_scores(docs: DataFrame, order: int = ORDER, spread: bool = True, most_filed: int = FILED) -> tuple[FiledScores, DataFrame]:
    """The score of each n-gram of ``docs`` (lang, text): log10 of its last symbol's probability under what the other half of its language teaches.

    All n-grams of all lengths teach, however rare. Scores of those that are one in ``most_filed`` of all symbols or more lie in a
    file; the others are rows: lang, half (of the text), gram, score. Where the other half has no text the score is null.
    """
    counts = gram_counts(docs, order)
    levels = gram_levels(counts, order)
    halves_of = [levels[0].where(F.col(f"n{h}") > 0).select("lang", F.lit(h).cast("long").alias("half"), F.lit(GRAMS).alias("kind"), "gram", F.col(f"n{h}").alias("n"), F.col(f"c{h}").alias("c")) for h in _PAIR]
    others = counts.where(F.col("kind") != GRAMS).withColumn("c", F.lit(0).cast("long"))
    known = checkpointed(reduce(DataFrame.unionByName, [*halves_of, others]).groupBy("lang").applyInArrow(_symbols(spread), _SYMBOLS))
    for n, level in enumerate(levels[1:], 2):
        known = checkpointed(interpolated(level, known, n))
    total = levels[0].agg(F.sum(reduce(Column.__add__, [F.col(f"n{h}") for h in _PAIR]))).first()[0] or 0
    each = [F.struct(F.lit(h).cast("long").alias("half"), F.col(f"n{h}").alias("n"), F.log10(f"q{1 - h}").alias("score")) for h in _PAIR]
    scores = known.select("lang", "gram", F.explode(F.array(*each)).alias("r")).select("lang", "r.half", "gram", "r.n", "r.score").where("n > 0")
    frequent = F.col("n").cast("double") * most_filed >= total
    filed = scores.where(frequent).select("lang", "half", "gram", F.coalesce("score", F.lit(float("nan"))).alias("score")).groupBy("lang", "half").applyInArrow(_filed, _FILED)
    return FiledScores(*_sent(docs.sparkSession, filed, ["entries"])), scores.where(~frequent).drop("n")


def statistics(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each document; see ``judged``."""
    raw, docs = words.raw, words.docs
    n_docs = len(docs) - 1
    visible = ~SPACES[raw] & ~CONTINUATION[raw]
    counts = words.counts()

    # Lines end at \n or at the document's end; only lines with a word count.
    cuts = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([docs[:-1], cuts + 1]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    ends = np.where((ends > 0) & (raw[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(docs, starts, "right") - 1
    lines = span_hashes(raw, starts, ends)
    key = mix(lines + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(line_doc[np.unique(key, return_index=True)[1]], minlength=n_docs)

    grams, at = windows(hashes, words.bounds, 8)
    owner = np.repeat(np.arange(n_docs), counts)
    key = mix(grams + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    return {
        "n_words": counts,
        "word_chars": group_sums(visible, docs),
        "n_symbols": group_sums(_MARK[raw], docs),
        "n_dup_lines": np.bincount(line_doc, minlength=n_docs) - distinct,
        "n_repeat_words": group_sums(np.cumsum(cover)[:-1] > 0, words.bounds),
    }



_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCORES = f"doc_id long, lang string, half long, {_FIGURES}, logs double, squares double, text_key long, n_scored long, rest array<long>, times array<long>"


def _rare(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Each document's distinct n-grams among ``codes``, and how often it has each."""
    at = np.lexsort((codes, doc))
    codes, doc = codes[at], doc[at]
    heads = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1]))) if len(codes) else np.zeros(0, np.int64)
    ends = np.searchsorted(doc[heads], np.arange(n_docs + 1)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return lists(codes[heads].view(np.int64)), lists(np.diff(np.append(heads, len(codes))))


def _scored(filed: FiledScores, order: int):
    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches(stream, "text", BATCH_BYTES):
            words, hashes, names, group = _grouped(batch)
            figures = statistics(words, hashes)
            symbols, bounds = folded(words)
            codes, doc = gram_codes(symbols, bounds, order)
            sizes = np.diff(bounds)
            logs, squares = np.zeros((2, len(sizes)))
            rare = np.zeros(len(codes), bool)
            for g, name in enumerate(names):
                if name not in known:
                    known[name] = filed.of(*name)
                grams, scores = known[name]
                mine, inside = np.flatnonzero(group == g), np.flatnonzero((group == g)[doc])
                distinct, place = np.unique(codes[inside], return_inverse=True)
                at = np.searchsorted(grams, distinct)
                found = at < len(grams)
                found[found] = grams[at[found]] == distinct[found]
                score = np.zeros(len(distinct))
                score[found] = scores[at[found]]
                rare[inside] = ~found[place]
                each = score[place]
                ends = np.cumsum(sizes[mine])
                for out, values in ((logs, each), (squares, each**2)):
                    sums = np.append(0, np.cumsum(values))
                    out[mine] = sums[ends] - np.append(0, sums[ends[:-1]])
            keys = span_hashes(words.raw, words.docs[:-1], words.docs[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_languages(batch.column("lang"))), pa.array(np.array([half for _, half in names], np.int64)[group]), *(pa.array(x.astype(np.int64)) for x in figures.values()), pa.array(logs, from_pandas=True), pa.array(squares, from_pandas=True), pa.array(keys), pa.array(np.maximum(sizes, 1).astype(np.int64)), *_rare(codes[rare], doc[rare], len(sizes))],
                names=["doc_id", "lang", "half", *figures, "logs", "squares", "text_key", "n_scored", "rest", "times"],
            )

    return run


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, most_filed: int = FILED, spread: bool = True) -> DataFrame:
    """Every document's base figures and its perplexity under what the other half of its language's texts teaches.

    A task adds up what the file of frequent n-grams says; a document's other n-grams meet their scores in a join. ``most_filed``
    says how many go which way, and changes no result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    filed, others = text_scores(source.select("lang", "text"), order, spread, most_filed)
    first = checkpointed(source.mapInArrow(_scored(filed, order), _SCORES).withColumn("row", F.monotonically_increasing_id()))
    rest = first.where(F.size("rest") > 0).select("row", "lang", "half", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", "lang", "half", F.col("r.rest").alias("gram"), "r.times")
    more = rest.join(others, ["lang", "half", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("more"), F.sum(F.col("times") * F.col("score") ** 2).alias("more_squares"))
    all_of = lambda part, other: (F.col(part) + F.when(F.size("rest") > 0, F.col(other)).otherwise(0.0)) / F.col("n_scored")
    rows = first.join(more, "row", "left").withColumn("mean", all_of("logs", "more")).withColumn("variance", np.log(10) ** 2 * F.greatest(all_of("squares", "more_squares") - F.col("mean") ** 2, F.lit(0.0)))
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    figures = [x.split()[0] for x in _FIGURES.split(", ")]
    found = rows.select("doc_id", "lang", *figures, F.pow(F.lit(10.0), -F.col("mean")).alias("perplexity"), "text_key", "n_scored", "variance")
    return checkpointed(found.withColumn("base_failed", failed).withColumn("log", F.ln("perplexity")))


def _deviation(below: bool, noise: Column, width: float, floor: float) -> Column:
    """``width`` deviations: the sampling error of the text's length by the language's own quartile, and ``floor``."""
    quartile = (F.col("t")[1] - F.col("t")[0] if below else F.col("t")[2] - F.col("t")[1]) / 0.6745
    return width * F.sqrt(F.pow(F.greatest(quartile, F.lit(LEAST_SPREAD)), F.lit(2)) * noise / F.col("n_scored") + floor**2)


def judged(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", below: float = 3.5, above: float = 6.0, floor_below: float = 0.02, floor_above: float = 0.05, least_texts: int = LEAST_TEXTS, order: int = ORDER, most_filed: int = FILED, spread: bool = True
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high.

    n_words: words of the text; word_chars: code points in them; n_symbols: characters of [#*$%&|<>];
    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words inside 8-word
    windows that occur twice or more. base_failed: fewer than 20 words, or over 30 % repeated words.
    Of the other documents those are kept whose perplexity lies in their language's band.

    A language's texts fall in two halves by a hash of their words that copies share, and most near
    copies; each text is judged by the model of the other half, so its perplexity is held out and no
    group of copies is learnt by heart. Every document with a word teaches, those that fail the base
    rules too. The band reaches from the language's median log perplexity, over distinct texts that pass
    the base rules, ``below`` deviations down and ``above`` up. A deviation joins what is natural for the
    text's length (the quartiles of held-out log perplexity in units of a symbol's median deviation over
    the root of the number of symbols, on either side) with ``floor_below`` and ``floor_above``.

    A language without a word in the other half has no model, and one with fewer than ``least_texts``
    distinct texts that pass has no band; their documents keep what the base rules say.

    A null text is empty (0 words, base_failed); a null language is a language of its own. Rows that
    repeat count each. An empty table gives an empty result; other columns are not looked at.
    """
    rows = scored(docs, id_column, text_column, lang_column, order, most_filed, spread)
    passed = rows.where("not base_failed and log is not null").groupBy("lang", "text_key").agg(F.first("log").alias("log"), F.first("variance").alias("variance"), F.first("n_scored").alias("n_scored"))
    # Few rows in each of these: one for a language, found by mergeable sketches.
    centre = passed.groupBy("lang").agg(F.percentile_approx("log", 0.5, 100_000).alias("middle"), F.percentile_approx("variance", 0.5, 100_000).alias("noise"), F.count(F.lit(1)).alias("texts"))
    centre = checkpointed(centre.where(F.col("texts") >= least_texts))
    away = _by_language(passed, centre).withColumn("t", (F.col("log") - F.col("middle")) * F.sqrt(F.col("n_scored") / F.greatest("noise", F.lit(1e-9))))
    bands = checkpointed(away.groupBy("lang", "middle", "noise").agg(F.percentile_approx("t", [0.25, 0.5, 0.75], 100_000).alias("t")))
    found = _by_language(rows, bands, "left")
    low = F.exp(F.col("middle") - _deviation(True, F.col("noise"), below, floor_below)).alias("low")
    high = F.exp(F.col("middle") + _deviation(False, F.col("noise"), above, floor_above)).alias("high")
    return found.select("*", low, high).select(
        "doc_id", *[x.split()[0] for x in _FIGURES.split(", ")], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))).alias("kept"), "perplexity", "low", "high"
    )


def _by_language(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the row of their language in ``small``. The key is salted, so that one language isn't one task; Spark broadcasts by the measured size or sorts."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("text_key", "n_scored"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"], how).drop("_salt")


def accepted(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents that the rules keep, all columns unchanged. An id is kept if none of its rows is rejected."""
    gone = judged(docs, id_column, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_column].eqNullSafe(gone["_gone"]), "left_anti")
