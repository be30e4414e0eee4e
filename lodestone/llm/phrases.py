"""Phrase collocations: contiguous n-grams mined by pivot partitions, scored by their weakest cut.

Words are numbered by falling frequency, so the rarest word of an n-gram, its pivot, is its largest number. Each place of
a text sends what stands around it, up to the next rarer word, to the partition of its word; a partition counts there the
n-grams that its pivots own, longer ones only where the shorter ones they hold are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed, parts_for
from lodestone.llm.textcore import LOWER, batches, column_bytes, mix, released, span_hashes

#: Bytes of text of a block, fragments of a partition, and the most that a pivot sends to one (a more frequent one has several).
BLOCK_BYTES, FRAGMENTS, OF_PIVOT = 8 << 20, 1 << 20, 1 << 18
#: A word or n-gram with this share of all words is looked up in a broadcast: of each length there are so many at most.
FREQUENT = 1000
#: Candidates that are put in order at once before a language's best meet.
RANKED = 1 << 20

_BLANK = np.isin(np.arange(256), [0x20, 0x09])
_SPLIT = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))


def split_words(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and which of them begin a piece; docs are the texts' bounds."""
    split = _SPLIT[raw]
    solid = ~(_BLANK[raw] | split)
    first, last = solid.copy(), solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = np.unique(docs[(docs > 0) & (docs < len(raw))])
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(split, dtype=np.int64)[starts] + np.searchsorted(docs, starts, "right")  # both only rise
    return starts, ends, np.diff(piece, prepend=-1) != 0


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a column of strings."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


_BLOCKS = "block long, lang string, words array<string>, counts array<long>, tokens binary, n_tokens long"


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of a language: their distinct words, how often each stands there, and the texts as numbers of these; 0 ends a piece."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches(stream, "text", BLOCK_BYTES):
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            raw, docs = column_bytes(batch.column("text").take(pa.array(np.flatnonzero(codes == code))))
            raw = LOWER[raw]
            starts, ends, fresh = split_words(raw, docs)
            if not len(starts):
                continue
            _, at, which, n = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(1, len(order) + 1)
            tokens = np.zeros(len(starts) + int(fresh.sum()), np.int32)
            tokens[np.arange(len(starts)) + np.cumsum(fresh)] = place[which]
            words = _spans(raw, starts[at[order]], ends[at[order]])
            ends_at = pa.array([0, len(order)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([lang], pa.string()), pa.ListArray.from_arrays(ends_at, words), pa.ListArray.from_arrays(ends_at, pa.array(n[order])),
                pa.array([pa.compress(tokens.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([len(tokens)]),
            ], names=[c.split()[0] for c in _BLOCKS.split(", ")])
            block += 1


def fragments(x: np.ndarray, longest: int) -> np.ndarray:
    """For each place of x (numbers of words, -1 none) whose word can own an n-gram: a row of the ``longest - 1`` words before it, itself, and as many after it.

    Words stand up to the next one that is rarer, -1 beyond; before the pivot none equals it, so an n-gram that holds its pivot
    twice is owned by the first.
    """
    reach = longest - 1
    padded = np.concatenate([np.full(reach, -1, x.dtype), x, np.full(reach, -1, x.dtype)])
    out = np.full((2 * longest - 1, len(x)), -1, x.dtype)
    out[reach] = x
    for side in (-1, 1):
        open_ = x >= 0
        for d in range(1, reach + 1):
            beside = padded[reach + side * d : reach + side * d + len(x)]
            open_ = open_ & (beside >= 0) & (beside < x if side < 0 else beside <= x)
            out[reach + side * d] = np.where(open_, beside, -1)
    return out[:, (x >= 0) & ((out[reach - 1] >= 0) | (out[reach + 1] >= 0))]


def _routed(longest: int, buckets: int, each: int, kind: str):
    """The fragments of a block, equal ones as one with their number, by the partition of their pivot."""

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "whole": [], "data": []}
        code, number, f = (entries[c].to_numpy() for c in ("code", "id", "f"))
        for tokens, n in zip(texts["tokens"], texts["n_tokens"], strict=True):
            codes = np.frombuffer(pa.decompress(tokens.as_buffer(), decompressed_size=n.as_py() * 4, codec="zstd"), np.int32)
            known = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
            share = np.ones(len(known), np.int64)
            known[code + 1], share[code + 1] = number, -(-f // each)
            rows = fragments(known[codes], longest)
            shares = np.zeros(0, np.int64)
            if rows.shape[1]:
                of = np.empty(int(known.max()) + 1, np.int64) if known.max() < 1 << 22 else None
                if of is None:  # numbers too large for a table
                    order = np.argsort(known)
                    shares = share[order][np.searchsorted(known[order], rows[longest - 1])]
                else:
                    of[known[known >= 0]] = share[known >= 0]
                    shares = of[rows[longest - 1]]
            key = np.zeros(rows.shape[1], np.uint64)
            for column in rows:
                key = mix(key * np.uint64(31) + column.astype(np.uint64) + np.uint64(1))
            order = np.argsort(key)
            rows, key, shares = rows[:, order], key[order], shares[order]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
            n_each = np.diff(np.append(first, len(key)))
            rows, key, shares = rows[:, first], key[first], shares[first]
            bucket = (mix(rows[longest - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key % shares.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) * 2 + (shares == 1)
            order = np.argsort(bucket, kind="stable")
            rows, n_each, bucket = rows[:, order], n_each[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for low, high in zip(cuts, cuts[1:], strict=False):
                packed = np.concatenate([rows[:, low:high], n_each[None, low:high]]).astype(kind)
                out["bucket"].append(int(bucket[low]) >> 1)
                out["whole"].append(bool(bucket[low] & 1))
                out["data"].append(np.int64(high - low).tobytes() + pa.compress(packed.tobytes(), "zstd", asbytes=True))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "whole": pa.array(out["whole"], pa.bool_()), "data": pa.array(out["data"], pa.binary())})

    return run


def _sums(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of rows, the sum of the weights of each, and which of them every column is; exact."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    if bits * len(rows) <= 63:
        key = np.zeros(rows.shape[1], np.int64)
        for row in rows:
            key = key << bits | row
        order = np.argsort(key)
        fresh = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort(rows[::-1])
        fresh = np.concatenate([[True], (rows[:, order[1:]] != rows[:, order[:-1]]).any(axis=0)])[: rows.shape[1]]
    first = np.flatnonzero(fresh)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return rows[:, order[first]], np.add.reduceat(weights[order], first) if len(first) else weights[:0], which


def owned(rows: np.ndarray, weights: np.ndarray, longest: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of 2 to ``longest`` words around the pivots of fragments with ``least`` occurrences or more, and these, by length.

    An n-gram is counted only where both n-grams one word shorter that hold the pivot are frequent.
    """
    pivot, out = longest - 1, []
    shorter = {0: np.ones(rows.shape[1], bool)}
    for n in range(2, longest + 1):
        at = {}
        for before in range(n):
            low = pivot - before
            ok = (rows[low] >= 0) & (rows[low + n - 1] >= 0)
            if n > 2 and before < n - 1:
                ok &= shorter[before]
            if n > 2 and before:
                ok &= shorter[before - 1]
            at[before] = np.flatnonzero(ok)
        grams = np.concatenate([rows[pivot - b : pivot - b + n, i] for b, i in at.items()], axis=1)
        found, sums, which = _sums(grams, np.concatenate([weights[i] for i in at.values()]))
        often = sums >= least
        out.append((found[:, often], sums[often]))
        shorter, done = {}, 0
        for before, i in at.items():
            shorter[before] = np.zeros(rows.shape[1], bool)
            shorter[before][i] = often[which[done : done + len(i)]]
            done += len(i)
    return out


def _mined(longest: int, least: int, kind: str):
    def run(parts: pa.Table) -> pa.Table:
        """The n-grams that a partition's pivots own; those of a pivot that has several partitions are parts of a count."""
        out = []
        for whole in (True, False):
            data = [x.as_buffer() for x, w in zip(parts["data"], parts["whole"].to_pylist(), strict=True) if w == whole]
            if not data:
                continue
            width, held = 2 * longest, []
            for x in data:
                n = int(np.frombuffer(x, np.int64, 1)[0])
                held.append(np.frombuffer(pa.decompress(x.slice(8), decompressed_size=n * width * np.dtype(kind).itemsize, codec="zstd"), kind).reshape(width, n))
            rows = np.concatenate(held, axis=1).astype(np.int64)
            for found, sums in owned(rows[:-1], rows[-1], longest, least if whole else 1):
                n = len(found)
                g = pa.ListArray.from_arrays(pa.array(np.arange(0, n * found.shape[1] + 1, n), pa.int32()), pa.array(found.T.ravel()))
                out.append(pa.table({"g": g, "a": pa.array(sums), "whole": pa.array(np.full(len(sums), whole))}))
        return pa.concat_tables(out)

    return run


def _looked_up(asked: DataFrame, known: DataFrame, keys: list[str], total: int) -> DataFrame:
    """asked joined with known (keys and f, unique). What is very frequent is broadcast: of a length at most FREQUENT have that share of all words.

    Of the others each has under total / FREQUENT occurrences, so no key of the shuffled join is larger.
    """
    often = F.col("f") * FREQUENT >= total
    top = F.broadcast(known.where(often))
    return asked.join(top, keys).unionByName(asked.join(top, keys, "left_anti").join(known.where(~often), keys))


def ngrams(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Frequent n-grams: (g, a), g numbers of words; words (id, lang, word, f); languages (lang, n); and the number of all words."""
    source = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    blocks = checkpointed(source.mapInArrow(released(_blocks), _BLOCKS))
    pairs = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = checkpointed(pairs.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    languages = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    total, often = counted.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count_if(F.col("f") >= least)).first()
    order = [F.desc("f"), F.asc("lang"), F.asc("word")]
    ordered = counted.where(F.col("f") >= least).repartitionByRange(parts_for(often, 1 << 18), *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.select("lang", "word", "f", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")))
    sizes = dict(ordered.groupBy("part").count().collect())  # a number a partition
    starts = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    words = checkpointed(ordered.select("lang", "word", "f", (F.element_at(F.lit(starts), F.col("part") + 1) + F.col("k")).alias("id")))
    kind = "<i4" if often < 1 << 31 else "<i8"
    asked = blocks.select("block", "lang", F.posexplode("words").alias("code", "word"))
    entries = _looked_up(asked, words, ["lang", "word"], total).select(F.col("block").alias("of"), "code", "id", "f")
    routed = blocks.select("block", "tokens", "n_tokens").groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(_routed(longest, parts_for(total, FRAGMENTS), OF_PIVOT, kind), "bucket long, whole boolean, data binary")
    mined = checkpointed(routed.groupBy("bucket").applyInArrow(_mined(longest, least, kind), "g array<long>, a long, whole boolean"))
    summed = mined.where("not whole").groupBy("g").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return checkpointed(mined.where("whole").select("g", "a").unionByName(summed)), words, languages, total


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 10, longest: int = 3, inside_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words.

    A phrase occurs ``least`` times or more within pieces (between ``.,;:!?`` and line ends). Its score is that of its weakest cut in
    two, 1,000,000 a a / (l r) rounded down, with a, l, r the occurrences of the phrase and of both parts; of equal cuts the
    first counts. A phrase inside a longer one with ``inside_percent`` of its occurrences or more is left out. ``top`` phrases
    of a language are returned, by score, occurrences and then text; None returns all, with null ranks.

    A null language is ``und``; null and empty texts have no words. Rows that repeat count each. Texts of any length are read
    whole, in blocks. An empty table gives an empty result; other columns are not looked at.
    """
    grams, words, languages, total = ngrams(docs, text_column, lang_column, least, longest)
    spelt = _looked_up(grams.select("g", F.posexplode("g").alias("at", "id")), words, ["id"], total)
    spelt = spelt.groupBy("g").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    known = words.select(F.array("id").alias("part"), "f").unionByName(grams.select(F.col("g").alias("part"), F.col("a").alias("f")))
    cuts = grams.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    sides = cuts.select("g", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.slice("g", 1, F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), F.slice("g", F.col("k") + 1, F.size("g") - F.col("k")).alias("part")))).alias("s"))
    sides = _looked_up(sides.select("g", "a", "k", "s.first", "s.part"), known, ["part"], total)
    cut = sides.groupBy("g", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    whole = {c: f"cast({c} as decimal(20, 0))" for c in "alr"}
    cut = cut.withColumn("score", F.expr(f"(cast(1000000 as decimal(20, 0)) * ({whole['a']} * {whole['a']})) div ({whole['l']} * {whole['r']})"))
    scored = cut.groupBy("g", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("g") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("g") - n + 1), lambda i: F.slice("g", i, n))))
    covered = grams.where(F.size("g") > 2).select(F.explode(within).alias("g"), F.col("a").alias("longer")).groupBy("g").agg(F.max("longer").alias("longer"))
    left = scored.join(covered, "g", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))
    found = left.join(spelt, "g").select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    if top is None:
        return found.join(languages, "lang").select("lang", F.lit(None).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    # A language's best meet in one task; before that each of several tasks keeps the best of its own.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts_for(grams.count(), RANKED, 8))))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("_part")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
