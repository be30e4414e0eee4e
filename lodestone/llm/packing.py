"""Packing tokenised documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed
from lodestone.llm.textcore import Words, batches, column_bytes, released

SEQUENCE, END = 4096, 2
#: Pieces of one length that a task ranks at once.
RANKED = 100_000
#: Words whose ids a worker remembers (about 40 bytes each).
REMEMBERED = 2_000_000
_SEPARATOR = "\x01"


def _marked(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words of these byte spans with the separator, in spaces, between them."""
    sizes = ends - starts
    to = np.cumsum(sizes + 3) - (sizes + 3)
    out = np.full(int(to[-1] + sizes[-1] + 3), ord(" "), np.uint8)
    out[to + sizes + 1] = ord(_SEPARATOR)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + within] = raw[np.repeat(starts, sizes) + within]
    return out[:-3].tobytes().decode("utf-8", "replace")


class WordIds:
    """Token ids of words, remembered by the words' hashes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in order. New words are encoded many at a time with a control character between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words with these byte spans: all ids, at which each word's begin, and how many it has."""
        encode = self.tokenizer.encode_batch_fast
        # A word that holds the mark or may hold a special token is encoded by itself.
        odd = np.flatnonzero((raw == ord(_SEPARATOR)) | ((raw == ord("<")) & (np.append(raw[1:], 0) == ord("|"))))
        alone = np.searchsorted(odd, starts) < np.searchsorted(odd, ends)
        if self.mark is None:
            alone[:] = True
        flat, begin, sizes, total = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32), 0
        plain = np.flatnonzero(~alone)
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.array(encode([_marked(raw, starts[some], ends[some])], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) + 1 != len(some):
                alone[some] = True
                continue
            sizes[some] = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            begin[some] = total + np.cumsum(sizes[some]) - sizes[some]
            flat.append(np.delete(ids, marks))
            total += len(flat[-1])
        rest = np.flatnonzero(alone)
        words = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        for i, x in zip(rest.tolist(), encode(words, add_special_tokens=False) if words else [], strict=True):
            begin[i], sizes[i] = total, len(x.ids)
            flat.append(np.array(x.ids, np.uint32))
            total += len(x.ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), begin, sizes

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            ids, begin, sizes = self._encoded(words.raw, words.starts[first[new]], words.ends[first[new]])
            begin = begin + len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            put = at[new]
            self.hashes, self.starts, self.sizes = (np.insert(a, put, b) for a, b in ((self.hashes, hashes[new]), (self.starts, begin), (self.sizes, sizes)))
            at = np.searchsorted(self.hashes, hashes)
        sizes, starts = self.sizes[at][back].astype(np.int64), self.starts[at][back]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


_known: dict[str, WordIds] = {}


def _pieces(path: str, sequence: int, end: int):
    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _known.setdefault(path, None) or _known.__setitem__(path, WordIds(path)) or _known[path]
        for batch in batches(stream, "text", 2 << 20):
            words = Words(*column_bytes(batch.column("text")))
            ids, sizes = encoder(words)
            before = np.append(0, np.cumsum(sizes))[words.bounds]
            rows: list[tuple[int, int, int, int, int]] = []
            for d, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                for start in range(0, len(own), sequence):
                    piece = own[start : start + sequence]
                    rows.append((d, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            d, *others = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(d), *others], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.forget()

    return run


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths, how often) of packs. Lengths go longest first, each into the packs with most room that it fits, all
    equal packs at once; what finds no pack opens new ones. Work depends on the number of different lengths alone."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    done: list[tuple[list[int], int]] = []

    def put(space: int, pattern: list[int], count: int) -> None:
        (room[space] if space else done).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # A length that has just been placed leaves less room than before, so spaces are visited once, from the largest.
        for space in sorted((s for s in room if s >= length and room[s]), reverse=True):
            while left and room[space]:
                pattern, count = room[space].pop()
                used = min(left, count)
                if count > used:
                    room[space].append((pattern, count - used))
                put(space - length, [*pattern, length], used)
                left -= used
            if not left:
                break
        while left:  # new packs; several of one length may share one
            fits = sequence // length
            if left >= fits:
                put(sequence - fits * length, [length] * fits, left // fits)
                left -= left // fits * fits
            else:
                put(sequence - left * length, [length] * left, 1)
                left = 0
    return [*done, *(x for packs in room.values() for x in packs)]


def _placed(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """slots: by length, from which rank on a slot holds, its first sequence and its offset."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                ranks, firsts, offsets = slots[n]
                mine = np.flatnonzero(length == n)
                at = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine] = firsts[at] + rank[mine] - ranks[at]
                offset[mine] = offsets[at]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document.

    A document is its token ids and then the id ``end``; it is cut every ``sequence`` ids. The counts
    of pieces of each length (``sequence`` numbers at most) come to the driver, which makes packing
    patterns of them; pieces then find their sequence by their rank among those of their length.
    Ranks come from counts of groups of about 100,000 pieces, so a frequent length is no single task.

    Null and empty texts are the end id alone. A null id is packed like any other. Rows that repeat
    are packed each. An empty table gives an empty result; other columns are not looked at.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = checkpointed(source.mapInArrow(_pieces(tokenizer_path, sequence, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    begin = 0
    for pattern, count in patterns(histogram, sequence):
        offset = 0
        for length in pattern:
            slots[length].append((taken[length], begin, offset))
            taken[length] += count
            offset += length
        begin += count
    arrays = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in slots.items()}

    spark = docs.sparkSession
    groups = F.broadcast(spark.createDataFrame([(n, -(-c // RANKED)) for n, c in histogram.items()], "length long, groups long"))  # a row for each length
    grouped = pieces.join(groups, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "row"), "groups"))
    sizes = grouped.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    ranked = grouped.withColumn("row", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "row")))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_placed(arrays), schema)
