"""Exact substring deduplication of word windows, by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import parts_for, text_chars
from lodestone.llm.textcore import Words, column_bytes, windows_at

#: Characters of text in one chunk of documents, and in the windows of one bucket of hashes.
CHUNK_CHARS, BUCKET_CHARS = 4_000_000, 8_000_000
#: The smallest document of a chunk with a window, and whether others of the chunk have it too.
_FIRST = np.dtype([("id", "<i8"), ("several", "u1")])
_PAYLOAD = "bucket int, chunk long, hashes binary, firsts binary"


def level_lengths(window: int, base: int) -> list[int]:
    """base, 2 * base, 4 * base ... up to the window; the last doubling ends at the window itself."""
    lengths = [min(base, window)]
    while lengths[-1] < window:
        lengths.append(min(window, 2 * lengths[-1]))
    return lengths


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class _Chunk:
    """Documents of one chunk, their words and word hashes."""

    def __init__(self, docs: pa.Table):
        order = np.argsort(docs["_id"].to_numpy(), kind="stable")
        self.docs = docs.take(pa.array(order))
        self.ids = self.docs["_id"].to_numpy()
        self.words = Words(*column_bytes(self.docs["_text"]))
        self.hashes = self.words.hashes()
        self.ends = np.repeat(self.words.bounds[1:], self.words.counts())


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)


def _sieve_key(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket and 32 bits of the hash. Buckets grow with the corpus, so about one window in 3,000 counts as
    repeated falsely at any size; such windows die at the last level, where whole hashes are compared."""
    return _bucket(hashes, n_buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _payload(chunk: int, buckets: np.ndarray, values: np.ndarray, firsts: np.ndarray) -> pa.Table:
    """One row for each bucket that has values; buckets ascend."""
    some, low = np.unique(buckets, return_index=True)
    cuts = np.append(low, len(buckets)).tolist()
    part = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
    return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk, np.int64)), "hashes": part(values), "firsts": part(firsts)})


def _arrays(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table[column]]


def _sieved(replies: pa.Table) -> np.ndarray:
    """The sieve keys that the buckets found repeated, sorted."""
    parts = [np.uint64(b) << np.uint64(32) | x for b, x in zip(replies["bucket"].to_pylist(), _arrays(replies, "hashes", np.uint32), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _candidates(key: tuple, docs: pa.Table, replies: pa.Table | None, length: int, before: int | None, last: bool, n_buckets: int) -> pa.Table:
    """A chunk's distinct candidate windows of one length, for the buckets. At the last level with whole hashes and
    the smallest document of each; before it with a mark for windows that several documents of the chunk share."""
    if not docs.num_rows:
        return _payload(0, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    chunk = _Chunk(docs)
    n = len(chunk.hashes)
    at = np.flatnonzero(np.arange(n) + length <= chunk.ends)
    if before is not None:
        shorter = np.flatnonzero(np.arange(n) + before <= chunk.ends)
        alive = np.zeros(n, bool)
        alive[shorter] = _within(_sieve_key(windows_at(chunk.hashes, shorter, before), n_buckets), _sieved(replies))
        at = at[alive[at] & alive[at + length - before]]
    hashes = windows_at(chunk.hashes, at, length)
    number = key[0].as_py()
    owner = np.repeat(np.arange(len(chunk.ids)), chunk.words.counts())[at]
    values = hashes if last else _sieve_key(hashes, n_buckets)
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    head = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    several = np.maximum.reduceat(chunk.ids[o], head) > np.minimum.reduceat(chunk.ids[o], head) if len(v) else np.zeros(0, bool)
    v = v[head]
    if last:
        told = np.empty(len(v), _FIRST)
        told["id"], told["several"] = chunk.ids[o[head]], several
        return _payload(number, _bucket(v, n_buckets), v, told)
    return _payload(number, v >> np.uint64(32), (v & np.uint64(0xFFFFFFFF)).astype(np.uint32), several.astype(np.uint8))


def _counted(last: bool):
    """One bucket's windows of all chunks. Each chunk gets those of its windows that are repeated. At the last level
    it gets those that some document of it may lose, with the smallest document that has them."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = _arrays(rows, "hashes", np.uint64 if last else np.uint32)
        firsts = _arrays(rows, "firsts", _FIRST if last else np.uint8)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        h, f = every[order], np.concatenate(firsts)[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(head, len(h)))
        place = np.empty(len(h), np.int64)
        place[order] = np.repeat(np.arange(len(head)), sizes)
        if last:
            told, own = np.minimum.reduceat(f["id"], head)[place], np.concatenate(firsts)
            keep = (told < own["id"]) | (own["several"] > 0)
        else:
            keep = ((sizes > 1) | (np.maximum.reduceat(f, head) > 0))[place]
            told = np.zeros(len(h), np.uint8)
        ends = np.cumsum([len(x) for x in hashes]).tolist()
        spans = [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.table(
            {
                "bucket": rows["bucket"],
                "chunk": rows["chunk"],
                "hashes": pa.array([every[s][keep[s]].tobytes() for s in spans], pa.binary()),
                "firsts": pa.array([told[s][keep[s]].tobytes() for s in spans] if last else [b""] * len(spans), pa.binary()),
            }
        )

    return run


def _level(length: int, before: int | None, last: bool, n_buckets: int) -> tuple:
    def first(key: tuple, docs: pa.Table) -> pa.Table:
        return _candidates(key, docs, None, length, None, last, n_buckets)

    def later(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        return _candidates(key, docs, replies, length, before, last, n_buckets)

    return first, later


def _cut(window: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(docs)
        words, n = chunk.words, len(chunk.hashes)
        known = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in replies["hashes"]]) if replies.num_rows else np.zeros(0, np.uint64)
        first = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in replies["firsts"]]) if replies.num_rows else np.zeros(0, np.int64)
        order = np.argsort(known)
        known, first = known[order], first[order]
        at = np.flatnonzero(np.arange(n) + window <= chunk.ends)
        covered = np.zeros(n + 1, np.int64)
        if len(known) and len(at):
            hashes = windows_at(chunk.hashes, at, window)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            owner = np.repeat(chunk.ids, words.counts())[at]
            later = at[(known[place] == hashes) & (first[place] < owner)]
            np.add.at(covered, later, 1)
            np.add.at(covered, later + window, -1)
        gone = np.cumsum(covered)[:n] > 0
        raw, (starts, ends) = words.raw, (words.starts, words.ends)
        # Kept words and one byte after each, which becomes a space; a document's last one is cut off.
        padded = np.append(raw, np.uint8(32))
        extended = np.zeros(len(padded) + 1, np.int64)
        np.add.at(extended, starts[~gone], 1)
        np.add.at(extended, ends[~gone], -1)
        inside = np.cumsum(extended)[:-1] > 0
        lengths = np.where(gone, 0, ends - starts + 1)
        out = np.full(int(lengths.sum()), 32, np.uint8)
        to = np.cumsum(lengths) - lengths
        shift = np.repeat(to[~gone] - starts[~gone], (ends - starts)[~gone])
        source = np.flatnonzero(inside)
        out[source + shift] = padded[source]
        sums = np.append(0, np.cumsum(lengths))
        low, high = sums[words.bounds[:-1]], sums[words.bounds[1:]]
        data = out.tobytes()
        texts = [data[a : max(a, b - 1)] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        removed = np.append(0, np.cumsum(gone))
        return pa.table(
            {
                "doc_id": chunk.docs["_id"],
                "n_words": pa.array(words.counts()),
                "n_removed": pa.array(removed[words.bounds[1:]] - removed[words.bounds[:-1]]),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                "text_key": chunk.docs["_key"],
            }
        )

    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 13, base: int = 4, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, text_key: every text without the words that an earlier document has.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id. Windows are judged on the input. kept_text joins the words that stay by one space.

    Level-wise doubling: windows of ``base`` words are counted first; only where two repeated windows
    of one length meet is the window of twice that length looked at, up to ``window``. Documents are
    dealt into chunks; a chunk sends each distinct candidate window of a level once, however often it
    occurs, to the bucket of its hash, and gets back which are repeated. So one very frequent passage
    costs one entry a chunk. At the last level windows are compared by 64-bit hashes.

    Null and empty texts have no words: n_words and n_removed are 0, kept_text is empty. A text shorter
    than the window stays whole. Rows with a null id come back with their words, unjudged, and remove nothing.
    Rows that repeat an id are one document to this rule: they don't remove each other's words, and each has a row with its own
    text; ``text_key``, xxhash64 of the text, tells them apart.
    """
    source = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    chars = text_chars(source, "_text")
    n_chunks, n_buckets = parts_for(chars, chunk_chars, 16), parts_for(chars, BUCKET_CHARS, 16)
    named = source.where("_id is not null").select("_id", "_text", F.xxhash64("_text").alias("_key"), F.pmod(F.xxhash64("_id"), F.lit(n_chunks)).alias("chunk"))
    by_chunk = named.groupBy("chunk")
    before, replies = None, None
    lengths = level_lengths(window, base)
    for length in lengths:
        last = length == lengths[-1]
        first, later = _level(length, before, last, n_buckets)
        sent = by_chunk.applyInArrow(first, _PAYLOAD) if replies is None else by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(later, _PAYLOAD)
        replies = sent.groupBy("bucket").applyInArrow(_counted(last), _PAYLOAD)
        before = length
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text_key long"
    judged = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_cut(window), schema)
    word = "[^\\x20\\x09-\\x0D]+"
    plain = source.where("_id is null").select("_id", F.xxhash64("_text").alias("_key"), F.array_join(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(f"({word})"), 1), " ").alias("t"), F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(word)).cast("long").alias("n"))
    return judged.union(plain.select("_id", "n", F.lit(0).cast("long"), F.sha2(F.col("t").cast("binary"), 256), "t", "_key"))


def deduplicated_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents with the words that stay as their text; documents of which nothing stays are left out.

    Rows that repeat an id keep their own texts, each without what documents with smaller ids have; equal rows stay as many.
    """
    kept = without_repeats(docs, id_column, text_column, **options)
    changed = kept.where("n_removed > 0 and doc_id is not null").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("kept_text").alias("_kept")).dropDuplicates(["_doc", "_key"])
    joined = docs.join(changed, (docs[id_column] == changed["_doc"]) & (F.xxhash64(docs[text_column].cast("string")) == changed["_key"]), "left")
    text = F.coalesce(F.col("_kept"), docs[text_column]).alias(text_column)
    rows = joined.select(*[text if c == text_column else docs[c] for c in docs.columns])
    return rows.where(F.col(text_column).rlike("[^\\x20\\x09-\\x0D]"))
