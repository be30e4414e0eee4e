"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, smallest_ids, with_nodes
from lodestone.llm.session import checkpointed
from lodestone.llm.textcore import LOWER, Words, batches, column_bytes, flat_binary, mix, spans_hash, windows

#: Partners that one verification task compares with a document at once.
PARTNERS = 128
#: In a bucket compared whole: documents of a tile from its largest class, and from the others.
LARGE_BLOCK, SMALL_BLOCK = 512, 128
#: Shingles hashed at once, so that the working arrays stay in the processor's cache.
_RUN = 1 << 15


def shingle_sets(raw: np.ndarray, docs: np.ndarray, size: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, their hashes, and each document's sorted distinct shingle hashes with bounds."""
    words = Words(LOWER[raw], docs)
    hashes = words.hashes()
    grams, at = windows(hashes, words.bounds, size)
    low = np.searchsorted(at, words.bounds[:-1])
    high = np.searchsorted(at, words.bounds[1:])
    counts, whole = words.counts(), spans_hash(hashes, words.bounds)
    sets = [np.unique(grams[a:b]) if n >= size else whole[d : d + 1] if n else grams[:0] for d, (a, b, n) in enumerate(zip(low.tolist(), high.tolist(), counts.tolist(), strict=True))]
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return words, hashes, np.concatenate(sets) if sets else grams[:0], bounds


def circulant_minhash(values: np.ndarray, bounds: np.ndarray, n_hashes: int) -> np.ndarray:
    """n_hashes x documents: the MinHash signature of each non-empty set values[bounds[d]:bounds[d+1]].

    The universe is the integers modulo 2**32. One permutation, sigma, scatters the shingles over it
    (the shingle's hash); the second, pi, is a mixing bijection that is shifted circularly by k
    places for the k-th coordinate: h_k(S) = min over s of pi((sigma(s) - k) mod 2**32).
    """
    sigma = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n_hashes, len(bounds) - 1), np.uint32)
    d = 0
    while d < out.shape[1]:
        e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + _RUN, "right")) - 1)
        part, cuts = sigma[bounds[d] : bounds[e]], bounds[d:e] - bounds[d]
        x, y = np.empty_like(part), np.empty_like(part)
        for k in range(n_hashes):
            np.subtract(part, np.uint32(k), out=x)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[k, d:e] = np.minimum.reduceat(x, cuts)
        d = e
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands: a 64-bit key of each band of ``rows`` coordinates; the band's number is part of it."""
    n_bands = signature.shape[0] // rows
    out = np.empty((signature.shape[1], n_bands), np.uint64)
    for band in range(n_bands):
        key = np.full(signature.shape[1], band + 1, np.uint64)
        for row in signature[band * rows : (band + 1) * rows]:
            key = mix(key * np.uint64(0x100000001B3) + row)
        out[:, band] = key
    return out


def _signed(size: int, bands: int, rows: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            raw, docs = column_bytes(batch.column("text"))
            words, hashes, values, bounds = shingle_sets(raw, docs, size)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            # Empty sets take no room, so the bounds of the others follow from their starts.
            keys = band_keys(circulant_minhash(values, np.append(bounds[some], bounds[-1]), bands * rows), rows)
            n_keys = np.where(sizes > 0, bands, 0)
            twice = spans_hash(mix(hashes + np.uint64(0x5851F42D4C957F2D)), words.bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(spans_hash(hashes, words.bounds).view(np.int64)), pa.array(twice.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_keys)).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    return run


def _sets(size: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            words, hashes, values, bounds = shingle_sets(*column_bytes(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans_hash(hashes, words.bounds).view(np.int64)), flat_binary(values, np.diff(bounds))], names=["doc_id", "key1", "shingles"])

    return run


def linked(left: np.ndarray, right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``right`` have 100 * intersection >= percent * union with ``left`` (sorted distinct hashes)."""
    sizes = np.array([len(s) for s in right], np.int64)
    every = np.concatenate(right)
    at = np.minimum(np.searchsorted(left, every), len(left) - 1)
    ends = np.cumsum(sizes)
    sums = np.append(0, np.cumsum(left[at] == every))
    both = sums[ends] - sums[ends - sizes]
    return 100 * both >= percent * (len(left) + sizes - both)


def _verified(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links between the two sides of one tile; a link that closes a circle of others is left out."""
        side, doc, part = rows["side"].to_numpy(), rows["doc"].to_numpy(), rows["component"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        root = {int(d): int(d) for d in doc}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        right = np.flatnonzero(side != 0)  # 0: left only, 1: right only, 2: both
        for i in np.flatnonzero(side != 1):
            others = right[(part[right] != part[i]) & ((side[right] == 1) | (doc[right] > doc[i]))]
            if not len(others):
                continue
            for j in others[linked(sets[i], [sets[j] for j in others], percent)]:
                a, b = int(doc[i]), int(doc[j])
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """tiles: tile (struct), side, doc, component. Documents' sets join their tiles; a tile's size is bounded."""
    return tiles.join(sets, "doc").groupBy("tile").applyInArrow(_verified(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of documents that chains of near-duplicate links connect.

    A document's set is its distinct lower-cased (A-Z) shingles of ``shingle_words`` words; a shorter
    text is one shingle. Two documents are linked if 100 * |intersection| >= percent * |union|,
    confirmed on whole sets. Signatures have bands * rows coordinates; a pair at Jaccard 0.8 shares
    no band with a probability of (1 - 0.8**rows)**bands, 5e-8 by default.

    Documents with equal word sequences are one from the start. In each bucket of a band every member
    is compared with the smallest one; buckets whose members then still lie in several classes are
    compared whole, class against class, in tiles of at most 128 by 512 documents. No bucket is capped,
    no pair between members is written unless it is a link that joins two classes.

    Null or empty texts have no shingles and are linked with nothing: each is its own class. A null
    id has a null class and stays. Rows that repeat an id are documents each, linked by their own texts; a
    class's id is the smallest of its rows, so all rows with that id are kept. An empty table gives an
    empty result; other columns are not looked at.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = checkpointed(source.mapInArrow(_signed(shingle_words, bands, rows), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    texts = full.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"))
    classes = checkpointed(with_nodes(texts, full, "doc_id", ["key1", "key2"]))

    members = classes.select(F.col("node").alias("doc"), F.explode("bands").alias("band"))
    firsts = members.groupBy("band").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last")
    members = checkpointed(members.join(firsts.select("band", "first", "size"), "band").select("band", "doc", "first", "size"))
    pairs = members.where("doc <> first").select("first", "doc").distinct()
    degrees = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts"))
    pairs = checkpointed(pairs.join(degrees, "first").select("first", "doc", F.pmod(F.xxhash64("doc"), "salts").alias("salt")))
    tile = F.struct("first", "salt", F.lit(-1).cast("long").alias("other")).alias("tile")
    stars = pairs.select(tile, F.lit(1).alias("side"), "doc", F.col("doc").alias("component")).union(
        pairs.select("first", "salt").distinct().select(tile, F.lit(0).alias("side"), F.col("first").alias("doc"), F.col("first").alias("component"))
    )
    wanted = pairs.select("doc").union(pairs.select("first")).distinct()
    # The texts of wanted classes by their smallest ids; among rows that repeat an id the text's own hash says which is meant.
    wanted = classes.join(wanted.withColumnRenamed("doc", "node"), "node", "left_semi").select(F.col("doc").alias("doc_id"), "key1", F.col("node").alias("doc"))
    texts = source.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, key1 long, shingles binary")
    sets = checkpointed(texts.join(wanted, ["doc_id", "key1"]).groupBy("doc").agg(F.first("shingles").alias("shingles")))
    links = checkpointed(_links(stars, sets, percent))
    found = components(links)

    # Buckets whose members lie in several classes: compare them whole, in tiles.
    placed = members.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select("band", "doc", "size", F.coalesce("component", "doc").alias("component"))
    parts = checkpointed(
        placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("all"))
        .groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("large"), F.max("n").alias("in_large"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("classes"), F.sum("all").alias("all"))
        .where("classes > 1 and size > 2")
    )
    once = parts.groupBy("all", "size").agg(F.min("band").alias("band")).select("band")  # buckets with the same members
    parts = parts.join(once, "band", "left_semi").select("band", "large", F.ceil(F.col("in_large") / LARGE_BLOCK).alias("n_large"), F.ceil((F.col("size") - F.col("in_large")) / SMALL_BLOCK).alias("n_small"))
    rest = checkpointed(placed.join(parts, "band").withColumn("is_large", F.col("component") == F.col("large")))
    if not rest.isEmpty():
        # Tiles (i, j) of other classes among themselves, i <= j, and (i, -1 - k) of others with the largest class.
        block = F.pmod(F.xxhash64("doc", F.lit(1)), F.when(F.col("is_large"), F.col("n_large")).otherwise(F.col("n_small")))
        smalls = F.sequence(F.lit(0).cast("long"), F.col("n_small") - 1)
        larges = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_large") - 1), lambda k: -1 - k)
        rest = rest.withColumn("block", F.when(F.col("is_large"), -1 - block).otherwise(block))
        rest = rest.withColumn("other", F.explode(F.when(F.col("is_large"), smalls).otherwise(F.concat(smalls, larges))))
        with_large = F.least("block", "other") < 0
        low, high = F.least("block", "other"), F.greatest("block", "other")
        tile = F.struct(F.col("band").alias("first"), F.when(with_large, high).otherwise(low).alias("salt"), F.when(with_large, low).otherwise(high).alias("other")).alias("tile")
        side = F.when(F.col("block") == F.col("other"), 2).when(with_large, F.when(F.col("is_large"), 1).otherwise(0)).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
        more = checkpointed(_links(rest.select(tile, side, "doc", "component"), sets, percent))
        if not more.isEmpty():
            found = components(links.union(more))

    placed = classes.select("key1", "key2", "doc", "node").join(smallest_ids(found, classes), "node", "left").select("key1", "key2", F.coalesce("component_id", "doc").alias("component_id"))
    placed = full.select("doc_id", "n_shingles", "key1", "key2").join(placed, ["key1", "key2"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents without all but one of each class, all columns unchanged.

    Of rows with one id one stays, whatever their texts; rows without an id stay. A null or empty text stays.
    """
    gone = near_duplicates(docs, id_column, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
    return left.where(F.col(id_column).isNotNull()).dropDuplicates([id_column]).union(left.where(F.col(id_column).isNull()))
