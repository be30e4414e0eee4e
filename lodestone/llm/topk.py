"""Exact top-k by integer inner product with MaxScore: essential postings are traversed, the others probed while a candidate can compete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed, parts_for

#: Components are counted in so many parts of one.
SCALE = 1024.0
#: Queries and bytes of them that a task holds, tasks at least, vectors that a task streams past its queries at most, and dimensions probed at once.
QUERIES, QUERY_BYTES, TASKS, RUN, STEP = 8192, 8 << 20, 16, 1 << 22, 8
#: Products below this are exact in doubles.
EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)


class Shard:
    """Vectors with a posting list for each dimension and sign: the places of the vectors that have it and their weights, and its largest weight."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, y: np.ndarray):
        self.ids, self.rows, self.y = ids, rows, y
        self.lists = []
        for column in y.T:
            for at in (np.flatnonzero(column > 0), np.flatnonzero(column < 0)):
                self.lists.append((at, np.abs(column[at])))
        self.most = np.array([w.max(initial=0) for _, w in self.lists])

    def at_least(self, q: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a superset of the vectors whose product with q is ``floor`` or more: all of these are in it.

        A term of the query is a dimension with the query's sign in it; vectors of the other sign only lose. Terms stand by
        falling bound; those at the end whose bounds sum to less than the floor aren't essential, since a vector without an
        essential term stays below it.
        """
        n = len(self.ids)
        terms = np.flatnonzero(q)
        own = terms * 2 + (q[terms] < 0)
        weight = np.abs(q[terms])
        bounds = weight * self.most[own]
        order = np.argsort(-bounds, kind="stable")
        terms, own, weight, bounds = terms[order], own[order], weight[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # of the terms from one on
        essential = int(np.count_nonzero(rest[:-1] >= floor)) if floor > 0 else len(terms)
        score, seen = np.zeros(n), np.zeros(n, bool)
        for k in range(essential):
            at, w = self.lists[own[k]]
            score[at] += weight[k] * w
            seen[at] = True
        if floor <= 0:  # a vector without any of the terms can compete too
            seen[:] = True
        at = np.flatnonzero(seen & (score + rest[essential] >= floor))
        score = score[at]
        for low in range(0, essential, STEP):  # what the other sign takes away
            done = terms[low : min(low + STEP, essential)]
            score = score + np.minimum(self.y[np.ix_(at, done)] * q[done], 0).sum(axis=1)
            keep = score + rest[essential] >= floor
            at, score = at[keep], score[keep]
        for low in range(essential, len(terms), STEP):
            done = terms[low : low + STEP]
            score = score + self.y[np.ix_(at, done)] @ q[done]
            keep = score + rest[min(low + STEP, len(terms))] >= floor
            at, score = at[keep], score[keep]
        return at, score

    def all_scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors, in whole numbers of any size cut to 64 bits in the end."""
        whole = [int(x) for x in q]
        return np.arange(len(self.ids)), np.array([min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True)), _LONG[0]), _LONG[1]) for row in self.y], object)


class Best:
    """The best k of each query so far, in order, from the shards that were merged."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, k: int):
        self.rows, self.x, self.k = rows, x, k
        self.ids = [np.zeros(0, np.int64)] * len(x)
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(x)

    def merge(self, shard: Shard) -> None:
        d = self.x.shape[1]
        exact = float(np.abs(self.x).max(initial=0)) * float(np.abs(shard.y).max(initial=0)) * max(1, d) < EXACT
        for i, q in enumerate(self.x):
            full = len(self.scores[i]) == self.k
            floor = float(self.scores[i][-1]) if full else -np.inf
            at, score = shard.at_least(q, floor) if exact else shard.all_scores(q)
            mine = shard.rows[at] != self.rows[i]
            at, score = at[mine], score[mine]
            if not len(at):
                continue
            if len(at) > self.k and exact:
                bar = np.partition(score, len(score) - self.k)[len(score) - self.k]
                at, score = at[score >= bar], score[score >= bar]
            ids, scores = np.concatenate([self.ids[i], shard.ids[at]]), np.concatenate([self.scores[i], score])
            order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k])
            self.ids[i], self.scores[i] = ids[order], scores[order]

    def table(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        whole = [int(s) for found in self.scores for s in found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.rows, n)), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)])), pa.array(whole, pa.int64())], names=["query", "vec_id", "score"])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).reshape(batch.num_rows, -1)


def _searched(k: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (d, block, run), the block's queries before the run's vectors; each run of these ends with the best of every query."""
        best, held, key = None, [], None

        def shut() -> Best | None:
            return Best(np.concatenate([r for r, _ in held]), np.concatenate([x for _, x in held]), k) if held else None

        for batch in stream:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("d", "block", "run", "is_query")])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])), batch.num_rows)
            for low, high in zip(cuts, cuts[1:], strict=False):
                now, part = tuple(keys[:3, low].tolist()), batch.slice(low, high - low)
                if now != key:
                    if best is not None:
                        yield best.table()
                    best, held, key = None, [], now
                x, rows = _numbers(part) if now[0] else np.zeros((part.num_rows, 0)), part.column("row").to_numpy()
                if keys[3, low]:
                    held.append((rows, x))
                    continue
                if best is None:
                    best = shut()
                if best is not None:
                    best.merge(Shard(part.column("vec_id").to_numpy(), rows, x))
        if best is not None:
            yield best.table()

    return run


def best_matches(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides the k other rows with the highest inner product.

    A component x counts as floor(1024 x), x as double; scores are exact. Equal scores stand by id. Queries are dealt into blocks
    and vectors into runs; a task streams a run past a block, shard by shard, with the block's best so far as the floor
    that MaxScore prunes by, and the runs' best are merged. Every vector travels to every block of queries once.

    Vectors that are null or hold a component that is null or, 1,024 fold, not finite take no part; of different lengths they don't
    meet. Rows are told apart by row, so one that repeats a query's id or vector can match it, and each row with a query's id
    is a query (with ``query_row`` its number). A null id is no query; as a match it stands last among equal scores. A score
    beyond 64 bits counts as the nearest one that fits. An empty table gives an empty result; other columns are not looked at.
    """
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    numbers = "array<float>" if single else "array<double>"
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(numbers).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf"))))
    good = source.where(F.col("v").isNotNull() & finite).select(F.coalesce("id", F.lit(_LONG[1])).alias("vec_id"), F.col("id").isNull().alias("unnamed"), F.size("v").cast("long").alias("d"), "v")
    good = checkpointed(good.withColumn("row", F.monotonically_increasing_id()))
    queries = good.where(~F.col("unnamed") & (F.col("vec_id") % every == 0))
    sizes = {tuple(r) for r in queries.groupBy("d").agg(F.count(F.lit(1))).collect()}  # a row a length
    if not sizes:
        return good.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"), F.col("row").alias("query_row"))
    blocks = [(d, parts_for(n, max(1, min(QUERIES, QUERY_BYTES // (8 * max(1, d)))))) for d, n in sizes]
    wide = max(b for _, b in blocks)
    runs = max(parts_for(TASKS, wide), parts_for(good.count(), RUN))
    of_d = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in blocks for x in pair]), F.col("d"))
    number = F.xxhash64("row")
    asked = queries.withColumn("block", F.pmod(number, of_d)).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).withColumn("is_query", F.lit(1))
    told = good.withColumn("blocks", of_d).where("blocks is not null").withColumn("run", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(runs).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("is_query", F.lit(0))
    fields = ["d", "block", "run", "is_query", "row", "vec_id", "v"]
    meeting = asked.select(fields).unionByName(told.select(fields)).repartition(sum(b for _, b in blocks) * runs, "d", "block", "run").sortWithinPartitions("d", "block", "run", F.desc("is_query"), "row")
    found = meeting.mapInArrow(_searched(k), "query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.nullif("vec_id", F.lit(_LONG[1])).alias("vec_id"), "score", F.col("query").alias("query_row"))
