"""Vectors of passages as stored matrix blocks, scored by matrix products."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.shipping import ship
from lodestone.sources.log import exists

#: Vectors of a block, and tasks' results that one task of the next round merges.
BLOCK, FAN = 1024, 16
_SCHEMA = "low string, high string, ids array<string>, data binary, dims int"
_SCORED = "chunk_hash string, similarity double"


def _blocked(dims: int, most: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows in order of their hashes as one row each: hashes, and a matrix of 32-bit numbers."""
        for batch in stream:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids = part.column("chunk_hash")
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if len(x) != len(ids) * dims or not np.isfinite(x).all():
                    raise ValueError(f"vectors must have {dims} finite components each")
                ends = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[0].as_py()]), pa.array([ids[len(ids) - 1].as_py()]), pa.ListArray.from_arrays(ends, ids), pa.array([x.tobytes()], pa.binary()), pa.array([dims], pa.int32()),
                ], names=["low", "high", "ids", "data", "dims"])

    return run


def _cosines(block: dict, q: np.ndarray) -> np.ndarray:
    x = np.frombuffer(block["data"], "<f4").reshape(len(block["ids"]), -1).astype(float)
    norms = np.sqrt((x * x).sum(axis=1) * (q @ q))
    return np.round(np.divide(x @ q, norms, out=np.full(len(x), np.nan), where=norms > 0), 6)


def _best(ids: list[str], scores: np.ndarray, depth: int) -> tuple[list[str], np.ndarray]:
    """The first ``depth`` by score, then hash."""
    if len(ids) > depth:  # ties at the border stay until hashes decide
        keep = scores >= np.partition(scores, len(scores) - depth)[len(scores) - depth]
        ids, scores = [ids[i] for i in np.flatnonzero(keep)], scores[keep]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:depth]
    return [ids[i] for i in order], scores[order]


def _scored(q: np.ndarray, depth: int | None):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector with its cosine, or a task's best; vectors without length have none."""
        ids: list[str] = []
        scores = np.zeros(0)
        for batch in stream:
            for block in batch.to_pylist():
                found = _cosines(block, q)
                some = np.flatnonzero(~np.isnan(found))
                ids, scores = [*ids, *(block["ids"][i] for i in some)], np.concatenate([scores, found[some]])
                if depth is None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(scores)], names=["chunk_hash", "similarity"])
                    ids, scores = [], np.zeros(0)
                else:
                    ids, scores = _best(ids, scores, depth)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(scores)], names=["chunk_hash", "similarity"])

    return run


def _merged(depth: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        scores = np.zeros(0)
        for batch in stream:
            ids, scores = _best([*ids, *batch.column("chunk_hash").to_pylist()], np.concatenate([scores, batch.column("similarity").to_numpy()]), depth)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(scores)], names=["chunk_hash", "similarity"])

    return run


class VectorStore:
    """A model's vectors in a folder that all executors reach: blocks in order of passage hashes, a part for each append."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder.rstrip("/")

    def blocks(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.folder}/*")

    def hashes(self) -> DataFrame:
        """The passages that have a vector; the vectors themselves aren't read."""
        return self.blocks().select(F.explode("ids").alias("chunk_hash"))

    def append(self, vectors: DataFrame, dims: int) -> None:
        """Adds (chunk_hash, vector) rows of passages without a vector; of several for one the first by components. Another width fails the job."""
        stored = self.blocks().select("dims").limit(1).collect()
        if stored and stored[0]["dims"] != dims:
            raise ValueError(f"{self.folder} holds vectors of {stored[0]['dims']} numbers, not of {dims}")
        fresh = vectors.where("chunk_hash is not null").select("chunk_hash", F.col("vector").cast("array<float>").alias("vector")).join(self.hashes(), "chunk_hash", "left_anti")
        one = fresh.groupBy("chunk_hash").agg(F.min("vector").alias("vector"))
        ordered = one.repartitionByRange("chunk_hash").sortWithinPartitions("chunk_hash")
        ordered.mapInArrow(_blocked(dims, BLOCK), _SCHEMA).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def scores(self, query: list[float]) -> DataFrame:
        """chunk_hash, similarity of every vector."""
        return self.blocks().mapInArrow(_scored(np.array(query, float), None), _SCORED)

    def nearest(self, query: list[float], depth: int) -> DataFrame:
        """chunk_hash, similarity of the ``depth`` nearest: each task keeps its best, and rounds of tasks merge them."""
        best = self.blocks().mapInArrow(_scored(np.array(query, float), depth), _SCORED)
        tasks = self.blocks().rdd.getNumPartitions()
        while tasks > 1:
            tasks = -(-tasks // FAN)
            best = best.repartition(tasks).mapInArrow(_merged(depth), _SCORED)
        return best

    def top(self, query: list[float], depth: int, present: Callable[[list[str]], set[str]]) -> list[tuple[str, float]]:
        """The ``depth`` nearest that ``present`` (hashes -> those in the index) knows, best first; more are fetched while stale ones take places."""
        ask = 2 * depth
        while True:
            found = sorted(((r["chunk_hash"], r["similarity"]) for r in self.nearest(query, ask).collect()), key=lambda x: (-x[1], x[0]))  # ask rows
            here = present([h for h, _ in found])
            live = [x for x in found if x[0] in here][:depth]
            if len(live) == depth or len(found) < ask:
                return live
            ask *= 4


def ranked(found: DataFrame, depth: int) -> DataFrame:
    """chunk_hash, similarity, rank of the best rows."""
    best = found.orderBy(F.desc("similarity"), "chunk_hash").limit(depth)
    return best.select("chunk_hash", "similarity", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_hash")).cast("long").alias("rank"))
