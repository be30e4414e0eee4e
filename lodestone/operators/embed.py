"""Vectors for passages and order for hits, by models that plug in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestone.shipping import ship

BATCH = 32
# Fixed value: what leads a query, and never a document.
INSTRUCTION = "Instruct: {task}\nQuery:{query}"


class Embedder(Protocol):
    model: str
    dims: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashingEmbedder:
    """Signed counts of words by their hash; needs no model. For tests, and where nothing better is at hand."""

    def __init__(self, dims: int = 64):
        self.model, self.dims = "hashing", dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[code % self.dims] += 1 if code >> 31 else -1
        return out.tolist()


def as_query(query: str, task: str) -> str:
    return INSTRUCTION.format(task=task, query=query)


def checked(vectors: Sequence[Sequence[float]], n: int, dims: int) -> np.ndarray:
    """The vectors with length one, zero vectors as they are; an error if one is missing, of another width or not finite."""
    found = np.asarray(vectors, dtype=np.float64)
    if found.shape != (n, dims) or not np.isfinite(found).all():
        raise ValueError(f"{n} finite vectors of width {dims} were expected, not {found.shape}")
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norms > 0, norms, 1)


def embedded(chunks: DataFrame, make: Callable[[], Embedder], batch: int = BATCH) -> DataFrame:
    """chunk_hash, vector, reason of rows (chunk_hash, chunk_text); a text that fails alone has no vector and a reason.

    A batch that fails is tried again one text at a time. A PermissionError ends the job: no text would pass.
    """

    def run(frames):
        model = make()

        def some(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            try:
                return [(v.tolist(), None) for v in checked(model.embed(texts), len(texts), model.dims)]
            except PermissionError:
                raise
            except Exception as error:
                return [(None, str(error))] if len(texts) == 1 else [some([t])[0] for t in texts]

        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                found = some([t or "" for t in part["chunk_text"]])
                yield pd.DataFrame({"chunk_hash": part["chunk_hash"].tolist(), "vector": [f[0] for f in found], "reason": [f[1] for f in found]})

    ship(chunks.sparkSession)
    return chunks.select("chunk_hash", "chunk_text").mapInPandas(run, "chunk_hash string, vector array<float>, reason string")


def reranked(hits: list[tuple[str, float, str]], score: Callable[[list[str]], list[float]] | None, budget: int = 4096) -> tuple[list[tuple[str, float]], str | None]:
    """Hits (chunk_hash, score, text), at most a search's 40, by a cross-encoder's scores; as they were, with the reason, if it fails."""
    before = [(h, s) for h, s, _ in hits]
    if score is None:
        return before, "no reranker"
    try:
        scores = score([text.replace("<|", "< |")[:budget] for _, _, text in hits])
    except Exception as error:
        return before, str(error)
    if len(scores) != len(hits):
        return before, f"{len(scores)} scores for {len(hits)} passages"
    return sorted(((h, s) for (h, _, _), s in zip(hits, scores)), key=lambda x: (-x[1], x[0])), None
