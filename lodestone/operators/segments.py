"""Cutting rows in order into sessions and paragraphs, as a scan over spans of rows: no track meets in one task.

What a span of cues does depends on what comes before it by three numbers alone: the bytes of the paragraph that is open, how
many paragraphs its session has closed, and the session's number in its track. So a span becomes a function from bytes open
before it to bytes open after it and paragraphs closed; functions compose, and a tree of them gives each span its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_MS, ENOUGH_BYTES, MOST_BYTES = 10_000, 600, 1_200
#: Spans that are composed at once.
FAN = 64


class State(NamedTuple):
    """After some cue: its track and end, the bytes of the open paragraph (0: none), the number of the paragraph that is open or next, and the session's."""

    track: Any
    end: int
    open: int
    paragraph: int
    session: int


class Span(NamedTuple):
    """What a run of cues does; ``fresh`` is 0 without a break behind its first cue, 1 with a silence, 2 with another track.

    ``ends`` and ``closed`` go by the bytes open before it, and have one entry if fresh. ``closed`` and ``sessions`` count on
    from what was before, unless a silence (closed) or a track (both) begins anew.
    """

    first_track: Any
    first_start: int
    last_track: Any
    last_end: int
    fresh: int
    sessions: int
    ends: np.ndarray
    closed: np.ndarray

    def after(self, before: State | None) -> State:
        kind = _break(before, self)
        opened = before.open if kind == 0 and not self.fresh else 0
        paragraph = before.paragraph if kind == 0 and not self.fresh else 0
        session = 1 if kind == 2 else before.session + kind
        return State(self.last_track, self.last_end, int(self.ends[opened]), paragraph + int(self.closed[opened]), self.sessions + (session if self.fresh < 2 else 0))

    def then(self, other: Span) -> Span:
        kind = _break(State(self.last_track, self.last_end, 0, 0, 0), other)
        fresh = max(self.fresh, other.fresh, kind)
        if kind == 2:
            sessions = other.sessions + (other.fresh < 2)
        else:
            sessions = other.sessions + (self.sessions + kind if other.fresh < 2 else 0)
        if kind or other.fresh:
            ends, closed = other.ends[:1], other.closed[:1]
        else:
            ends, closed = other.ends[self.ends], other.closed[self.ends] + self.closed
        return Span(self.first_track, self.first_start, other.last_track, other.last_end, fresh, sessions, ends, closed)


def _break(before: State | None, span: Span) -> int:
    """Between a state and the span that follows: 0 for none, 1 for a silence, 2 for another track."""
    if before is None or before.track != span.first_track:
        return 2
    return int(span.first_start - before.end > GAP_MS)


class Run:
    """A batch of cues in order, each as often as ``times`` says."""

    def __init__(self, batch: pa.RecordBatch):
        self.row = np.repeat(np.arange(batch.num_rows), batch.column("times").to_numpy())
        self.n = len(self.row)
        tracks = np.empty(batch.num_rows, object)
        tracks[:] = batch.column("track").to_pylist()
        self.track = tracks[self.row]
        self.start, self.end, size = (batch.column(c).to_numpy()[self.row] for c in ("start_ms", "end_ms", "size"))
        stops = np.flatnonzero(batch.column("stop").to_numpy(zero_copy_only=False)[self.row])
        self.other, self.quiet = np.zeros(self.n, bool), np.zeros(self.n, bool)
        self.other[1:] = self.track[1:] != self.track[:-1]
        self.quiet[1:] = ~self.other[1:] & (self.start[1:] - self.end[:-1] > GAP_MS)
        self.heads = np.flatnonzero(self.other | self.quiet)
        self.total = np.append(0, np.cumsum(size + 1))
        self.next_stop = np.append(stops, self.n)[np.searchsorted(stops, np.arange(self.n + 1))]
        self.closing = self.closes(self.total[:-1])

    def closes(self, base: np.ndarray) -> np.ndarray:
        """The cue that closes a paragraph by its bytes, n if none does; cues up to j hold ``total[j + 1] - base - 1`` bytes of it."""
        enough = np.searchsorted(self.total[1:], base + 1 + ENOUGH_BYTES)
        return np.minimum(np.searchsorted(self.total[1:], base + 1 + MOST_BYTES), self.next_stop[enough])

    def base(self, opened: np.ndarray) -> np.ndarray:
        return np.where(opened > 0, -(opened + 1), 0)

    def span(self) -> Span:
        known = {self.n: (0, 0)}

        def rest(at: int) -> tuple[int, int]:
            """Bytes open at the end and paragraphs closed, if one begins at a cue and no session ends; kept for cues on the way."""
            way = []
            while at not in known:
                if self.closing[at] >= self.n:
                    known[at] = (int(self.total[self.n] - self.total[at] - 1), 0)
                else:
                    way.append(at)
                    at = int(self.closing[at]) + 1
            for back in reversed(way):
                opened, closed = known[at]
                known[back], at = (opened, closed + 1), back
            return known[at]

        if len(self.heads):
            found = [rest(int(self.heads[-1]))]
        else:
            base = self.base(np.arange(MOST_BYTES))
            first = self.closes(base)
            found = [(int(self.total[self.n] - b - 1), 0) if f >= self.n else (lambda r: (r[0], r[1] + 1))(rest(int(f) + 1)) for b, f in zip(base, first)]
        tracks = np.flatnonzero(self.other)
        sessions = int(self.quiet[tracks[-1] :].sum()) + 1 if len(tracks) else int(self.quiet.sum())
        ends, closed = (np.array(x, np.int64) for x in zip(*found, strict=True))
        return Span(self.track[0], int(self.start[0]), self.track[-1], int(self.end[-1]), 2 if len(tracks) else int(bool(len(self.heads))), sessions, ends, closed)

    def pieces(self, before: State | None) -> Iterator[tuple[int, int, int, int]]:
        """Session, paragraph, first cue and the cue after the last of each stretch of one paragraph."""
        kind = 2 if before is None or before.track != self.track[0] else int(self.start[0] - before.end > GAP_MS)
        opened, paragraph = (before.open, before.paragraph) if kind == 0 else (0, 0)
        session = 1 if kind == 2 else before.session + kind
        at = 0
        for upto in [*self.heads.tolist(), self.n]:
            while at < upto:
                shut = int(self.closes(self.base(np.array([opened])))[0]) if opened else int(self.closing[at])
                opened, end = 0, min(shut + 1, upto)
                yield session, paragraph, at, end
                paragraph, at = paragraph + 1, end
            if upto < self.n:
                session, paragraph = (1 if self.other[upto] else session + 1), 0


def _columns(track: str) -> str:
    return f"span long, first_track {track}, first_start long, last_track {track}, last_end long, fresh int, sessions long, ends array<long>, closed array<long>"


def _states(track: str) -> str:
    return f"span long, known boolean, track {track}, `end` long, open long, paragraph long, session long"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema)], schema=schema) if rows else schema.empty_table()


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _span(row: dict) -> Span:
    return Span(*(row[c] for c in Span._fields[:-2]), np.array(row["ends"]), np.array(row["closed"]))


def spans(ordered: DataFrame) -> DataFrame:
    """A row for each partition of cues in order: what it does, composed of what its batches do."""
    ddl = _columns(ordered.schema["track"].dataType.simpleString())
    schema = _arrow(ordered, ddl)

    def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = None, None
        for batch in stream:
            if batch.num_rows:
                number, own = batch.column("span")[0].as_py(), Run(batch).span()
                found = own if found is None else found.then(own)
        if found is not None:
            yield from _rows([(number, *found[:-2], found.ends.tolist(), found.closed.tolist())], schema).to_batches()

    return ordered.drop("text").mapInArrow(summed, ddl)


def composed(children: DataFrame) -> DataFrame:
    """A row for each run of spans, 64 numbers long."""
    ddl = _columns(children.schema["first_track"].dataType.simpleString())
    schema = _arrow(children, ddl)

    def fold(key, rows):
        found = reduce(Span.then, map(_span, sorted(rows.to_pylist(), key=lambda r: r["span"])))
        return _rows([(key[0].as_py(), *found[:-2], found.ends.tolist(), found.closed.tolist())], schema)

    return children.groupBy(F.floor(F.col("span") / FAN).alias("run")).applyInArrow(fold, ddl)


def entered(children: DataFrame, parents: DataFrame | None) -> DataFrame:
    """The state before each span, from that before the run it lies in; without parents all spans are one run that begins the rows."""
    track = children.schema["first_track"].dataType.simpleString()
    ddl = _states(track)
    schema = _arrow(children, ddl)
    if parents is None:
        rows = children.withColumn("run", F.lit(0))
    else:
        renamed = parents.select(F.col("span").alias("run"), *(F.col(f"`{c}`").alias(f"in_{c}") for c in ("known", *State._fields)))
        rows = children.withColumn("run", F.floor(F.col("span") / FAN)).join(renamed, "run")

    def walk(key, rows):
        listed = sorted(rows.to_pylist(), key=lambda r: r["span"])
        state = State(*(listed[0][f"in_{c}"] for c in State._fields)) if listed[0].get("in_known") else None
        out = []
        for row in listed:
            out.append((row["span"], state is not None, *(state or (None,) * 5)))
            state = _span(row).after(state)
        return _rows(out, schema)

    return rows.groupBy("run").applyInArrow(walk, ddl)


def cut(ordered: DataFrame, starts: dict[int, State | None]) -> DataFrame:
    """track, session, paragraph, place, start_ms, words: the stretches of paragraphs within batches; place puts those of one paragraph in order."""
    ddl = f"track {ordered.schema['track'].dataType.simpleString()}, session long, paragraph long, place struct<span:long,n:long>, start_ms long, words string"
    schema = _arrow(ordered, ddl)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = None, -1
        for batch in stream:
            if not batch.num_rows:
                continue
            number = batch.column("span")[0].as_py()
            state = starts[number] if n < 0 else state
            cues, texts, out = Run(batch), batch.column("text").to_pylist(), []
            for session, paragraph, at, end in cues.pieces(state):
                n += 1
                out.append((cues.track[at], session, paragraph, {"span": number, "n": n}, int(cues.start[at]), " ".join(texts[i] for i in cues.row[at:end])))
            n = max(n, 0)
            state = cues.span().after(state)
            yield from _rows(out, schema).to_batches()

    return ordered.mapInArrow(run, ddl)
