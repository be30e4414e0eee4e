"""The log as a stream whose records may come late and in any order: nothing is dropped, what changes is corrected.

State is kept for each bucket of addresses and span of time, so an address with a third of the log is many keys, and a late
record touches the records of its own bucket and span alone. A span of an address emits what it adds to and takes back from the
changes that lie within it, and a summary; the views join spans up. Addresses share keys since a visit of a key costs a Python
task about as much as a thousand records do: work then follows the records and not the addresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from lodestone.shipping import ship

#: What stands for a missing time: before all others, as null sorts.
NO_TIME = -(2**63)
#: What is kept of a key: how often it was visited, and its records in order of (natural_key, at, seq) as a stream of Arrow.
STATE = "version long, records binary"
_RECORDS = pa.schema([("natural_key", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("state", pa.string()), ("fingerprint", pa.string())])
#: A change within a span has op 1, one that is taken back -1, a summary 0. Older versions of a summary are superseded.
RESULTS = (
    "natural_key long, span long, version long, op int, seq long, from_fp string, to_fp string,"
    " records long, head_seq long, state string, entered_seq long, uniform boolean, lived boolean, failures long, first_seen long, first_fp string, last_fp string"
)
_COLUMNS = [part.split()[0] for part in RESULTS.split(",")]


def _frame(n: int, **columns) -> pd.DataFrame:
    """Rows of RESULTS; columns that aren't named are null."""
    return pd.DataFrame({c: columns.get(c, np.full(n, None)) for c in _COLUMNS})


class _Records:
    """Records, and figures of runs of them that are given by their places in order of (natural_key, at, seq)."""

    def __init__(self, table: pa.Table):
        self.key, self.at, self.seq = (table[c].to_numpy() for c in ("natural_key", "at", "seq"))
        self.states, self.state = self._coded(table["state"])
        self.prints, self.print = self._coded(table["fingerprint"])
        self.live = pc.equal(table["state"], "live").fill_null(False).to_numpy()

    @staticmethod
    def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Values, the last of which is null, and each row's place among them (-1: null)."""
        coded = pa.concat_arrays(column.chunks).dictionary_encode()
        return np.append(np.array(coded.dictionary.to_pylist(), object), None), coded.indices.fill_null(-1).to_numpy().astype(np.int64)

    def in_order(self) -> np.ndarray:
        """The places of all records in order; of those with one address, time and seq the last that came."""
        order = np.lexsort((self.seq, self.at, self.key))  # a stable sort
        after, before = order[1:], order[:-1]
        return order[np.append((self.key[after] != self.key[before]) | (self.at[after] != self.at[before]) | (self.seq[after] != self.seq[before]), True)]

    def changes(self, order: np.ndarray) -> np.ndarray:
        """natural_key, seq, from and to of each address's observations, after its first, whose fingerprint differs from the one before."""
        seen = order[self.live[order]]
        now, was = seen[1:], seen[:-1]
        new = (self.print[was] < 0) | ((self.print[now] >= 0) & (self.print[now] != self.print[was]))
        now, was = (x[(self.key[seen[1:]] == self.key[seen[:-1]]) & new] for x in (now, was))
        return np.stack([self.key[now], self.seq[now], self.print[was], self.print[now]], axis=1)

    def summaries(self, order: np.ndarray, version: int, span: int) -> pd.DataFrame:
        """A row of each address: the last kinds of figures of RESULTS."""
        key, state, live, at = self.key[order], self.state[order], self.live[order], np.arange(len(order))
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(heads[1:], len(order))
        now = state[ends - 1]
        entered = np.maximum(np.maximum.reduceat(np.where(state != np.repeat(now, ends - heads), at, -1), heads) + 1, heads)
        last = np.maximum.reduceat(np.where(live, at, -1), heads)
        first = np.minimum.reduceat(np.where(live, at, len(order)), heads)
        lived = last >= 0
        first = np.where(lived, first, 0)  # of addresses without a live record nothing is taken from there
        seen = lambda values: np.where(lived, values.astype(object), None)
        return _frame(
            len(heads), natural_key=key[heads], span=np.full(len(heads), span), version=np.full(len(heads), version), op=np.zeros(len(heads), np.int32), records=ends - heads, head_seq=self.seq[order[heads]], state=self.states[now], entered_seq=self.seq[order[entered]],
            uniform=entered == heads, lived=lived, failures=np.where(lived, ends - 1 - last, ends - heads), first_seen=seen(self.seq[order[first]]), first_fp=seen(self.prints[self.print[order[first]]]), last_fp=seen(self.prints[self.print[order[last]]]),
        )


class SpansInOrder(StatefulProcessor):
    """Keeps the records of a bucket of addresses and a span in order of (natural_key, at, seq); a record that comes again replaces itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, span = self.kept.get(), key[1]
        version, old = (state[0], pa.ipc.open_stream(state[1]).read_all()) if state else (0, _RECORDS.empty_table())
        new = pa.concat_tables([pa.Table.from_pandas(r[_RECORDS.names], _RECORDS, preserve_index=False) for r in rows])
        both = pa.concat_tables([old, new])
        records = _Records(both)
        order = records.in_order()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _RECORDS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(both.take(pa.array(order)))
        self.kept.update((version + 1, sink.getvalue().to_pybytes()))
        # Only addresses with a record that has come can have changed.
        touched = np.unique(records.key[len(old) :])
        after, before = order[np.isin(records.key[order], touched)], np.flatnonzero(np.isin(records.key[: len(old)], touched))
        earlier, later = records.changes(before), records.changes(after)
        found, place = np.unique(np.concatenate([earlier, later]), axis=0, return_inverse=True)
        more = np.bincount(place.ravel()[len(earlier) :], minlength=len(found)) - np.bincount(place.ravel()[: len(earlier)], minlength=len(found))
        n = np.abs(more)
        if n.any():
            found, op = np.repeat(found, n, axis=0), np.repeat(np.sign(more), n).astype(np.int32)
            yield _frame(len(op), natural_key=found[:, 0], span=np.full(len(op), span), version=np.full(len(op), version + 1), op=op, seq=found[:, 1], from_fp=records.prints[found[:, 2]], to_fp=records.prints[found[:, 3]])
        yield records.summaries(after, version + 1, span)

    def close(self) -> None:
        pass


def spans_in_order(log: DataFrame, span_seconds: int = 86_400, buckets: int = 256) -> DataFrame:
    """The streamed log (natural_key, seq, at, state, fingerprint) as corrections: see RESULTS.

    Records may come in any order and any time later; (at, seq) names a record of an address, and one that comes again
    replaces itself. Records without a time come before all others; those without an address or seq are left out, those
    without a state are failures of state null. The records of a span and of the addresses of a bucket meet in one task: ``span_seconds`` and
    ``buckets`` bound what that is (some dozens of addresses a bucket serve well), and state grows with the log, since a late record may fall anywhere.
    A checkpoint goes on with the spans and buckets that it began with. Needs the state store that keeps state on disk.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)
    local = log.schema["at"].dataType == TimestampNTZType()  # no zone, so no zone may put it in another order
    at = F.coalesce(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', at)") if local else F.unix_micros("at"), F.lit(NO_TIME))
    bucket = F.pmod(F.xxhash64("natural_key"), F.lit(buckets).cast("long")).alias("bucket")
    rows = log.where("natural_key is not null and seq is not null").select(bucket, F.col("natural_key").cast("long"), F.floor(at / F.lit(span_seconds * 1_000_000)).cast("long").alias("span"), at.alias("at"), F.col("seq").cast("long"), "state", "fingerprint")
    return rows.groupBy("bucket", "span").transformWithStateInPandas(SpansInOrder(), RESULTS, "append", "none")


def _summaries(results: DataFrame) -> DataFrame:
    """The newest summary of each address and span."""
    columns = [c for c in _COLUMNS if c not in ("natural_key", "span", "version", "op", "seq", "from_fp", "to_fp")]
    newest = results.where("op = 0").groupBy("natural_key", "span").agg(F.max_by(F.struct(*columns), "version").alias("r"))
    return newest.select("natural_key", "span", "r.*")


def liveness(results: DataFrame) -> DataFrame:
    """natural_key, state, since_seq, consecutive_failures: as corpus.liveness_state over all records that have come.

    An address's spans are folded by partial aggregates: the last that isn't wholly in the present state, the last with
    a live record, and then what came after these.
    """
    spans = _summaries(results)
    now = spans.groupBy("natural_key").agg(F.max_by("state", "span").alias("now"), F.max(F.when(F.col("lived"), F.col("span"))).alias("lived_span"))
    known = spans.join(now, "natural_key")
    same = F.col("state").eqNullSafe(F.col("now"))
    left = known.where(~(F.col("uniform") & same)).groupBy("natural_key").agg(F.max("span").alias("left_span"))
    known = known.join(left, "natural_key", "left")
    inside = F.when(F.col("left_span").isNull() | (F.col("span") > F.col("left_span")), F.col("head_seq")).when((F.col("span") == F.col("left_span")) & same, F.col("entered_seq"))
    failed = F.when(F.col("lived_span").isNull() | (F.col("span") > F.col("lived_span")), F.col("records")).when(F.col("span") == F.col("lived_span"), F.col("failures")).otherwise(0)
    found = known.groupBy("natural_key").agg(F.any_value("now").alias("state"), F.min(F.when(inside.isNotNull(), F.struct("span", inside.alias("seq")))).alias("since"), F.sum(failed).alias("consecutive_failures"))
    return found.select("natural_key", "state", F.col("since.seq").alias("since_seq"), "consecutive_failures")


def changes(results: DataFrame) -> DataFrame:
    """natural_key, seq, kind, from_fp, to_fp: as corpus.change_events over all records that have come.

    Within spans, what was emitted and not taken back; between spans, the first observation of one against the last of
    the one before. An address's window holds a row for each of its spans.
    """
    inside = results.where("op <> 0").groupBy("natural_key", "seq", "from_fp", "to_fp").agg(F.sum("op").alias("n")).where("n > 0").drop("n")
    edges = _summaries(results).where("lived").withColumn("from_fp", F.lag("last_fp").over(Window.partitionBy("natural_key").orderBy("span")))
    edges = edges.where("from_fp is null or from_fp <> first_fp").select("natural_key", F.col("first_seen").alias("seq"), "from_fp", F.col("first_fp").alias("to_fp"))
    return inside.unionByName(edges).select("natural_key", "seq", F.when(F.col("from_fp").isNull(), "appeared").otherwise("modified").alias("kind"), "from_fp", "to_fp")
