"""The log as a stream: liveness and changes kept as state for each address, resumed from checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestone.shipping import ship

LIVENESS = "natural_key long, seq long, at timestamp, state string, since_seq long, consecutive_failures long"
LIVENESS_STATE = "at timestamp, seq long, state string, since_seq long, failures long"
CHANGES = "natural_key long, seq long, kind string, from_fp string, to_fp string"
CHANGES_STATE = "at timestamp, seq long, fingerprint string"


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, some at a time: the part files of its folder, or the one file that it is."""
    path = f"{folder}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _in_order(batches: Iterator[pd.DataFrame], after: tuple | None) -> pd.DataFrame:
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    return rows if after is None else rows[[(a, s) > after for a, s in zip(rows["at"], rows["seq"])]]


def liveness_stream(log: DataFrame) -> DataFrame:
    """After each batch, the state of each address in it: as corpus.liveness_state, for records that come in order.

    A record older than what an address already has leaves its state alone; the batch query over the log is authoritative.
    State never expires: an address may be silent for years.
    """

    def fold(key, batches, state):
        at, seq, word, since, failures = state.get if state.exists else (None, None, None, None, 0)
        for row in _in_order(batches, (at, seq) if seq is not None else None).itertuples():
            if row.state != word:
                word, since = row.state, row.seq
            failures = 0 if word == "live" else failures + 1
            at, seq = row.at, row.seq
        state.update((at, seq, word, since, failures))
        yield pd.DataFrame([(key[0], seq, at, word, since, failures)], columns=["natural_key", "seq", "at", "state", "since_seq", "consecutive_failures"])

    ship(log.sparkSession)
    rows = log.select("natural_key", "seq", "at", "state")
    return rows.groupBy("natural_key").applyInPandasWithState(fold, LIVENESS, LIVENESS_STATE, "append", GroupStateTimeout.NoTimeout)


def change_stream(log: DataFrame) -> DataFrame:
    """Appearances and modifications as they come, for observations in order; older ones than the last are left out."""

    def fold(key, batches, state):
        at, seq, fingerprint = state.get if state.exists else (None, None, None)
        out = []
        for row in _in_order(batches, (at, seq) if seq is not None else None).itertuples():
            if row.fingerprint != fingerprint:
                out.append((key[0], row.seq, "modified" if fingerprint is not None else "appeared", fingerprint, row.fingerprint))
            at, seq, fingerprint = row.at, row.seq, row.fingerprint
        if seq is not None:
            state.update((at, seq, fingerprint))
        yield pd.DataFrame(out, columns=["natural_key", "seq", "kind", "from_fp", "to_fp"])

    ship(log.sparkSession)
    rows = log.where("state = 'live'").select("natural_key", "seq", "at", "fingerprint")
    return rows.groupBy("natural_key").applyInPandasWithState(fold, CHANGES, CHANGES_STATE, "append", GroupStateTimeout.NoTimeout)


def daily_counts(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Records by day and state, complete days only: a day closes when the newest record is `late` after its end."""
    return log.withWatermark("at", late).groupBy(F.window("at", "1 day"), "state").agg(F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, gap: str, late: str = "2 days") -> DataFrame:
    """natural_key, start, end, records: visits of an address, cut where it is silent for ``gap``; ``end`` is its last record's time and the gap.

    In a stream a session is said once, when the newest record is ``late`` after its end: a record that comes later than that is no
    part of any. A batch says all sessions, open ones too. Records without a time or an address are of no session.
    State holds open sessions, not their records.
    """
    rows = log.where("at is not null and natural_key is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    found = rows.groupBy("natural_key", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return found.select("natural_key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def resumed(stream: DataFrame, output: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append") -> None:
    """Processes what has arrived since the last call, and ends.

    Each batch overwrites its own folder, so a batch repeated after a failure leaves one copy of its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(results: DataFrame) -> DataFrame:
    """The newest row of each address among the results of liveness_stream."""
    rows = [c for c in ("seq", "at", "state", "since_seq", "consecutive_failures")]
    return results.groupBy("natural_key").agg(F.max_by(F.struct(*rows), F.struct("at", "seq")).alias("r")).select("natural_key", "r.state", "r.since_seq", "r.consecutive_failures")
