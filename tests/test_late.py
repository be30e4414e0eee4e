"""Streams of records that come late, twice and in any order, against the batch queries over the whole log."""

import datetime

import numpy as np

from lodestone.operators import corpus
from lodestone.streaming import late
from lodestone.streaming import log as streams

SCHEMA = "natural_key long, seq long, at timestamp, state string, fingerprint string"


def _key(df, columns):
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


def test_late_records_correct_what_was_said(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=int(n))
    rows = [(int(rng.integers(4)), n, at(n // 2), str(rng.choice(["live", "live", "gone", "error"])), f"f{rng.integers(3)}") for n in range(240)]
    rows += [(7, 1000, at(5), "gone", None), (8, 1001, at(5), "live", "f0"), (8, 1002, None, "live", "f1")]  # never live; a record without a time
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    parts, sent = [mixed[:3], mixed[3:90], mixed[60:200], mixed[200:]], []  # the third part repeats records of the second
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        sent += [r for r in part if r not in sent]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        streams.resumed(late.spans_in_order(spark.readStream.schema(SCHEMA).parquet(folder)), f"{out}/rows", f"{out}/checkpoint")
        results, log = spark.read.parquet(f"{out}/rows").drop("batch"), spark.createDataFrame(sent, SCHEMA)
        columns = ["natural_key", "state", "since_seq", "consecutive_failures"]
        assert _key(late.liveness(results), columns) == _key(corpus.liveness_state(log), columns)
        columns = ["natural_key", "seq", "kind", "from_fp", "to_fp"]
        assert _key(late.changes(results), columns) == _key(corpus.change_events(log), columns)
    assert results.where("op = -1").count() > 0  # something was taken back


def test_addresses_share_keys_of_state(spark, tmp_path):
    """Keys follow buckets and spans, not addresses; records without a fingerprint, with one seq at two times, and twice in a batch."""
    rng = np.random.default_rng(4)
    at = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=int(n))
    rows = [(int(rng.integers(-150, 150)), n // 2, at(rng.integers(4000)), [None, "live", "live", "gone"][rng.integers(4)], [None, "a", "b"][rng.integers(3)]) for n in range(3000)]
    rows = list({(r[0], r[2], r[1]): r for r in rows}.values())
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:1000] + rows[:200], rows[800:1900], rows[1900:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        streams.resumed(late.spans_in_order(spark.readStream.schema(SCHEMA).parquet(folder), buckets=4), f"{out}/rows", f"{out}/checkpoint")
    results, log = spark.read.parquet(f"{out}/rows").drop("batch"), spark.createDataFrame(rows, SCHEMA)
    columns = ["natural_key", "state", "since_seq", "consecutive_failures"]
    assert _key(late.liveness(results), columns) == _brute_liveness(rows)
    columns = ["natural_key", "seq", "kind", "from_fp", "to_fp"]
    assert _key(late.changes(results), columns) == _key(corpus.change_events(log), columns)
    kept = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "kept").load()
    assert kept.count() <= 4 * len({r[2].date() for r in rows}) < len({(r[0], r[2].date()) for r in rows})


def _brute_liveness(rows):
    found = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        states = [r[3] for r in mine]
        entered = next(i for i in range(len(mine)) if all(s == states[-1] for s in states[i:]))
        failures = next((n for n, s in enumerate(reversed(states)) if s == "live"), len(states))
        found.append((key, states[-1], mine[entered][1], failures))
    return sorted(found, key=repr)


def test_no_record(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    results = spark.createDataFrame([], late.RESULTS)
    assert late.liveness(results).count() == 0 and late.changes(results).count() == 0


def test_sessions_are_said_once_when_closed(spark, tmp_path):
    at = lambda hours: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hours)
    rows = [(1, 0, at(0), "live", "f"), (1, 1, at(2), "gone", None), (1, 2, at(10), "live", "f"), (2, 3, at(1), "live", "f"), (1, 4, None, "live", "f"), (None, 5, at(1), "live", "f")]
    last = [(1, 6, at(9), "live", "f"), (3, 7, at(100), "live", "f")]  # one comes late, into an open session; one closes all others
    folder, out, done = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in (rows, last):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        streams.resumed(streams.sessions(spark.readStream.schema(SCHEMA).parquet(folder), "3 hours", "1 day"), f"{out}/rows", f"{out}/checkpoint")
        done.append(_key(spark.read.parquet(f"{out}/rows"), ["natural_key", "start", "end", "records"]))
    want = [(1, at(0), at(5), 2), (1, at(9), at(13), 2), (2, at(1), at(4), 1)]
    assert done == [[], sorted(want, key=repr)]
    whole = streams.sessions(spark.createDataFrame(rows + last, SCHEMA), "3 hours", "1 day")
    assert _key(whole, ["natural_key", "start", "end", "records"]) == sorted([*want, (3, at(100), at(103), 1)], key=repr)
