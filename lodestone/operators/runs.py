"""The journal of runs: history, what they added and lost, and the health of schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES = ("failed", "partial")
NEUTRAL = ("skipped", "interrupted")


def run_history(journal: DataFrame, schedule: str | None = None, failed: bool = False, since: str | None = None, run: str | None = None, most: int = 20) -> DataFrame:
    """Attempts, newest first; skipped and interrupted ones are no failures. `run` is a prefix of the id."""
    rows = journal
    if schedule is not None:
        rows = rows.where(F.col("schedule") == schedule)
    if failed:
        rows = rows.where(F.col("outcome").isin(*FAILURES))
    if since is not None:
        rows = rows.where(F.col("started_at") >= F.lit(since).cast("timestamp"))
    if run is not None:
        rows = rows.where(F.col("run_id").startswith(run))
    return rows.orderBy(F.desc("run_id")).limit(most)


def runs_named(journal: DataFrame, prefix: str) -> DataFrame:
    """Attempts whose id begins with a prefix, newest first; where several do, each says that the prefix is ambiguous."""
    found = journal.where(F.col("run_id").startswith(prefix))
    n = found.agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return found.join(F.broadcast(n)).orderBy(F.desc("run_id"))  # one row


def run_arithmetic(stages: DataFrame) -> DataFrame:
    """Additions and the four kinds of absence of each run, from rows (run_id, stage, key, value)."""

    def total(key: str, *within: str):
        return F.coalesce(F.sum(F.when((F.col("key") == key) & F.col("stage").isin(*within), F.col("value"))), F.lit(0)).cast("long")

    return stages.groupBy("run_id").agg(
        total("new", "collect").alias("documents"),
        total("new", "extract", "transcribe").alias("derived"),
        total("new", "embed").alias("chunks"),
        total("vanished", "discover").alias("vanished"),
        total("gone", "collect").alias("gone"),
        total("blocked", "collect").alias("blocked"),
        total("errored", "collect").alias("errored"),
    )


def schedule_health(journal: DataFrame) -> DataFrame:
    """Each schedule's last outcome and how many failures in a row lead to now, skipped and interrupted attempts left out.

    The count is of failures after the newest attempt that succeeded, so no schedule's journal is gathered or sorted.
    """
    last_good = journal.where(~F.col("outcome").isin(*FAILURES, *NEUTRAL)).groupBy("schedule").agg(F.max("run_id").alias("good"))
    counted = F.col("outcome").isin(*FAILURES) & (F.col("good").isNull() | (F.col("run_id") > F.col("good")))
    return (
        journal.join(last_good, "schedule", "left")  # Spark broadcasts it by its measured size
        .groupBy("schedule")
        .agg(F.max_by("outcome", "run_id").alias("last_outcome"), F.max("run_id").alias("last_run"), F.count_if(counted).alias("consecutive_failures"))
    )
