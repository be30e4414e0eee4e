"""What every operator of this folder needs from the session: checkpoints, hashing rules, sizes."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share (spark.checkpoint.dir).

    The folder is the cluster's; only where the setting is absent on a local master, as in tests, one is made here.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_chars(docs: DataFrame, column: str = "text") -> int:
    """Characters of the whole column; one aggregate over one column."""
    return docs.agg(F.sum(F.length(column))).first()[0] or 0


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
