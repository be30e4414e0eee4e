"""Append-only tables: the observation log, blobs by hash, and vectors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "source string, natural_key string, seq long, at timestamp, state string, fingerprint string, detail string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir, or a local one where that is unset on a local master, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodestone-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, its partitions and their order kept under the folder of `scratch`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def append_log(records: DataFrame, folder: str) -> None:
    """Appends records as JSON lines, in a folder for each source and month of `at`."""
    records.withColumn("month", F.date_format("at", "yyyy-MM")).write.mode("append").partitionBy("source", "month").json(folder)


def read_log(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """All records, or a source's; a line that isn't a record fails the query. Order is `at`, `seq`: files have none."""
    rows = spark.read.schema(LOG_SCHEMA + ", month string").option("mode", "FAILFAST").json(folder)
    return rows if source is None else rows.where(F.col("source") == source)


def read_journal(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of a journal; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def append_journal(records: DataFrame, folder: str) -> None:
    """Appends records (with ``started_at``) as JSON lines, in a folder for each month of their start."""
    records.withColumn("month", F.date_format("started_at", "yyyy-MM")).write.mode("append").partitionBy("month").json(folder)


def put_blobs(incoming: DataFrame, folder: str) -> None:
    """Adds the blobs (bytes) whose hash isn't stored yet; a repeated call adds nothing."""
    spark = incoming.sparkSession
    blobs = incoming.select("bytes").where("bytes is not null").withColumn("sha", F.sha2("bytes", 256)).dropDuplicates(["sha"])
    if exists(spark, folder):
        blobs = blobs.join(spark.read.schema("bytes binary, sha string").parquet(folder).select("sha"), "sha", "left_anti")
    blobs.select("bytes", "sha").write.mode("append").parquet(folder)


def blob_count(spark: SparkSession, folder: str) -> int:
    """How many blobs are stored; only the files' footers are read."""
    return spark.read.schema("bytes binary, sha string").parquet(folder).count() if exists(spark, folder) else 0


def append_vectors(vectors: DataFrame, folder: str, model: str, dims: int) -> None:
    """Appends (chunk_hash, vector) rows of a model; a row of another width fails the job, another model or width is refused before it."""
    stored = stored_model(vectors.sparkSession, folder)
    if stored not in (None, (model, dims)):
        raise ValueError(f"{folder} holds vectors of {stored}, not of {(model, dims)}")
    checked = F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of another width: "), "chunk_hash")))
    vectors.select("chunk_hash", checked.alias("vector"), F.lit(model).alias("model"), F.lit(dims).alias("dims")).write.mode("append").partitionBy("model", "dims").parquet(folder)


def stored_model(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """Model and width of a vector table, from its folders' names; None where there is none yet."""
    if not exists(spark, folder):
        return None
    row = spark.read.schema("chunk_hash string, vector array<float>, model string, dims int").parquet(folder).select("model", "dims").first()
    return (row["model"], row["dims"]) if row else None
