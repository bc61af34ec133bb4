"""Chunks of a source that are written exactly once, and counters taken while rows are written.

A chunk is a folder of its own, named by the hash of its source and its number, and counts only
once it is in the log of commits beside the chunks. A chunk that was written but not logged, as
its run died between the two, is logged without being written again; one that was written in
part is written anew; one in the log is skipped. Readers see the chunks of the log alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import exists

COMMITS = "source string, batch long, at timestamp"
LOADS = "source string, status string, leidas long, insertadas long, omitidas long, message string, at timestamp"


def _log(spark: SparkSession, path: str) -> DataFrame:
    at = f"{path}/_commits"
    return spark.read.schema(COMMITS).parquet(at) if exists(spark, at) else spark.createDataFrame([], COMMITS)


def _entry(path: str, source: str, batch: int) -> str:
    """A commit's folder in the log: one each, so that writers never meet in one."""
    return f"{path}/_commits/chunk={source}.{batch}"


def is_committed(spark: SparkSession, path: str, source: str, batch: int) -> bool:
    return exists(spark, f"{_entry(path, source, batch)}/_SUCCESS")


def commit(spark: SparkSession, path: str, source: str, batch: int) -> None:
    rows = spark.createDataFrame([(source, batch)], "source string, batch long")
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(_entry(path, source, batch))


def write_once(df: DataFrame, path: str, source: str, batch: int) -> str:
    """Add chunk `batch` of a source to the table at `path`; "written", "logged" if it was there already, or "skipped"."""
    spark = df.sparkSession
    if is_committed(spark, path, source, batch):
        return "skipped"
    chunk = f"{path}/source={source}/batch={batch}"
    whole = exists(spark, f"{chunk}/_SUCCESS")  # Spark's writers leave it last
    if not whole:
        df.write.mode("overwrite").parquet(chunk)
    commit(spark, path, source, batch)
    return "logged" if whole else "written"


def once(path: str, source: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a stream that starts again from its checkpoint gives the same batches the same numbers."""

    def write(df: DataFrame, batch: int) -> None:
        write_once(df, path, source, batch)

    return write


def read_committed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of all committed chunks."""
    columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = StructType([*columns, *StructType.fromDDL("source string, batch long")])
    rows = spark.read.schema(stored).parquet(path) if exists(spark, path) else spark.createDataFrame([], stored)
    log = _log(spark, path).select("source", "batch")
    return rows.join(log, ["source", "batch"], "left_semi").select(*columns.names)


def write_counted(df: DataFrame, good: Column, write: Callable[[DataFrame], None], ledger: str, source: str) -> dict[str, int]:
    """Write the rows that are good, and put into the ledger how many were read, inserted and skipped.

    The counts are taken by the write as it runs: df is worked out once. A write that fails is
    put into the ledger with its message, and raised. `good` that is null is not good.
    """
    spark, seen = df.sparkSession, Observation()
    rows = df.withColumn("__good", F.coalesce(good, F.lit(False))).observe(seen, F.count("*").alias("leidas"), F.count_if("__good").alias("insertadas"))
    try:
        write(rows.filter("__good").drop("__good"))
    except Exception as e:
        _tell(spark, ledger, (source, "error", None, None, None, f"{type(e).__name__}: {e}".splitlines()[0][:500]))
        raise
    counts = seen.get
    counts["omitidas"] = counts["leidas"] - counts["insertadas"]
    _tell(spark, ledger, (source, "ok", counts["leidas"], counts["insertadas"], counts["omitidas"], None))
    return counts


def _tell(spark: SparkSession, ledger: str, event: tuple) -> None:
    rows = spark.createDataFrame([event], LOADS.removesuffix(", at timestamp"))
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(f"{ledger}/event={uuid.uuid4().hex}")


def loads(spark: SparkSession, ledger: str) -> DataFrame:
    """(source, status, leidas, insertadas, omitidas, message) of each source as last recorded."""
    last = F.max_by(F.struct("status", "leidas", "insertadas", "omitidas", "message"), "at").alias("x")
    return spark.read.schema(LOADS).parquet(ledger).groupBy("source").agg(last).select("source", "x.*")
