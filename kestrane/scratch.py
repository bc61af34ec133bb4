"""A folder that all executors share, for tables between the steps of a query."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, one machine).
LOCAL_SCRATCH = "/tmp/checkpoints/kestrane"

_runs: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a local default."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or LOCAL_SCRATCH).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    root = shared_root(spark)
    if root not in _runs:
        _runs[root] = f"{root}/kestrane-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _runs[root])
    return f"{_runs[root]}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p, fs = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session is already gone  # noqa: BLE001
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts lineage (a lost executor costs a re-read, not a recomputation), and turns what
    follows into a plain scan, so that adaptive execution can split skewed joins.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
