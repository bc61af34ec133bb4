"""A ledger of processed files by content hash, kept as Parquet: one row per event, the latest counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import hadoop_path, materialise

LEDGER = "sha256 string, path string, status string, at timestamp"


def pending(files: DataFrame, ledger: DataFrame, *done: str) -> DataFrame:
    """Files whose content is not in the ledger as done ("ok", or the states named); those that failed come again."""
    return files.join(ledger.filter(F.col("status").isin(*(done or ("ok",)))).select("sha256"), "sha256", "left_anti")


def normalise_pending(spark: SparkSession, folder: str, ledger_path: str, out: str, read: Callable[[Sequence[str]], DataFrame], pattern: str = "*.csv") -> int:
    """Normalise the files whose content the ledger does not know yet; how many there were.

    `read` gives the rows of the files at some paths, with _source_file. They are stored at
    `out` by the hash of their file, so that a run that died is repeated without harm.
    """
    files = pending(hashed_files(spark, folder, pattern), latest(spark, ledger_path), "normalized", "loaded")
    files = materialise(files.withColumn("_source_file", F.element_at(F.split("path", "/"), -1)), "pending")
    paths = [r.path for r in files.select("path").collect()]  # the driver knows their names already
    if paths:
        rows = read(paths).join(files.select("_source_file", "sha256"), "_source_file")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha256").parquet(out)
        record(files, ledger_path, "normalized")
    return len(paths)


def load_normalised(spark: SparkSession, ledger_path: str, normalised: str, table: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Load the files that are normalised and not loaded yet, each into its own partition of the table, and mark them loaded; how many there were."""
    waiting = materialise(latest(spark, ledger_path).filter("status = 'normalized'"), "waiting")
    n = waiting.count()
    if n:
        rows = spark.read.parquet(normalised).join(waiting.select("sha256"), "sha256", "left_semi")
        change(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha256").parquet(table)
        record(waiting, ledger_path, "loaded")
    return n


#: Files up to which the executors hash them, each in one piece; larger ones are hashed as streams.
WHOLE = 1 << 30


def hashed_files(spark: SparkSession, folder: str, pattern: str = "*.csv", whole: int = WHOLE) -> DataFrame:
    """(path, sha256, length) of the files under a folder; Spark cannot load a file of 2 GB as one value, so files above `whole` are read by streams."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = files.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"), "length")
    large = [(r.path, _streamed_sha256(spark, r.path), r.length) for r in files.filter(F.col("length") > whole).select("path", "length").toLocalIterator()]
    return small.unionByName(spark.createDataFrame(large, "path string, sha256 string, length long")) if large else small


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def record(files: DataFrame, ledger_path: str, status: str) -> None:
    """Append one event a file."""
    files.select("sha256", "path", F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("append").parquet(ledger_path)


def latest(spark: SparkSession, ledger_path: str) -> DataFrame:
    """(sha256, path, status) as last recorded; an empty table where there is no ledger yet."""
    try:
        events = spark.read.schema(LEDGER).parquet(ledger_path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "sha256 string, path string, status string")
    return events.groupBy("sha256").agg(F.max_by(F.struct("path", "status"), "at").alias("x")).select("sha256", "x.*")


def verify(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(status, n): how many of the expected (path, sha256) are ok, corrupt or missing."""
    got = files.select("path", F.col("sha256").alias("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("corrupt")
    return expected.join(got, "path", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
