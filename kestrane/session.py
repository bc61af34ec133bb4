"""Session factory: UTC, adaptive execution, sizes that suit the cluster's memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Profiles of the session: shuffle partitions before adaptive coalescing, and file split size.
PROFILES = {"local": ("8", "64m"), "cluster": ("4000", "256m")}


def session(app: str = "kestrane", profile: str = "local", master: str | None = None, **conf: str) -> SparkSession:
    partitions, split = PROFILES[profile]
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.files.maxPartitionBytes": split,
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
