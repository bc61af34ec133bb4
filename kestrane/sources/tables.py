"""Stored tables that batches are merged into. One writer at a time; readers see whole tables.

A table is replaced as a whole (`swap_write`, `merge_write`), or, where it is stored by the
values of some columns, only in the partitions that a batch touches (`merge_partitions`).
A write that died on the way is put right by the next one (`recover`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import Sequenced, fold_not_null, insert_ignore, keep_first, keep_last, merge_coalesce, merge_replace
from ..scratch import hadoop_path, materialise

Merge = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]

#: How the rows of one key in a batch become one row, by the merge that follows.
_COMBINED = {merge_replace: keep_last, insert_ignore: keep_first, merge_coalesce: fold_not_null}


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename, or OSError: file systems may only return false."""
    (a, fs), (b, _) = hadoop_path(spark, source), hadoop_path(spark, target)
    if not fs.rename(a, b) or not fs.exists(b):
        raise OSError(f"could not rename {source} to {target}")


def swap_write(df: DataFrame, path: str) -> None:
    """Replace the table at `path` as a whole: it is written beside it, and takes its place by renaming.

    df may read from the old table. A run that fails before the renaming leaves the old table;
    if the new one cannot take its place the old one is put back, and a run that dies between the
    two is put right by `recover`. The old table is removed only when the new one is seen.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:12]
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(new)
    had = exists(spark, path)
    if had:
        _rename(spark, path, old)
    try:
        _rename(spark, new, path)
    except Exception:
        if had and not exists(spark, path):
            _rename(spark, old, path)
        raise
    if had:
        remove(spark, old)


def recover(spark: SparkSession, path: str) -> None:
    """Put right what a writer that died has left at `path`: an old table that is aside comes back, a merge of partitions is finished or dropped."""
    p, fs = hadoop_path(spark, path)
    beside = [s.getPath() for s in fs.listStatus(p.getParent())] if fs.exists(p.getParent()) else []
    aside = [x for x in beside if x.getName().startswith(f"{p.getName()}.old-")]
    if aside and not fs.exists(p):
        _rename(spark, aside[0].toString(), path)
    redo = f"{path}.redo"
    if exists(spark, f"{redo}/_SUCCESS"):
        _finish(spark.read.schema(_schema(spark, path)).parquet(redo), path, _stored_by(spark, redo))
    elif exists(spark, redo):
        remove(spark, redo)


def merge_write(batch: DataFrame, path: str, keys: Sequence[str], sequence: Sequenced = (), how: Merge = merge_replace) -> DataFrame:
    """Merge a batch into the table at `path`; gives the table as read back.

    A first batch makes the table. `sequence` orders the rows of a batch (a file's place in the
    order of files, then its rows); its columns are stored only if the table has them. `how`:
    the new row wins (its last one of a key), the old row stays, or column by column the new value that is not null.
    """
    spark = batch.sparkSession
    recover(spark, path)
    merged = _COMBINED[how](batch, keys, sequence)
    if exists(spark, path):
        old = spark.read.parquet(path)
        merged = how(old, merged.select(*old.columns), keys)
    swap_write(merged, path)
    return spark.read.schema(merged.schema).parquet(path)


# Tables stored by the values of columns -----------------------------------------------------


def _stored_by(spark: SparkSession, path: str) -> list[str]:
    """The columns by whose values the table at `path` is stored, from the names of its folders."""
    p, fs = hadoop_path(spark, path)
    out = []
    while inner := next((s.getPath() for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()), None):
        out.append(inner.getName().split("=")[0])
        p = inner
    return out


def _schema(spark: SparkSession, path: str) -> StructType:
    """The schema of the table at `path` as its first batch had it: names of folders do not tell types."""
    return StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first().value))


def partition_filter(by: Sequence[str], values: Sequence[Sequence]) -> Column:
    """Which rows are in one of the partitions: a condition on partition columns alone, so that no other folder is listed or read."""
    if len(by) == 1:
        known = [v[0] for v in values if v[0] is not None]
        null = F.col(by[0]).isNull() if len(known) < len(values) else F.lit(False)
        return F.col(by[0]).isin(known) | null if known else null
    each = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(x)) for c, x in zip(by, v)]) for v in values]
    return reduce(Column.__or__, each, F.lit(False))


def _finish(merged: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that merged has rows of, and drop the copy it was read from."""
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    remove(merged.sparkSession, f"{path}.redo")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table that `merge_partitions` keeps."""
    recover(spark, path)
    return spark.read.schema(_schema(spark, path)).parquet(path)


def merge_partitions(batch: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], sequence: Sequenced = (), how: Merge = merge_replace) -> DataFrame:
    """Merge a batch into a table that is stored by the values of `by`, some of the keys; gives the table as read back.

    Only the partitions that the batch touches are read, merged and replaced; the files of all
    others stay as they are. The merged partitions are first written beside the table, so a
    writer that dies while it replaces them loses nothing: `recover` replaces them again.
    Partitions are cut into files by size, so that a value with many rows costs no task of its own.
    """
    if not set(by) <= set(keys):
        raise ValueError(f"{set(by) - set(keys)} are no keys: a row could change its partition")
    spark = batch.sparkSession
    recover(spark, path)
    merged = materialise(_COMBINED[how](batch, keys, sequence), "batch")
    touched = [tuple(r) for r in merged.select(*by).distinct().collect()]  # a row for each partition
    if not touched:
        return read_stored(spark, path) if exists(spark, path) else merged
    if exists(spark, path):
        schema = _schema(spark, path)
        old = spark.read.schema(schema).parquet(path).filter(partition_filter(by, touched))
        merged = how(old, merged.select(*schema.names), keys)
    else:
        schema = merged.schema
        spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.schema")
    redo = f"{path}.redo"
    merged.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(redo)
    _finish(spark.read.schema(schema).parquet(redo), path, by)
    return read_stored(spark, path)


# Rows ---------------------------------------------------------------------------------------


def append_write(batch: DataFrame, path: str) -> None:
    """Add the rows of a batch, without keys."""
    batch.write.mode("append").parquet(path)


def delete_rows(spark: SparkSession, path: str, condition: str) -> DataFrame:
    """Remove the rows that meet a condition (SQL); those for which it is null stay."""
    recover(spark, path)
    kept = spark.read.parquet(path).filter(f"NOT coalesce({condition}, false)")
    swap_write(kept, path)
    return spark.read.schema(kept.schema).parquet(path)
