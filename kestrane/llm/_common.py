"""Helpers shared by the operators: Arrow map functions, and what the contracts call text and white space."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, shared_path  # noqa: F401  for the operators

#: Fixed value: one run of characters that the contracts call white space.
WHITE = r"[\x20\x09-\x0D]+"

#: Rows of a batch that are worked on at a time.
SLICE = 1000

def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], schema: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Apply a Python function to Arrow batches.

    `make` is called once a task and gives a function from the batch's columns, as
    Python lists by keyword, to a dict of result columns. `close`, if given, runs when the
    task ends: workers are used again, and should not keep what only this operator needs.
    """
    types = _arrow_schema(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            out = work(**{n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
        if close:
            close()
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and so would their heaps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _arrow_schema(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def text_of(col: str = "text") -> "F.Column":
    return F.coalesce(F.col(col), F.lit(""))


def text_keys(col: str = "text") -> list["F.Column"]:
    """t1, t2: a 128-bit key of a text; null and the empty text have the same."""
    return [F.xxhash64(F.lit(k), text_of(col)).alias(f"t{k}") for k in (1, 2)]


def small_batches(spark: SparkSession, rows: int = SLICE) -> None:
    """Hand texts to Python workers in smaller batches than the default, which both sides hold outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))
