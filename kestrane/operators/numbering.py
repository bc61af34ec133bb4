"""Dense surrogate numbers for the keys of a dimension, which stay as batches are added.

New keys are dealt out by ranges and sorted in each; a key's number is the greatest old one,
plus the keys of all ranges before its own, plus its place in its range. So no task sees all keys,
and numbers follow the order of the keys whatever the ranges are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .merge import _same


def numbered(wanted: DataFrame, keys: Sequence[str], number: str = "id", start: int = 0) -> DataFrame:
    """The distinct keys with numbers from start + 1 on, without gaps, in the order of the keys (nulls first)."""
    dealt = wanted.select(*keys).distinct().repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("__range").count().collect())  # a row for each range
    before = [(r, start + total - n) for (r, n), total in zip(sizes, accumulate(n for _, n in sizes))]
    offsets = dealt.sparkSession.createDataFrame(before, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "__range").select(*keys, (F.col("__before") + place).alias(number))


def number_new(dim: DataFrame, wanted: DataFrame, keys: Sequence[str], number: str = "id") -> DataFrame:
    """dim and, for the wanted keys that it lacks, rows with the next numbers; other columns of dim are null there."""
    new = wanted.select(*keys).distinct()
    new = new.join(dim, _same(dim, new, keys), "left_anti")
    start = dim.agg(F.max(number)).first()[0] or 0
    return dim.unionByName(numbered(new, keys, number, start), allowMissingColumns=True)
