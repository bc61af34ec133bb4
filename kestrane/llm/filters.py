"""Pipeline stages that keep some of the rows of docs, with all their columns.

Rows are told apart by doc_id, nulls included, and a 128-bit key of the original text, so a
decision about one text never falls on another text of the same id. Rows that agree in both
are repeats: one of them stays where one is to stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, text_keys
from .exact_dedup import exact_dedup
from .similarity_join import near_classes

#: Keys up to which they are broadcast (under 64 MB); they are shuffled beyond.
BROADCAST_KEYS = 500_000


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _kept(docs: DataFrame, told: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of docs that told (doc_id, t1, t2, kept, alone) keeps.

    Of repeats one stays, the one whose columns hash lowest, unless they are `alone`.
    """
    keys = told.groupBy("doc_id", "t1", "t2").agg(F.max("kept").alias("kept"), F.max("alone").alias("alone"), F.count("*").alias("n"))
    keys = materialise(keys.filter("not kept or n > 1"), "keys").toDF("d", "k1", "k2", "kept", "alone", "n")
    same = lambda k: F.col("i").eqNullSafe(k["d"]) & (F.col("t1") == k["k1"]) & (F.col("t2") == k["k2"])
    dropped, repeats = keys.filter("not kept"), keys.filter("kept and n > 1 and not alone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("i"), *text_keys(text))
    small = _small(dropped)
    rows = rows.join(small, same(small), "left_anti")
    if repeats.head(1):
        some = _small(repeats)
        once = rows.join(some, same(some), "left_semi").groupBy("i", "t1", "t2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        rows = rows.join(some, same(some), "left_anti").select("row").unionByName(once.select("row"))
    return rows.select("row.*")


def without_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the row of each group of equal texts that `exact_dedup` keeps: the longest original, then the least doc_id.

    Null text counts as empty, so one row without characters stays. Of repeated rows one
    stays. An empty table gives no rows; all columns of docs pass, whatever their names.
    """
    told = exact_dedup(docs, text, doc_id).select("doc_id", "t1", "t2", "kept", F.lit(False).alias("alone"))
    return _kept(docs, told, text, doc_id)


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class of near duplicates: the one with the least doc_id, null last.

    A text without words, null counted as empty, is like no other and stays, repeats
    included. Of other repeated rows one stays. An empty table gives no rows; all columns of
    docs pass, whatever their names.
    """
    told = near_classes(docs, text, doc_id).select("doc_id", "t1", "t2", "kept", "alone")
    return _kept(docs, told, text, doc_id)
