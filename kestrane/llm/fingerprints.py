"""Threshold-scaled sketches of documents, in DataFrame functions only.

A document's sketch keeps every hash of its five-word shingles that lies below a fixed
fraction of the hash range. Sketches of any two documents are samples by the same rule, so
the share of one's hashes that the other has estimates containment however unequal their
sizes. A document of fewer than five words has its words as its one shingle; a document none
of whose hashes lies below the threshold keeps its smallest one, so that only documents
without words have empty sketches. Such a hash shows itself by lying above the threshold, and
`united` merges sketches with that in mind: the result is the sketch of the union.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_of

WORDS = 5
FRACTION = 0.25
#: Rows of a range of doc_id that is handled apart, on average, and most ranges; their bounds are quantiles.
ROWS, RANGES = 2048, 1 << 16


def _threshold(fraction: float) -> int:
    return int(-(1 << 63) + fraction * (1 << 64))


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """df with the sketch of a text column: sorted distinct hashes, an array of longs.

    Shingles are all runs of `words` words, or all words together if there are fewer.
    Hashes are signed and even over 64 bits. Each step is a column of its own, so that it
    is worked out once.
    """
    threshold = _threshold(fraction)
    w, h, k = (f"{out}_{x}" for x in ("words", "hashes", "kept"))
    last = F.greatest(F.size(w) - (words - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(F.col(w), i, words)))
    return (
        df.withColumn(w, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
        .withColumn(h, F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<bigint>"))).drop(w)
        .withColumn(k, F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(threshold)))))
        .withColumn(out, F.when(F.size(k) > 0, F.col(k)).otherwise(F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull()))).drop(h, k)
    )


def united(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two documents' shingles, from their sketches."""
    below = F.filter(F.array_union(a, b), lambda x: x < F.lit(_threshold(fraction)))
    least = F.filter(F.array(F.least(F.array_min(a), F.array_min(b))), lambda x: x.isNotNull())
    return F.when(F.size(below) > 0, F.array_sort(below)).otherwise(least)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with near_<out>: containment of the smaller sketch in the larger, and jaccard_<out>.

    Both are 1 if both sketches are empty and 0 if one is.
    """
    both, least = f"{out}_both", F.least(F.size(a), F.size(b))
    every = (F.size(a) + F.size(b) - F.col(both)).cast("double")
    empty = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)
    return (
        df.withColumn(both, F.size(F.array_intersect(a, b)))
        .withColumn(f"near_{out}", F.when(least > 0, F.col(both) / least.cast("double")).otherwise(empty))
        .withColumn(f"jaccard_{out}", F.when(least > 0, F.col(both) / every).otherwise(empty)).drop(both)
    )


def told(s: Column) -> Column:
    """A sketch as text: its hashes in 16 hexadecimal digits each, by their order as numbers."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, carry: list[str], doc_id: str = "doc_id", enrich: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs with next_<column> for each carried column: those of the next row by descending doc_id.

    After the last comes the first; null ids come last, equal ids by a hash of the text. Rows
    are dealt by ranges of doc_id whose bounds are quantiles, as many as there are rows for; an
    id, or the absent one, that holds more than two ranges' rows has ranges of its own, by that
    hash. Each range also gets the row that follows its last one, so no task sees more than a
    range; only rows that agree in id and text cannot be parted. doc_id (long) and text must
    be columns; enrich adds others to the rows once they are dealt, which may be carried too.
    """
    spark, i = docs.sparkSession, F.col(doc_id)
    ids = docs.select(i.alias("id"))
    n = ids.count()
    ranges = min(RANGES, -(-n // ROWS))
    quantiles = ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    per = max(ROWS, -(-n // RANGES))  # rows of a range, so that nothing below has more entries than RANGES
    often = ids.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * per).collect()
    top = (1 << 63) - 1
    bounds = sorted({min(int(q), top) for q in quantiles} | {b for r in often if r.id is not None for b in (r.id, min(r.id + 1, top))})
    place = F.when(i.isNull(), F.lit(-1)).otherwise(_rank(i, bounds))
    parts = {-1 if r.id is None else bisect.bisect_right(bounds, r.id): -(-r.n // per) for r in often}
    sizes = F.split(F.lit(",".join(str(parts.get(k, 1)) for k in range(len(bounds) + 1))), ",").cast("array<int>")  # folded once into a constant
    of = F.when(F.col("range") < 0, F.lit(parts.get(-1, 1))).otherwise(F.element_at(sizes, F.col("range") + 1)) if parts else F.lit(1)
    share = F.col("hash") / float(1 << 64) + 0.5
    rows = docs.withColumn("hash", F.xxhash64("text")).withColumn("range", place).withColumn("part", F.least(F.floor(share * of), of - 1).cast("int"))
    first = F.min(F.struct(F.bitwise_not(i).alias("d"), F.col("hash").alias("h"))).alias("first")
    heads = {(r["range"], r["part"]): (r["first"].d, r["first"].h) for r in rows.groupBy("range", "part").agg(first).collect()}  # at most three times RANGES, whatever the table's size
    order = sorted(heads, key=lambda k: (k[0] < 0, -k[0], k[1]))
    # the row that follows a range's last is the first of the next range, after the last range of the first one
    follow = [(*heads[b], *a) for a, b in zip(order, order[1:] + order[:1])]
    wanted = F.broadcast(spark.createDataFrame(follow, "d long, h long, host int, host_part int"))
    guests = rows.join(wanted, F.bitwise_not(i).eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
    guests = guests.withColumn("range", F.col("host")).withColumn("part", F.col("host_part")).drop("d", "h", "host", "host_part").dropDuplicates(["range", "part"])
    every = enrich(rows.withColumn("guest", F.lit(0))).unionByName(enrich(guests.withColumn("guest", F.lit(1))))
    w = Window.partitionBy("range", "part").orderBy("guest", i.desc_nulls_last(), "hash", "text")
    out = every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.filter("guest = 0").drop("range", "part", "guest", "hash")


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by a binary search of a constant table."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded once into a constant
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    further = lambda at, step: F.when(F.coalesce(F.try_element_at(table, at + step) <= value, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), further).cast("int")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next.

    One row per row. The edited text is the text with its last floor(n/2) code points
    replaced by the first as many of the next document's. Null text counts as empty; the
    sketch of a text without words is empty. One document alone is its own next. Null and
    repeated ids and repeated rows are rows, in the order that `with_next` tells. An empty
    table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = with_next(rows, ["text", "sketch"], enrich=lambda df: with_sketch(df, "text", "sketch", fraction))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch", fraction)
    rows = with_likeness(with_likeness(rows, "sketch", "edited_sketch", "edited"), "sketch", "next_sketch", "next")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        told(F.col("sketch")).alias("fingerprint"), told(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "jaccard_edited", "jaccard_next")
