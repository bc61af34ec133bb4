"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a target of words. Complete epochs of a source come first; the rest of
its target is drawn from its documents in the order of the keys -ln(u) / w, with u a
uniform number hashed from the document and w its quality: the smallest keys are a weighted
sample without replacement. The running sum of sizes along that order is cut at the
budget. It is taken in two steps, so that no task sees a whole source: over slices of the
key range first, then over the keys inside the one slice in which a source's budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WHITE, materialise, text_of

#: Fixed values of the mix: weights by source in turn, share of all words, most epochs.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Slices of the key range for each doubling of the key: one holds under 0.1% of a source.
SLICES = 1024
#: Sources up to which the table of sources is broadcast; it is shuffled beyond.
BROADCAST_SOURCES = 10_000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text: str = "text") -> Column:
    """Share of letters among the characters that are not white space, from 0.05 to 1."""
    solid = F.char_length(F.regexp_replace(text_of(text), WHITE, ""))
    letters = F.char_length(F.regexp_replace(text_of(text), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(solid, F.lit(0)), F.lit(0.05)))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """source, source_size, target: one row per source.

    Sources in code-point order, null last, have the weights in turn and share SHARE times
    all words; a target stops at MOST times its source's size and the excess is shared again
    by weight. That ends where every target is the lesser of its cap and a common level
    times its weight: with sources by cap per weight, the first k are capped and the level
    is what they leave, over the weights of the others. One row per source goes through the
    windows, as many as there are sources.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.encode("source", "utf-8").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((turn - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * float(MOST)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    levels = (
        per.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("total", SHARE * F.sum("source_size").over(everywhere)).withColumn("weights", F.sum("weight").over(everywhere))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")  # this source and those after it are under their caps
    return (
        levels.withColumn("level", F.min_by("level", F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("turn")))).over(everywhere))
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def with_draw(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 17, weight: Column | None = None) -> DataFrame:
    """docs with mix_size (words) and mix_key (smallest first); the same doc_id and text have the same key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 12).cast("double") + 0.5) / float(1 << 52)
    return docs.withColumn("mix_size", n_words(text)).withColumn("mix_key", -F.log(u) / (weight if weight is not None else quality(text)))


def mix_plan(drawn: DataFrame, split_last: bool = True) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut_key, cut_each.

    drawn: source, size, key. Rows with a key below cut_key are taken once more than the
    epochs; a row at cut_key has cut_each of its words taken more: what is left of the budget
    (split_last; shared if repeated rows tie there), or all of them if at least half fit.
    """
    targets = materialise(source_targets(drawn), "targets")
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = targets.withColumn("epochs", F.coalesce(F.floor(ratio), F.lit(0)).cast("int")).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    same = F.col("source").eqNullSafe(F.col("s"))
    drawn = drawn.withColumn("slice", F.floor(F.log2("key") * SLICES).cast("int"))
    running = lambda by, *order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget"))
    slices = drawn.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("before", running(["source"], "slice"))
    last = materialise(slices.join(small(plan.select(F.col("source").alias("s"), "budget"), targets), same).filter(ends).select("s", F.col("slice").alias("last"), F.col("before").alias("base"), "budget"), "last-slices")
    edge = drawn.join(small(last, targets), same & (F.col("slice") == F.col("last"))).groupBy("source", "base", "budget", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    left = F.col("budget") - F.col("before")
    each = F.floor(left / F.col("rows")) if split_last else F.when(2 * left >= F.col("words"), F.floor(F.col("words") / F.col("rows"))).otherwise(0)
    cuts = edge.withColumn("before", F.col("base") + running(["source"], "key")).filter(ends).select(F.col("source").alias("s"), F.col("key").alias("cut_key"), each.cast("long").alias("cut_each"))
    return materialise(plan.join(cuts, same, "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_each"), "plan")


def small(table: DataFrame, sources: DataFrame) -> DataFrame:
    """A table of one row per source: broadcast behind a check of its size."""
    return F.broadcast(table) if sources.count() <= BROADCAST_SOURCES else table


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, split_last: bool = True, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of docs.

    taken: words that the mix takes of the row, epochs counted. Null text has no words; a null
    source is a source; a null or repeated doc_id is drawn by its text as well. An empty table
    gives no rows. The draw depends on seed, doc_id and text only, so reruns agree; repeated rows
    have the same key and share what is left at the cut. `weight` replaces `quality`, the default
    weight of a document. Other columns of docs, whatever their names, play no part.
    """
    drawn = with_draw(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), seed=seed, weight=weight)
    drawn = materialise(drawn.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key")), "drawn")
    plan = mix_plan(drawn, split_last)
    rows = drawn.join(small(plan.withColumnRenamed("source", "s"), plan), F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken("size", "key").alias("taken"))


def taken(size: str, key: str) -> Column:
    more = F.when(F.col(key) < F.col("cut_key"), F.col(size)).when(F.col(key) == F.col("cut_key"), F.col("cut_each")).otherwise(F.lit(0))
    return (F.col("epochs") * F.col(size) + more).cast("long")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as the mix takes it, whole.

    Null text has no words and is taken by epochs alone; a null source is a source; repeated
    rows share a key and are taken alike. An empty table gives no rows. All columns pass, whatever
    their names. The document in which a source's budget ends is taken if half of it or more fits.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    drawn = with_draw(row, seed=seed)
    columns = drawn.select("source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key"))
    plan = mix_plan(materialise(columns, "drawn"), split_last=False)
    plan = plan.select(F.col("source").alias("mix_source"), "epochs", "cut_key", "cut_each")
    more = F.when((F.col("mix_key") < F.col("cut_key")) | ((F.col("mix_key") == F.col("cut_key")) & (F.col("cut_each") > 0)), 1).otherwise(0)
    rows = drawn.join(small(plan, plan), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("copies", F.col("epochs") + more)
    return rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
