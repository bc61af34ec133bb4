"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of code points. The distinct
blocks are sorted and numbered, which gives every block an integer name; then adjacent
names are paired and the distinct pairs are sorted and numbered again, until every text
has one name. Texts are equal exactly if they have as many blocks and the same last
name: names are numbered from the blocks themselves, never from hashes. The 128-bit
keys that carry a block's name back to its text are checked to be one-to-one on the
corpus at hand, and another seed is taken if they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, materialise, text_keys, text_of

BLOCK = 4096
#: What the first block of a text carries.
ABOUT = ("doc_id", "n_chars", "text_sha256", "t1", "t2")


def _name(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of the distinct keys: partition number and place in sorted order."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(k1, k2, name) of each distinct block, and the seed of the keys."""
    for seed in range(64):
        k1, k2 = block_keys(seed)
        named = materialise(_name(blocks.select("block").distinct(), ["block"]).select(k1, k2, "name"), "block-names")
        if named.count() == named.select("k1", "k2").distinct().count():
            return named, seed
    raise RuntimeError("no seed gives one-to-one block keys")


def block_keys(seed: int):
    return (F.xxhash64(F.lit(seed), F.col("block")).alias("k1"),
            F.xxhash64(F.col("block"), F.lit(seed + 7_919)).alias("k2"))


def text_identity(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per input row: rid, doc_id, n_chars, text_sha256, t1, t2, n_blocks, name.

    t1, t2: a 128-bit key of the original text.
    Equal texts (after white space is deleted) share (n_blocks, name), others do not.
    Null text counts as empty; repeated rows and null ids are rows of their own.
    """
    norm = F.regexp_replace(text_of(text), WHITE, "")
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), norm.alias("norm"))
    parts = base.withColumn("blocks", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut))
    names, seed = _block_names(parts.select(F.explode("blocks").alias("block")))
    first = F.col("pos") == 0
    rows = (
        parts.withColumn("rid", F.monotonically_increasing_id())
        .withColumn("text_sha256", F.sha2("norm", 256)).withColumn("n_chars", F.char_length(text_of("text")).cast("long"))
        .withColumn("n_blocks", F.size("blocks"))
        .select("rid", "doc_id", "n_chars", "text_sha256", *text_keys(), "n_blocks", F.posexplode("blocks").alias("pos", "block"))
        .select("rid", "n_blocks", "pos", *block_keys(seed),
                *[F.when(first, F.col(c)).alias(c) for c in ABOUT])
    )
    occurrences = materialise(rows, "blocks")
    level = materialise(occurrences.join(names, ["k1", "k2"]).drop("k1", "k2"), "level0")
    about = level.filter(first).select("rid", *ABOUT, "n_blocks", F.when(F.col("n_blocks") == 1, F.col("name")).alias("name"))
    done = []
    level = level.filter("n_blocks > 1").select("rid", "pos", "name", F.col("n_blocks").alias("left"))
    while level.head(1):
        pairs = materialise(
            level.groupBy("rid", F.expr("pos div 2").alias("pos"), F.expr("(left + 1) div 2").alias("left")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        ab = materialise(_name(pairs.select("left", "a", "b").distinct(), ["left", "a", "b"]), "pair-names")
        level = materialise(pairs.join(ab, ["left", "a", "b"]).select("rid", "pos", "name", "left"), "level")
        done.append(level.filter("left = 1").select("rid", F.col("name").alias("last")))
        level = level.filter("left > 1")
    if not done:
        return about
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    return about.join(last, "rid", "left").withColumn("name", F.coalesce("name", "last")).drop("last")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, t1, t2: one row per input row.

    Of equal texts the row with the most code points in its original text stays, then
    the smallest doc_id, then the first of repeated rows; a null doc_id comes last. An
    empty table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    ident = materialise(text_identity(docs, text, doc_id, block), "identity")
    best = F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("d"), F.bitwise_not("rid").alias("r")))
    groups = materialise(ident.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    return ident.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.bitwise_not("best.d").alias("keep_id"), "group_size",
        (F.col("rid") == F.bitwise_not("best.r")).alias("kept"), "text_sha256", "t1", "t2")
