"""Upserts of a new batch into an old table under explicit rules; keys may be null.

A batch may hold a key more than once, as files that are read one after another do: its rows
follow each other in the order of `sequence` (names or columns; rows that tie there are told
apart by a hash of their values, so that reruns agree), and the result is as if they came one
by one. Each side is shuffled once on the key, and a batch is combined before that shuffle, so
a key with many rows costs no more than others. Old tables hold a key once. Columns of both
sides must be the same, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sequenced = Sequence[str | Column]


def _place(df: DataFrame, sequence: Sequenced) -> Column:
    """What the rows of a key are ordered by: nulls first, then as the sequence says."""
    return F.struct(*[(F.col(s) if isinstance(s, str) else s).alias(f"s{i}") for i, s in enumerate(sequence)], F.xxhash64(*df.columns).alias("s"))


def _per_key(df: DataFrame, keys: Sequence[str], rest: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*rest).select(*df.columns) if rest else df.select(*keys).distinct()


def _picked(df: DataFrame, keys: Sequence[str], pick) -> list[Column]:
    """Each column that is no key, from the row that pick(values) chooses; nulls in it count."""
    return [pick(F.struct(F.col(c))).getField(c).alias(c) for c in df.columns if c not in keys]


def keep_last(df: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """One row per key: the last by the sequence."""
    place = _place(df, sequence)
    return _per_key(df, keys, _picked(df, keys, lambda v: F.max_by(v, place)))


def keep_first(df: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """One row per key: the first by the sequence."""
    place = _place(df, sequence)
    return _per_key(df, keys, _picked(df, keys, lambda v: F.min_by(v, place)))


def fold_not_null(df: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """One row per key: column by column the last value by the sequence that is not null."""
    place = _place(df, sequence)
    return _per_key(df, keys, [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in df.columns if c not in keys])


def _same(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [old[k].eqNullSafe(new[k]) for k in keys])


def merge_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """The new row wins whole, the last one of its key."""
    new = keep_last(new, keys, sequence)
    return old.join(new, _same(old, new, keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """The old row stays; new keys are added, by the first row of each."""
    new = keep_first(new, keys, sequence)
    return old.unionByName(new.join(old, _same(old, new, keys), "left_anti"))


def _full(old: DataFrame, new: DataFrame, keys: Sequence[str], choose) -> DataFrame:
    """Both sides joined on the keys, each row packed whole; choose(name, old value, new value) for the other columns."""
    o, n = old.select(F.struct(*old.columns).alias("o")), new.select(F.struct(*old.columns).alias("n"))
    of = lambda side, c: F.col(side).getField(c)
    both = o.join(n, reduce(Column.__and__, [of("o", k).eqNullSafe(of("n", k)) for k in keys]), "full_outer")
    key = {k: F.when(F.col("n").isNotNull(), of("n", k)).otherwise(of("o", k)) for k in keys}
    return both.select(*[(key[c] if c in keys else choose(c, of("o", c), of("n", c))).alias(c) for c in old.columns])


def merge_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """Column by column, a new value that is not null wins, the last one of its key."""
    return _full(old, fold_not_null(new, keys, sequence), keys, lambda c, o, n: F.coalesce(n, o))


def merge_partial(old: DataFrame, new: DataFrame, keys: Sequence[str], updated: Sequence[str], sequence: Sequenced = ()) -> DataFrame:
    """Where a key is in both, only the listed columns are replaced, by the last row; new keys are added by their first row, then updated."""
    place = _place(new, sequence)
    late, early = (_picked(new, keys, lambda v, f=f: f(v, place)) for f in (F.max_by, F.min_by))
    names = [c for c in new.columns if c not in keys]
    new = _per_key(new, keys, [x if c in updated else y for c, x, y in zip(names, late, early)])

    def choose(c: str, o: Column, n: Column) -> Column:
        take = F.col("n").isNotNull() if c in updated else F.col("o").isNull()
        return F.when(take, n).otherwise(o)

    return _full(old, new, keys, choose)


def lookup_or_create(dim: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """dim with a row, null beyond its keys, for every wanted key that it lacks."""
    new = wanted.select(*keys).distinct()
    return dim.unionByName(new.join(dim, _same(dim, new, keys), "left_anti"), allowMissingColumns=True)
