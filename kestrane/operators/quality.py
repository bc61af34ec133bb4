"""Data-quality reports over all-text tables, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausible years; shares of bad values above which a finding is critical.
YEARS = (1990, 2030)
CRITICAL_NUMERIC, CRITICAL_NULL = 0.05, 0.10
DATE_PATTERN = r"^\d{4}-\d{2}(-\d{2})?$"
FEW_ROWS = 1000
#: Rows that a sampled report looks at.
SAMPLE_ROWS = 200_000
#: Values shown of a column; parts in which they are looked for.
SAMPLES, PARTS = 3, 64


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _number(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def value_counters(df: DataFrame, numeric: Sequence[str] = (), dates: Sequence[str] = (), mandatory: Sequence[str] = (), year: str = "agno") -> DataFrame:
    """(level, code, n, pct) of every rule that some row breaks."""
    rules = {}
    if year in df.columns:
        rules["AGNO_OUT_OF_RANGE"] = (~F.coalesce(_number(year).between(*YEARS), F.lit(False)), 0.0)
    rules |= {f"NUMERIC_BAD_{c.upper()}": (_filled(c) & _number(c).isNull(), CRITICAL_NUMERIC) for c in numeric}
    rules |= {f"DATE_BAD_{c.upper()}": (_filled(c) & ~F.col(c).rlike(DATE_PATTERN), None) for c in dates}
    rules |= {f"NULL_MANDATORY_{c.upper()}": (~_filled(c), CRITICAL_NULL) for c in mandatory}
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(rule).alias(code) for code, (rule, _) in rules.items()])
    long = counts.unpivot(["total"], list(rules), "code", "n").filter("n > 0")
    share, level = F.col("n") / F.col("total"), F.lit("WARNING")
    for code, (_, critical) in rules.items():
        if critical is not None:
            level = F.when((F.col("code") == code) & (share > critical), "CRITICAL").otherwise(level)
    return long.select(level.alias("level"), "code", "n", F.round(100 * share, 4).alias("pct"))


def row_count_level(df: DataFrame) -> DataFrame:
    """(level, code, n): no rows is critical, few are a warning."""
    n = F.col("n")
    return df.agg(F.count("*").alias("n")).select(F.when(n == 0, "CRITICAL").when(n < FEW_ROWS, "WARNING").otherwise("INFO").alias("level"), F.lit("ROW_COUNT").alias("code"), "n")


def column_profile(df: DataFrame) -> DataFrame:
    """(col, type, nulls, null_pct, cardinality, least, greatest, samples) of all-text columns.

    Rows are first counted by (column, value), combined before the shuffle, so a column's
    distinct values are exact and need no task that sees them all. Samples are its SAMPLES
    least values, from the least of each of many parts of the values.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.nullif(F.col(c), F.lit("")).alias("v")) for c in df.columns])
    values = df.select(F.inline(pairs)).groupBy("col", "v").agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    stats = values.groupBy("col").agg(
        F.sum("n").alias("rows"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulls"), F.count("v").alias("cardinality"), F.count(v.try_cast("double")).alias("numbers"),
        F.count_if(v.rlike(DATE_PATTERN)).alias("dates"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    kind = F.when(F.col("cardinality") == 0, "empty").when(F.col("numbers") == F.col("cardinality"), "numeric").when(F.col("dates") == F.col("cardinality"), "date").otherwise("string")
    few = values.filter(v.isNotNull()).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    for by in (["col", "part"], ["col"]):
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("v"))).filter(F.col("place") <= SAMPLES)
    samples = few.groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("samples"))
    return stats.join(samples, "col", "left").select("col", kind.alias("type"), "nulls", F.round(100e0 * F.col("nulls") / F.col("rows"), 1).alias("null_pct"), "cardinality", "least", "greatest", "samples")


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values; nulls and empty texts are alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))


def bottom_rows(df: DataFrame, n: int, total: int | None = None) -> DataFrame:
    """The n rows with the least hashes, the same ones at every run; all rows if there are no more.

    Only rows below a bound on the hash, under which about n rows are expected, come to the sort;
    the bound is widened while it holds fewer. `total`: the rows of df, if known.
    """
    total = df.count() if total is None else total
    rows, share = df.withColumn("__hash", row_hash(df)), (n + 10 * n**0.5 + 10) / max(1, total)
    while share < 1:
        below = rows.filter(F.col("__hash") < f"{int(share * 16**8):08x}")
        if below.count() >= n:
            rows = below
            break
        share *= 2
    return rows.orderBy("__hash").limit(n).drop("__hash")


def sampled_counters(df: DataFrame, rows: int = SAMPLE_ROWS, **rules) -> DataFrame:
    """`value_counters` of a sample of rows, with a row that tells the sample: how many rows, and their share of all in percent."""
    total = df.count()
    found = value_counters(bottom_rows(df, rows, total), **rules)
    size = min(rows, total)
    told = df.sparkSession.createDataFrame([("INFO", "SAMPLE", size, round(100 * size / max(1, total), 4))], "level string, code string, n long, pct double")
    return told.unionByName(found)
