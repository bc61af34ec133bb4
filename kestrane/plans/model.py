"""The domain's entities, derived from the star-schema tables, and the same in SQL.

Suppliers stand for schools, nations and regions for territories, years of shipment and line
numbers for school years and grades, line items by return flag for test scores by subject,
and line items with their orders and parts for course marks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import grade_label
from ..tables import table


@dataclass(frozen=True)
class Config:
    """Parameters of the analytics, as `config_from` reads them from key/value rows."""

    hiatus_start: int = 1997
    hiatus_end: int = 1998
    post_hiatus_start: int = 1999
    alert_threshold: float = 1.5
    min_points_trend: int = 2
    min_points_corr: int = 4
    gap_alert: float = 50.0


def config_from(rows: DataFrame, **explicit) -> Config:
    """Typed values from (key, value) text rows; unknown keys and bad values keep the default; arguments win."""
    fields = {k: type(v) for k, v in vars(Config()).items()}
    found = {}
    for r in rows.filter(F.col("key").isin(*fields)).collect():  # at most one row a field
        try:
            found[r.key] = fields[r.key](r.value)
        except (TypeError, ValueError):
            pass
    return Config(**(found | explicit))


CONFIG = Config()
SUBJECT_OF_FLAG = (("mat", "A"), ("lect", "N"), ("cie", "R"))


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rbd, nom_rbd, cod_depe, cod_com, nom_com, cod_reg, nom_reg: a dimension with its territory."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
        .select(rbd_of("s_suppkey").alias("rbd"), F.col("s_name").alias("nom_rbd"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("cod_depe"),
                F.col("s_nationkey").alias("cod_com"), F.col("n_name").alias("nom_com"), F.col("r_regionkey").alias("cod_reg"), F.col("r_name").alias("nom_reg"))
    )


def rbd_of(key: str) -> Column:
    text = F.col(key).cast("string")
    return F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)


def cents(c: Column) -> Column:
    return (c.cast("decimal(18,2)") * 100).cast("bigint")


def scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rbd, agno, cod_grado, gse, and per subject ptje (mean), n_eval and cents (sum): the score fact.

    One aggregation of the line items; gse follows from the year's rows of a school.
    """
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price = cents(F.col("l_extendedprice"))
    aggs = [F.count("*").alias("n_rows")]
    for name, flag in SUBJECT_OF_FLAG:
        hit = F.col("l_returnflag") == flag
        aggs += [F.sum(F.when(hit, price)).alias(f"cents_{name}"), F.count_if(hit).alias(f"n_eval_{name}")]
    wide = l.groupBy(rbd_of("l_suppkey").alias("rbd"), F.year("l_shipdate").alias("agno"), F.col("l_linenumber").alias("cod_grado")).agg(*aggs)
    year_rows = F.sum("n_rows").over(Window.partitionBy("rbd", "agno"))
    return wide.select(
        "rbd", "agno", "cod_grado", (year_rows % 3 + 1).cast("int").alias("gse"),
        *[(F.col(f"cents_{s}") / 100e0 / F.nullif(F.col(f"n_eval_{s}"), F.lit(0))).alias(f"ptje_{s}") for s, _ in SUBJECT_OF_FLAG],
        *[F.col(f"n_eval_{s}").alias(f"n_eval_{s}") for s, _ in SUBJECT_OF_FLAG], *[f"cents_{s}" for s, _ in SUBJECT_OF_FLAG])


def score_series(spark: SparkSession, sf_dir: str, wide: DataFrame | None = None) -> DataFrame:
    """The score fact (`wide`: as `scores_wide` gives it) in long form: rbd, agno, cod_grado, grado, gse, asignatura, puntaje, n_evaluados; no null scores."""
    parts = ", ".join(f"'{s}', ptje_{s}, n_eval_{s}" for s, _ in SUBJECT_OF_FLAG)
    wide = scores_wide(spark, sf_dir) if wide is None else wide
    long = wide.select("rbd", "agno", "cod_grado", "gse", F.expr(f"stack({len(SUBJECT_OF_FLAG)}, {parts}) as (asignatura, puntaje, n_evaluados)"))
    return long.filter("puntaje is not null").withColumn("grado", grade_label(F.col("cod_grado")))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course marks: one row per line item with its order's pupil, class letter and status and its part's subject."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.year("l_shipdate").alias("agno"), "l_discount", "l_quantity") \
        .join(o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "APR").when(F.col("o_orderstatus") == "O", "REP").when(F.col("o_orderstatus") == "P", "RET")
    return rows.select(
        rbd_of("l_suppkey").alias("rbd"), "agno", F.col("l_linenumber").alias("cod_grado"),
        F.col("o_custkey").alias("alumno_id"), F.substring("o_orderpriority", 1, 1).alias("letra"), F.col("p_type").alias("subsector"),
        (1 + 60 * F.col("l_discount")).cast("decimal(18,2)").alias("promedio"), (2 * F.col("l_quantity")).cast("decimal(18,2)").alias("asistencia_pct"), status.alias("situacion_final"))


def half_up(total: Column, n: Column, digits: int) -> Column:
    """Mean of values whose sum in hundredths is total, rounded half up in whole numbers."""
    t, scale = total.cast("bigint"), 10**digits
    whole = F.when(n > 0, F.floor((2 * t * scale + 100 * n) / (200 * F.nullif(n, F.lit(0)))))
    return whole.cast("bigint") / float(scale)


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded, with a nudge that settles ties, so that engines which sum in another order agree; never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-7, digits) + F.lit(0.0)


def hundredths(c: str) -> Column:
    return F.sum((F.col(c) * 100).cast("bigint"))


# The same in SQL: common table expressions that the queries' SQL begins with.

CTE_SCHOOLS = """schools AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(8, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS rbd, s_name AS nom_rbd,
         CAST(s_suppkey % 5 + 1 AS INTEGER) AS cod_depe, s_nationkey AS cod_com, n_name AS nom_com, r_regionkey AS cod_reg, r_name AS nom_reg
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
CTE_SCORES = """facts AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(8, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS rbd,
         CAST(year(l_shipdate) AS INTEGER) AS agno, l_linenumber AS cod_grado, count(*) AS n_rows,
         CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS cents_mat,
         CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS cents_lect,
         CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS cents_cie,
         count(*) FILTER (WHERE l_returnflag = 'A') AS n_eval_mat, count(*) FILTER (WHERE l_returnflag = 'N') AS n_eval_lect,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_eval_cie
  FROM lineitem GROUP BY 1, 2, 3),
scores AS (
  SELECT *, CAST(sum(n_rows) OVER (PARTITION BY rbd, agno) % 3 + 1 AS INTEGER) AS gse,
         CAST(cents_mat AS DOUBLE) / 100e0 / nullif(n_eval_mat, 0) AS ptje_mat,
         CAST(cents_lect AS DOUBLE) / 100e0 / nullif(n_eval_lect, 0) AS ptje_lect,
         CAST(cents_cie AS DOUBLE) / 100e0 / nullif(n_eval_cie, 0) AS ptje_cie
  FROM facts)"""
CTE_SERIES = CTE_SCORES + """,
series AS (
  SELECT rbd, agno, cod_grado, gse, CASE cod_grado WHEN 2 THEN '2b' WHEN 4 THEN '4b' WHEN 6 THEN '6b' WHEN 8 THEN '8b' WHEN 10 THEN '2m'
         ELSE CAST(cod_grado AS VARCHAR) END AS grado, asignatura, puntaje, n_evaluados
  FROM (SELECT rbd, agno, cod_grado, gse, 'mat' AS asignatura, ptje_mat AS puntaje, n_eval_mat AS n_evaluados FROM scores
        UNION ALL SELECT rbd, agno, cod_grado, gse, 'lect', ptje_lect, n_eval_lect FROM scores
        UNION ALL SELECT rbd, agno, cod_grado, gse, 'cie', ptje_cie, n_eval_cie FROM scores)
  WHERE puntaje IS NOT NULL)"""
CTE_MARKS = """marks AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(8, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS rbd,
         CAST(year(l_shipdate) AS INTEGER) AS agno, l_linenumber AS cod_grado, o_custkey AS alumno_id,
         substr(o_orderpriority, 1, 1) AS letra, p_type AS subsector,
         CAST(1 + 60 * l_discount AS DECIMAL(18,2)) AS promedio, CAST(2 * l_quantity AS DECIMAL(18,2)) AS asistencia_pct,
         CASE o_orderstatus WHEN 'F' THEN 'APR' WHEN 'O' THEN 'REP' WHEN 'P' THEN 'RET' END AS situacion_final
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""


def sql_half_up(total: str, n: str, digits: int) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST((2 * CAST({total} AS BIGINT) * {10**digits} + 100 * {n}) // (200 * {n}) AS DOUBLE) / {10**digits} END"


def sql_confidence(n: str) -> str:
    return f"CASE WHEN {n} >= 6 THEN 'alta' WHEN {n} >= 4 THEN 'media' WHEN {n} >= 3 THEN 'baja' ELSE 'insuficiente' END"
