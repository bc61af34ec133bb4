"""Series, trends, peer percentiles and cross-source gaps, for all schools in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import confidence, grade_label, in_range
from ..operators.stats import correlation, outside_share, peer_share, trend
from ..scratch import materialise
from .model import (
    CONFIG, CTE_MARKS, CTE_SCHOOLS, CTE_SCORES, CTE_SERIES, SUBJECT_OF_FLAG, half_up, hundredths, marks, rnd, schools, score_series, scores_wide, sql_confidence, sql_half_up)
from .registry import query

KEYS = ["rbd", "grado", "asignatura"]


def _r4(*names: str) -> list:
    return [rnd(n, 4).alias(n) for n in names]


class Facts:
    """What several families of metrics start from: the score fact, the means of the marks, and the schools.

    `stored`: both facts are worked out and written to the shared folder now, each once, and read
    back by whatever is built on them; otherwise they are plans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        kept = materialise if stored else lambda df, name: df
        self.spark, self.sf_dir = spark, sf_dir
        self.scores = kept(scores_wide(spark, sf_dir).select("rbd", "agno", "cod_grado", "gse", *[f"{c}_{s}" for s, _ in SUBJECT_OF_FLAG for c in ("ptje", "n_eval")]), "scores")
        self.grades = kept(grade_rows(spark, sf_dir).select("rbd", "agno", "grado", "asignatura", "prom_notas"), "grades")
        self.schools = schools(spark, sf_dir)

    @property
    def series(self) -> DataFrame:
        return score_series(self.spark, self.sf_dir, self.scores)


# Series -------------------------------------------------------------------------------------

@query(f"""WITH {CTE_SERIES}
SELECT rbd, agno, grado, asignatura, (round(puntaje + 1e-7, 4) + 0e0) AS puntaje, n_evaluados, agno BETWEEN 1997 AND 1998 AS en_hiatus FROM series""")
def score_series_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every school's score series, with the years that trends leave out marked."""
    s = score_series(spark, sf_dir)
    return s.select("rbd", "agno", "grado", "asignatura", *_r4("puntaje"), "n_evaluados", in_range(F.col("agno"), CONFIG.hiatus_start, CONFIG.hiatus_end).alias("en_hiatus"))


_MELT_SQL = f"""WITH {CTE_SERIES}, bench AS (SELECT agno, cod_grado, asignatura, avg(puntaje) AS prom_nacional FROM series GROUP BY ALL)
SELECT rbd, agno, grado, asignatura, (round(puntaje + 1e-7, 3) + 0e0) AS puntaje, n_evaluados, (round(prom_nacional + 1e-7, 3) + 0e0) AS prom_nacional,
       (round(puntaje - prom_nacional + 1e-7, 3) + 0e0) AS dif_nacional
FROM series JOIN bench USING (agno, cod_grado, asignatura)"""


@query(f"{_MELT_SQL} WHERE rbd = '00000001'")
def score_series_melt(spark: SparkSession, sf_dir: str, rbd: str | None = "00000001") -> DataFrame:
    """One school's series, or with None every school's, against the mean of all schools in the same year, grade and subject."""
    s = score_series(spark, sf_dir)
    mine = s if rbd is None else s.filter(F.col("rbd") == rbd)
    return _with_benchmark(mine, s).select("rbd", "agno", "grado", "asignatura", rnd("puntaje", 3).alias("puntaje"), "n_evaluados",
                                           rnd("prom_nacional", 3).alias("prom_nacional"), rnd(F.col("puntaje") - F.col("prom_nacional"), 3).alias("dif_nacional"))


@query(_MELT_SQL)
def score_series_melt_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_series_melt(spark, sf_dir, None)


def _with_benchmark(rows: DataFrame, series: DataFrame) -> DataFrame:
    bench = series.groupBy("agno", "cod_grado", "asignatura").agg(F.avg("puntaje").alias("prom_nacional"))
    return rows.join(bench, ["agno", "cod_grado", "asignatura"])


@query(f"""WITH {CTE_SERIES}
SELECT agno, cod_grado, asignatura, (round(avg(puntaje) + 1e-7, 3) + 0e0) AS prom_nacional, count(*) AS n_establecimientos FROM series GROUP BY ALL""")
def benchmark_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_series(spark, sf_dir).groupBy("agno", "cod_grado", "asignatura").agg(rnd(F.avg("puntaje"), 3).alias("prom_nacional"), F.count("*").alias("n_establecimientos"))


# Trends -------------------------------------------------------------------------------------

def _segments(series: DataFrame) -> DataFrame:
    """Each row once for every segment it belongs to: a narrow expansion, so one aggregation serves both."""
    free = ~in_range(F.col("agno"), CONFIG.hiatus_start, CONFIG.hiatus_end)
    names = F.array_compact(F.array(F.when(free, F.lit("full_excl_hiatus")), F.when(F.col("agno") >= CONFIG.post_hiatus_start, F.lit("post_hiatus"))))
    return series.withColumn("segmento", F.explode(names))


def _together(rows: DataFrame, value: str) -> DataFrame:
    """The years of a school, grade and subject in one place: a key has few rows, of which each is much smaller than the sums of a fit."""
    return rows.select(*KEYS, "agno", value).repartition(*KEYS)


def _trends(series: DataFrame) -> DataFrame:
    return trend(_segments(_together(series, "puntaje")), [*KEYS, "segmento"], threshold=CONFIG.alert_threshold)


def _sql_trend(source: str, value: str = "puntaje", keys: str = "rbd, grado, asignatura, segmento") -> str:
    return f"""fits AS (
  SELECT {keys}, regr_slope({value}, agno - 1995) AS slope, regr_intercept({value}, agno - 1995) AS intercept,
         regr_r2({value}, agno - 1995) AS r2,
         sqrt(greatest((regr_syy({value}, agno - 1995) - regr_slope({value}, agno - 1995) * regr_sxy({value}, agno - 1995)) / count(*), 0)) AS rmse,
         count(*) AS n_puntos, max(agno) AS ultimo_agno, max_by({value}, agno) AS ultimo_valor
  FROM {source} GROUP BY {keys} HAVING count(*) >= 2),
trends AS (
  SELECT *, intercept + slope * (ultimo_agno + 1 - 1995) AS proyectado,
         n_puntos >= 3 AND rmse > 1e-9 AND abs(ultimo_valor - (intercept + slope * (ultimo_agno - 1995))) > 1.5 * rmse AS alerta
  FROM fits)"""


_SEGMENTS = """segs AS (
  SELECT *, 'full_excl_hiatus' AS segmento FROM series WHERE agno NOT BETWEEN 1997 AND 1998
  UNION ALL SELECT *, 'post_hiatus' FROM series WHERE agno >= 1999)"""
_TREND_SQL = f"WITH {CTE_SERIES}, {_SEGMENTS}, {_sql_trend('segs')}\n"
_TREND_COLUMNS = f"""SELECT rbd, grado, asignatura, segmento, ultimo_agno AS agno, (round(ultimo_valor + 1e-7, 3) + 0e0) AS valor_real, (round(proyectado + 1e-7, 3) + 0e0) AS valor_proyectado,
       (round(slope + 1e-7, 3) + 0e0) AS tendencia_slope, (round(r2 + 1e-7, 4) + 0e0) AS tendencia_r2, (round(rmse + 1e-7, 3) + 0e0) AS rmse, alerta, n_puntos, {sql_confidence('n_puntos')} AS confianza
FROM trends"""


def _told_trend(t: DataFrame, *keys: str) -> DataFrame:
    return t.select(*keys, F.col("ultimo_agno").alias("agno"), rnd("ultimo_valor", 3).alias("valor_real"), rnd("proyectado", 3).alias("valor_proyectado"),
                    rnd("slope", 3).alias("tendencia_slope"), rnd("r2", 4).alias("tendencia_r2"), rnd("rmse", 3).alias("rmse"), "alerta",
                    F.col("n_puntos").cast("bigint").alias("n_puntos"), confidence(F.col("n_puntos")).alias("confianza"))


@query(_TREND_SQL + _TREND_COLUMNS + " WHERE segmento = 'full_excl_hiatus'")
def trend_full_excl_hiatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of every school, grade and subject over all years outside the hiatus."""
    s = score_series(spark, sf_dir).filter(~in_range(F.col("agno"), CONFIG.hiatus_start, CONFIG.hiatus_end))
    return _told_trend(trend(s.withColumn("segmento", F.lit("full_excl_hiatus")), [*KEYS, "segmento"], threshold=CONFIG.alert_threshold), *KEYS, "segmento")


@query(_TREND_SQL + _TREND_COLUMNS + " WHERE segmento = 'post_hiatus'")
def trend_post_hiatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_series(spark, sf_dir).filter(F.col("agno") >= CONFIG.post_hiatus_start).withColumn("segmento", F.lit("post_hiatus"))
    return _told_trend(trend(s, [*KEYS, "segmento"], threshold=CONFIG.alert_threshold), *KEYS, "segmento")


@query(_TREND_SQL + _TREND_COLUMNS + " WHERE alerta")
def trend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_trend(_trends(score_series(spark, sf_dir)), *KEYS, "segmento").filter("alerta")


@query(f"""WITH {CTE_SERIES}
SELECT grado, asignatura, count(*) AS n, (round(regr_slope(puntaje, agno - 1995) + 1e-7, 3) + 0e0) AS slope, (round(regr_intercept(puntaje, agno - 1995) + 1e-7, 3) + 0e0) AS intercept,
       (round(regr_r2(puntaje, agno - 1995) + 1e-7, 6) + 0e0) AS r2,
       round(sqrt(greatest((regr_syy(puntaje, agno - 1995) - regr_slope(puntaje, agno - 1995) * regr_sxy(puntaje, agno - 1995)) / count(*), 0)), 3) AS rmse
FROM series GROUP BY ALL HAVING count(*) >= 2""")
def regression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trend(score_series(spark, sf_dir), ["grado", "asignatura"])
    return t.select("grado", "asignatura", F.col("n_puntos").cast("bigint").alias("n"), rnd("slope", 3).alias("slope"), rnd("intercept", 3).alias("intercept"), rnd("r2", 6).alias("r2"), rnd("rmse", 3).alias("rmse"))


# Marks --------------------------------------------------------------------------------------

def grade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rbd, agno, cod_grado, grado, asignatura, prom_notas, tasa_aprobacion, tasa_asistencia, n_alumnos."""
    m = marks(spark, sf_dir).groupBy("rbd", "agno", "cod_grado", "subsector").agg(
        hundredths("promedio").alias("p"), F.count("promedio").alias("np"), hundredths("asistencia_pct").alias("a"), F.count("asistencia_pct").alias("na"),
        F.count_if(F.col("situacion_final") == "APR").alias("apr"), F.count("situacion_final").alias("ns"), F.countDistinct("alumno_id").alias("n_alumnos"))
    return m.select(
        "rbd", "agno", "cod_grado", grade_label(F.col("cod_grado")).alias("grado"), F.substring(F.coalesce("subsector", F.lit("Sin asignatura")), 1, 80).alias("asignatura"),
        half_up(F.col("p"), F.col("np"), 2).alias("prom_notas"), half_up(F.col("apr") * 10_000, F.col("ns"), 2).alias("tasa_aprobacion"),
        half_up(F.col("a"), F.col("na"), 2).alias("tasa_asistencia"), "n_alumnos")


CTE_GRADES = CTE_MARKS + f""",
grade_groups AS (
  SELECT rbd, agno, cod_grado, subsector, sum(CAST(promedio * 100 AS BIGINT)) AS p, count(promedio) AS np, sum(CAST(asistencia_pct * 100 AS BIGINT)) AS a,
         count(asistencia_pct) AS na, count(*) FILTER (WHERE situacion_final = 'APR') AS apr, count(situacion_final) AS ns, count(DISTINCT alumno_id) AS n_alumnos
  FROM marks GROUP BY ALL),
grade_rows AS (
  SELECT rbd, agno, cod_grado, CASE cod_grado WHEN 2 THEN '2b' WHEN 4 THEN '4b' WHEN 6 THEN '6b' WHEN 8 THEN '8b' WHEN 10 THEN '2m'
         ELSE CAST(cod_grado AS VARCHAR) END AS grado, substr(coalesce(subsector, 'Sin asignatura'), 1, 80) AS asignatura,
         {sql_half_up('p', 'np', 2)} AS prom_notas, {sql_half_up('apr * 10000', 'ns', 2)} AS tasa_aprobacion,
         {sql_half_up('a', 'na', 2)} AS tasa_asistencia, n_alumnos
  FROM grade_groups)"""


@query(f"WITH {CTE_GRADES} SELECT rbd, agno, grado, asignatura, prom_notas, tasa_aprobacion, tasa_asistencia, n_alumnos FROM grade_rows")
def grade_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_rows(spark, sf_dir).drop("cod_grado")


def grade_averages(spark: SparkSession, sf_dir: str, grades: DataFrame | None = None) -> DataFrame:
    """rbd, agno, grado, prom_global: mean of the subjects' means, unweighted, to two decimals."""
    grades = grade_rows(spark, sf_dir) if grades is None else grades
    g = grades.groupBy("rbd", "agno", "grado").agg(F.sum(F.round(F.col("prom_notas") * 100).cast("bigint")).alias("p"), F.count("prom_notas").alias("n"))
    return g.select("rbd", "agno", "grado", half_up(F.col("p"), F.col("n"), 2).alias("prom_global"))


CTE_AVERAGES = CTE_GRADES + f""",
averages AS (
  SELECT rbd, agno, grado, {sql_half_up('p', 'n', 2)} AS prom_global
  FROM (SELECT rbd, agno, grado, sum(CAST(round(prom_notas * 100) AS BIGINT)) AS p, count(prom_notas) AS n FROM grade_rows GROUP BY ALL))"""


@query(f"WITH {CTE_AVERAGES} SELECT * FROM averages")
def grade_global_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_averages(spark, sf_dir)


def _grade_trends(grades: DataFrame) -> DataFrame:
    rows = grades.withColumn("asignatura", F.substring("asignatura", 1, 40)).filter("prom_notas is not null")
    return trend(_together(rows, "prom_notas"), KEYS, value="prom_notas", threshold=CONFIG.alert_threshold, digits=2).withColumn("segmento", F.lit("full"))


_GRADE_TREND_CTE = CTE_GRADES + ", short AS (SELECT * REPLACE (substr(asignatura, 1, 40) AS asignatura) FROM grade_rows WHERE prom_notas IS NOT NULL), " + _sql_trend("short", "prom_notas", "rbd, grado, asignatura")


@query(f"WITH {_GRADE_TREND_CTE}\n" + _TREND_COLUMNS.replace("asignatura, segmento", "asignatura, 'full' AS segmento"))
def trend_grades(spark: SparkSession, sf_dir: str, grades: DataFrame | None = None) -> DataFrame:
    return _told_trend(_grade_trends(grade_rows(spark, sf_dir) if grades is None else grades), *KEYS, "segmento")


# Percentiles --------------------------------------------------------------------------------

def _latest(facts: Facts) -> DataFrame:
    """rbd, cod_depe, gse of the latest period of each school."""
    return facts.scores.groupBy("rbd").agg(F.max_by("gse", F.struct("agno", "cod_grado")).alias("gse")).join(facts.schools.select("rbd", "cod_depe"), "rbd")


def percentiles(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    """Each score's share of peers at or below it: of the same municipality, and of the school's latest peer group."""
    facts = facts or Facts(spark, sf_dir)
    s = facts.series.join(facts.schools.select("rbd", "cod_com", "cod_depe"), "rbd")
    period = ["agno", "cod_grado", "asignatura"]
    both = peer_share(s, [*period, "cod_com"], "puntaje", "percentil_comuna")
    pilots = both.drop("gse", "cod_depe").join(_latest(facts), "rbd")
    return outside_share(pilots, s, [*period, "cod_depe", "gse"], "puntaje", "percentil_gse")


_LATEST_CTE = "latest AS (SELECT rbd, max_by(gse, (agno, cod_grado)) AS gse FROM scores GROUP BY rbd)"
_PEERS_CTE = """s AS (SELECT series.*, cod_com, cod_depe FROM series JOIN schools USING (rbd)),
com AS (SELECT a.rbd, a.agno, a.cod_grado, a.asignatura, 100e0 * count(*) FILTER (WHERE b.puntaje <= a.puntaje) / count(*) AS percentil_comuna, count(*) AS n_com
  FROM s a JOIN s b ON a.agno = b.agno AND a.cod_grado = b.cod_grado AND a.asignatura = b.asignatura AND a.cod_com = b.cod_com GROUP BY ALL),
gse AS (SELECT a.rbd, a.agno, a.cod_grado, a.asignatura, 100e0 * count(*) FILTER (WHERE b.puntaje <= a.puntaje) / count(*) AS percentil_gse, count(*) AS n_gse
  FROM s a JOIN latest l ON a.rbd = l.rbd JOIN s b ON a.agno = b.agno AND a.cod_grado = b.cod_grado AND a.asignatura = b.asignatura
       AND a.cod_depe = b.cod_depe AND b.gse = l.gse GROUP BY ALL)"""
_PERCENTILE_CTE = f"{CTE_SCHOOLS}, {CTE_SERIES}, {_LATEST_CTE}, {_PEERS_CTE}"


@query(f"""WITH {_PERCENTILE_CTE}
SELECT s.rbd, s.agno, s.grado, s.asignatura, (round(puntaje + 1e-7, 3) + 0e0) AS puntaje, (round(percentil_comuna + 1e-7, 4) + 0e0) AS percentil_comuna, n_com AS n_pares
FROM s JOIN com USING (rbd, agno, cod_grado, asignatura)""")
def peer_percentile_comuna(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_series(spark, sf_dir).join(schools(spark, sf_dir).select("rbd", "cod_com"), "rbd")
    out = peer_share(s, ["agno", "cod_grado", "asignatura", "cod_com"], "puntaje", "percentil_comuna")
    return out.select("rbd", "agno", "grado", "asignatura", rnd("puntaje", 3).alias("puntaje"), *_r4("percentil_comuna"), F.col("percentil_comuna_n").alias("n_pares"))


@query(f"""WITH {_PERCENTILE_CTE}
SELECT s.rbd, s.agno, s.grado, s.asignatura, (round(percentil_gse + 1e-7, 4) + 0e0) AS percentil_gse, n_gse AS n_pares
FROM s JOIN gse USING (rbd, agno, cod_grado, asignatura)""")
def peer_percentile_gse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(spark, sf_dir).filter("percentil_gse is not null").select("rbd", "agno", "grado", "asignatura", *_r4("percentil_gse"), F.col("percentil_gse_n").alias("n_pares"))


_PERCENTILE_ROWS = """SELECT s.rbd, s.agno, s.grado, 'current' AS segmento, 'simce_percentil' AS metrica, s.asignatura, (round(puntaje + 1e-7, 3) + 0e0) AS valor_real,
       (round(percentil_comuna + 1e-7, 4) + 0e0) AS percentil_comuna, (round(percentil_gse + 1e-7, 4) + 0e0) AS percentil_gse, coalesce(n_gse, n_com) AS n_puntos
FROM s LEFT JOIN com USING (rbd, agno, cod_grado, asignatura) LEFT JOIN gse USING (rbd, agno, cod_grado, asignatura)
WHERE percentil_comuna IS NOT NULL OR percentil_gse IS NOT NULL"""


@query(f"WITH {_PERCENTILE_CTE}\n{_PERCENTILE_ROWS}")
def percentile_records(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    p = percentiles(spark, sf_dir, facts).filter("percentil_comuna is not null or percentil_gse is not null")
    n = F.when(F.coalesce("percentil_gse_n", F.lit(0)) > 0, F.col("percentil_gse_n")).otherwise(F.col("percentil_comuna_n"))
    return p.select("rbd", "agno", "grado", F.lit("current").alias("segmento"), F.lit("simce_percentil").alias("metrica"), "asignatura", rnd("puntaje", 3).alias("valor_real"), *_r4("percentil_comuna", "percentil_gse"), n.alias("n_puntos"))


# Cross-source -------------------------------------------------------------------------------

def pairs(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    """Scores with the mark average of the year before, or of the same year where that row is missing."""
    facts = facts or Facts(spark, sf_dir)
    s, g = facts.series, grade_averages(spark, sf_dir, facts.grades)
    # each average meets the year after it and its own year: one shuffle instead of two joins
    shifted = g.select("rbd", "grado", "prom_global", F.explode(F.array(F.struct((F.col("agno") + 1).alias("agno"), F.lit(0).alias("order")), F.struct(F.col("agno").alias("agno"), F.lit(1).alias("order")))).alias("p"))
    best = shifted.select("rbd", "grado", "prom_global", "p.*").groupBy("rbd", "grado", "agno").agg(F.min_by(F.struct("prom_global"), "order").getField("prom_global").alias("prom_interno"))
    return s.join(best, ["rbd", "grado", "agno"]).filter("prom_interno is not null").select("rbd", "agno", "grado", "asignatura", "prom_interno", F.col("puntaje").alias("puntaje_simce"))


_PAIRS_CTE = f"""{CTE_AVERAGES}, {CTE_SERIES},
pairs AS (
  SELECT series.rbd, series.agno, series.grado, series.asignatura, CASE WHEN p.rbd IS NOT NULL THEN p.prom_global ELSE c.prom_global END AS prom_interno, puntaje AS puntaje_simce
  FROM series LEFT JOIN averages p ON p.rbd = series.rbd AND p.grado = series.grado AND p.agno = series.agno - 1
       LEFT JOIN averages c ON c.rbd = series.rbd AND c.grado = series.grado AND c.agno = series.agno
  WHERE CASE WHEN p.rbd IS NOT NULL THEN p.prom_global ELSE c.prom_global END IS NOT NULL)"""


@query(f"WITH {_PAIRS_CTE} SELECT rbd, agno, grado, asignatura, prom_interno, (round(puntaje_simce + 1e-7, 3) + 0e0) AS puntaje_simce FROM pairs")
def cross_pairs_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("rbd", "agno", "grado", "asignatura", "prom_interno", rnd("puntaje_simce", 3).alias("puntaje_simce"))


def _cross(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    last = F.max_by(F.struct("agno", "prom_interno", "puntaje_simce"), "agno")
    rows = pairs(spark, sf_dir, facts).repartition(*KEYS)  # as in `_together`
    return rows.groupBy(*KEYS).agg(last.alias("last"), F.count("*").alias("n_puntos"), correlation(F.col("prom_interno"), F.col("puntaje_simce")).alias("r")) \
        .select(*KEYS, F.col("last.agno").alias("agno"), (F.col("last.prom_interno") - F.col("last.puntaje_simce")).alias("brecha"), "r", "n_puntos")


_CROSS_CTE = f"""{_PAIRS_CTE},
crossed AS (
  SELECT rbd, grado, asignatura, max(agno) AS agno, max_by(prom_interno - puntaje_simce, agno) AS brecha, count(*) AS n_puntos,
         covar_pop(prom_interno, puntaje_simce) / nullif(stddev_pop(prom_interno) * stddev_pop(puntaje_simce), 0) AS r
  FROM pairs GROUP BY ALL)"""


@query(f"""WITH {_CROSS_CTE}
SELECT rbd, agno, grado, asignatura, (round(brecha + 1e-7, 2) + 0e0) AS valor_real, n_puntos, {sql_confidence('n_puntos')} AS confianza, abs(brecha) > 50 AS alerta FROM crossed""")
def cross_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir).select("rbd", "agno", "grado", "asignatura", rnd("brecha", 2).alias("valor_real"), "n_puntos", confidence(F.col("n_puntos")).alias("confianza"), (F.abs("brecha") > CONFIG.gap_alert).alias("alerta"))


@query(f"""WITH {_CROSS_CTE}
SELECT rbd, agno, grado, asignatura, (round(r + 1e-7, 4) + 0e0) AS valor_real, n_puntos, {sql_confidence('n_puntos')} AS confianza FROM crossed WHERE n_puntos >= 4""")
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir).filter(F.col("n_puntos") >= CONFIG.min_points_corr).select("rbd", "agno", "grado", "asignatura", rnd("r", 4).alias("valor_real"), "n_puntos", confidence(F.col("n_puntos")).alias("confianza"))


def _cross_measures(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    """The rows of `cross_gap` and `cross_correlation` from one pass over the pairs."""
    row = lambda metric, segment, value, alert: F.struct(F.lit(metric).alias("metrica"), F.lit(segment).alias("segmento"), value.alias("valor_real"), alert.alias("alerta"))
    both = F.array(row("cruce_brecha_interno_simce", "current", rnd("brecha", 2), F.abs("brecha") > CONFIG.gap_alert),
                   F.when(F.col("n_puntos") >= CONFIG.min_points_corr, row("cruce_correlacion_interno_simce", "full", rnd("r", 4), F.lit(False))))
    rows = _cross(spark, sf_dir, facts).select("rbd", "agno", "grado", "asignatura", "n_puntos", confidence(F.col("n_puntos")).alias("confianza"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("m"))
    return rows.select("rbd", "agno", "grado", "asignatura", "n_puntos", "confianza", "m.*")


# All metrics --------------------------------------------------------------------------------

METRIC_COLUMNS = {
    "rbd": "string", "agno": "int", "grado": "string", "segmento": "string", "metrica": "string", "asignatura": "string", "fuente": "string",
    "valor_real": "double", "valor_proyectado": "double", "tendencia_slope": "double", "tendencia_r2": "double", "rmse": "double",
    "percentil_gse": "double", "percentil_comuna": "double", "alerta": "boolean", "n_puntos": "bigint", "confianza": "string"}


def _family(df: DataFrame, metric: str | None, source: str, **constant) -> DataFrame:
    """Rows of one source in the columns of all metrics; without a metric's name df tells it."""
    fixed = {"fuente": source} | ({"metrica": metric} if metric else {}) | constant
    return df.select(*[(F.lit(fixed[c]) if c in fixed else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in METRIC_COLUMNS.items()])


def metrics(spark: SparkSession, sf_dir: str, facts: Facts | None = None) -> DataFrame:
    """Every metric of every school in one long table; missing measures are null. A plan, of which nothing runs before it is read.

    Whoever reads all of it gives it stored `facts`, so that the families do not work them out again.
    """
    facts = facts or Facts(spark, sf_dir)
    families = [
        _family(_told_trend(_trends(facts.series), *KEYS, "segmento"), "simce_tendencia", "simce"),
        _family(percentile_records(spark, sf_dir, facts), "simce_percentil", "simce", confianza="alta", alerta=False),
        _family(trend_grades(spark, sf_dir, facts.grades), "sige_tendencia", "sige"),
        _family(_cross_measures(spark, sf_dir, facts), None, "cruce")]
    return reduce(DataFrame.unionByName, families)


CTE_METRICS = f"""{_CROSS_CTE}, {CTE_SCHOOLS}, {_LATEST_CTE}, {_PEERS_CTE},
{_SEGMENTS}, {_sql_trend('segs')},
short AS (SELECT * REPLACE (substr(asignatura, 1, 40) AS asignatura) FROM grade_rows WHERE prom_notas IS NOT NULL),
{_sql_trend('short', 'prom_notas', 'rbd, grado, asignatura').replace('fits', 'gfits').replace('trends AS', 'gtrends AS')},
metrics AS (
  SELECT rbd, agno, grado, segmento, 'simce_tendencia' AS metrica, asignatura, 'simce' AS fuente, valor_real, valor_proyectado, tendencia_slope, tendencia_r2, rmse,
         CAST(NULL AS DOUBLE) AS percentil_gse, CAST(NULL AS DOUBLE) AS percentil_comuna, alerta, n_puntos, confianza FROM ({_TREND_COLUMNS})
  UNION ALL SELECT rbd, agno, grado, segmento, metrica, asignatura, 'simce', valor_real, NULL, NULL, NULL, NULL, percentil_gse, percentil_comuna, false, n_puntos, 'alta' FROM ({_PERCENTILE_ROWS})
  UNION ALL SELECT rbd, agno, grado, 'full', 'sige_tendencia', asignatura, 'sige', valor_real, valor_proyectado, tendencia_slope, tendencia_r2, rmse, NULL, NULL, alerta, n_puntos, confianza
    FROM ({_TREND_COLUMNS.replace("asignatura, segmento", "asignatura").replace("FROM trends", "FROM gtrends")})
  UNION ALL SELECT rbd, agno, grado, 'current', 'cruce_brecha_interno_simce', asignatura, 'cruce', (round(brecha + 1e-7, 2) + 0e0), NULL, NULL, NULL, NULL, NULL, NULL, abs(brecha) > 50, n_puntos, {sql_confidence('n_puntos')} FROM crossed
  UNION ALL SELECT rbd, agno, grado, 'full', 'cruce_correlacion_interno_simce', asignatura, 'cruce', (round(r + 1e-7, 4) + 0e0), NULL, NULL, NULL, NULL, NULL, NULL, false, n_puntos, {sql_confidence('n_puntos')} FROM crossed WHERE n_puntos >= 4)"""


@query(f"""WITH {CTE_METRICS}
SELECT metrica, segmento, fuente, count(*) AS n, count(*) FILTER (WHERE alerta) AS n_alertas, count(DISTINCT rbd) AS n_rbd, CAST(sum(n_puntos) AS BIGINT) AS puntos FROM metrics GROUP BY ALL""")
def metrics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric families in one table, counted by family."""
    return metrics(spark, sf_dir, Facts(spark, sf_dir, stored=True)).groupBy("metrica", "segmento", "fuente").agg(F.count("*").alias("n"), F.count_if("alerta").alias("n_alertas"), F.countDistinct("rbd").alias("n_rbd"), F.sum("n_puntos").alias("puntos"))


# Hierarchy ----------------------------------------------------------------------------------

@query(f"""WITH {CTE_SCHOOLS}, {CTE_SCORES}
SELECT nom_reg, nom_com, CAST(sum(n_eval_mat) AS BIGINT) AS n_eval, (round(CAST(sum(cents_mat) AS DOUBLE) / 100e0 / nullif(sum(n_eval_mat), 0) + 1e-7, 3) + 0e0) AS prom_mat
FROM scores JOIN schools USING (rbd) GROUP BY ROLLUP (nom_reg, nom_com)""")
def rollup_territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores summed along municipality, region and country."""
    s = scores_wide(spark, sf_dir).join(schools(spark, sf_dir), "rbd")
    return s.rollup("nom_reg", "nom_com").agg(F.sum("n_eval_mat").alias("n_eval"), rnd(F.sum("cents_mat") / 100e0 / F.nullif(F.sum("n_eval_mat"), F.lit(0)), 3).alias("prom_mat"))


@query(f"""WITH {CTE_SERIES}
SELECT a.rbd, a.agno, a.grado, a.asignatura, (round(a.puntaje - b.puntaje + 1e-7, 3) + 0e0) AS cambio
FROM series a JOIN series b ON a.rbd = b.rbd AND a.cod_grado = b.cod_grado AND a.asignatura = b.asignatura AND b.agno = a.agno - 1""")
def previous_year_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the year before exactly; years without one drop out."""
    w = Window.partitionBy("rbd", "cod_grado", "asignatura").orderBy("agno").rangeBetween(-1, -1)
    s = score_series(spark, sf_dir).withColumn("antes", F.max("puntaje").over(w))
    return s.filter("antes is not null").select("rbd", "agno", "grado", "asignatura", rnd(F.col("puntaje") - F.col("antes"), 3).alias("cambio"))
