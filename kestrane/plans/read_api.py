"""Read queries over the metrics of one school, and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import norm_rbd
from ..functions.labels import GRADES, SUBJECTS, fixed, lookup
from ..scratch import materialise, shared_path
from .analytics import (
    _GRADE_TREND_CTE, _MELT_SQL, _SEGMENTS, _TREND_COLUMNS, CTE_METRICS, KEYS, METRIC_COLUMNS, Facts, _sql_trend, _told_trend, _trends, grade_series, metrics, score_series_melt, trend_grades)
from .model import CTE_SERIES, rnd, score_series
from .registry import query

SCHOOL = "00000001"
_MEASURES = [c for c, t in METRIC_COLUMNS.items() if t == "double"]


def school_key(spark: SparkSession, text: str) -> str:
    """The school id that a text stands for; ValueError without any digit."""
    found = spark.range(1).select(norm_rbd(F.lit(text)).alias("r")).head().r
    if found is None:
        raise ValueError(f"no school id in {text!r}")
    return found


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rnd(c, 2) for c in _MEASURES})


_SQL_ROUNDED = ", ".join(f"(round({c} + 1e-7, 2) + 0e0) AS {c}" if t == "double" else c for c, t in METRIC_COLUMNS.items())


def _worked_out(spark: SparkSession, sf_dir: str, rbd: str | None) -> DataFrame:
    """All metrics; of one school a plan whose steps read that school alone, of every school on facts that are stored once."""
    return metrics(spark, sf_dir, Facts(spark, sf_dir, stored=True) if rbd is None else None)


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED}, count(*) FILTER (WHERE alerta) OVER () AS n_alertas FROM metrics WHERE rbd = '{SCHOOL}'")
def metrics_by_school(spark: SparkSession, sf_dir: str, rbd: str | None = SCHOOL, segment: str | None = None, source: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """All metrics of a school, or with None of every school, with optional segment and source, and how many of the school's are alerts.

    `stored`: the table of all metrics as `runner.store_metrics` wrote it, of which only the
    school's part is read; without it the metrics are worked out.
    """
    m = _worked_out(spark, sf_dir, rbd) if stored is None else stored
    for column, value in (("rbd", rbd), ("segmento", segment), ("fuente", source)):
        if value is not None:
            m = m.filter(F.col(column) == value)
    from pyspark.sql import Window

    m = _rounded(m).withColumn("n_alertas", F.count_if("alerta").over(Window.partitionBy("rbd")))
    return m.orderBy("fuente", "metrica", "segmento", F.asc_nulls_last("grado"), F.asc_nulls_last("asignatura"), F.desc_nulls_first("agno"))


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED} FROM metrics WHERE rbd = '{SCHOOL}' AND alerta")
def active_alerts(spark: SparkSession, sf_dir: str, rbd: str | None = SCHOOL, stored: DataFrame | None = None) -> DataFrame:
    """A school's alerts, or with None every school's; `stored` as in `metrics_by_school`."""
    m = (_worked_out(spark, sf_dir, rbd) if stored is None else stored).filter("alerta")
    return _rounded(m if rbd is None else m.filter(F.col("rbd") == rbd)).orderBy("fuente", "metrica", F.asc_nulls_last("grado"), F.asc_nulls_last("asignatura"))


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED}, count(*) FILTER (WHERE alerta) OVER (PARTITION BY rbd) AS n_alertas FROM metrics")
def metrics_by_school_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_by_school(spark, sf_dir, None)


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED} FROM metrics WHERE alerta")
def active_alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_alerts(spark, sf_dir, None)


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED}, count(*) FILTER (WHERE alerta) OVER (PARTITION BY rbd) AS n_alertas FROM metrics")
def metrics_stored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`metrics_by_school_all` from the stored table of all metrics, worked out once."""
    return metrics_by_school(spark, sf_dir, None, stored=_stored(spark, sf_dir))


@query(f"WITH {CTE_METRICS} SELECT {_SQL_ROUNDED} FROM metrics WHERE alerta")
def alerts_stored_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`active_alerts_all` from the stored table of all metrics."""
    return active_alerts(spark, sf_dir, None, stored=_stored(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runner import store_metrics, stored_metrics

    out = shared_path(spark, "stored")
    store_metrics(spark, sf_dir, out)
    return stored_metrics(spark, out)


def scores_by_grade(spark: SparkSession, sf_dir: str, rbd: str | None = SCHOOL, grade: str | None = "4B") -> DataFrame:
    """A school's score series of one grade, grades in any case; None stands for all schools or all grades."""
    return _of_grade(score_series_melt(spark, sf_dir, rbd), grade)


def grades_by_grade(spark: SparkSession, sf_dir: str, rbd: str | None = SCHOOL, grade: str | None = "4B") -> DataFrame:
    g = grade_series(spark, sf_dir)
    return _of_grade(g if rbd is None else g.filter(F.col("rbd") == rbd), grade)


def _of_grade(rows: DataFrame, grade: str | None) -> DataFrame:
    return (rows if grade is None else rows.filter(F.col("grado") == grade.lower())).orderBy("agno", "asignatura")


@query(_MELT_SQL)
def scores_by_grade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_by_grade(spark, sf_dir, None, None)


def _from(name: str, where: str) -> str:
    from .registry import ORACLE_SQL

    return f"SELECT * FROM ({ORACLE_SQL[name]}) WHERE {where}"


query(_from("score_series_melt", "grado = '4b'"))(scores_by_grade)
query(_from("grade_series", f"rbd = '{SCHOOL}' AND grado = '4b'"))(grades_by_grade)


@query(_from("grade_series", "true"))
def grades_by_grade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades_by_grade(spark, sf_dir, None, None)


# Series with trends -------------------------------------------------------------------------

_TREND_FIELDS = {"valor_proyectado": "proyectado", "tendencia_slope": "slope", "tendencia_r2": "r2", "alerta": "alerta", "confianza": "confianza"}


def _beside(series: DataFrame, trends: DataFrame, segments: dict[str, str], subject: Column) -> DataFrame:
    """series with the trend of its school, grade and subject beside each row, <field>_<short name> per segment."""
    told = F.struct(*[F.col(c).alias(name) for c, name in _TREND_FIELDS.items()])
    wide = trends.groupBy(*[F.col(k).alias(f"t_{k}") for k in KEYS]).agg(*[F.max(F.when(F.col("segmento") == s, told)).alias(f"t_{short}") for s, short in segments.items()])
    joined = series.join(wide, (F.col("rbd") == F.col("t_rbd")) & (F.col("grado") == F.col("t_grado")) & (subject == F.col("t_asignatura")), "left")
    return joined.select(*series.columns, *[F.col(f"t_{short}.{name}").alias(f"{name}_{short}") for short in segments.values() for name in _TREND_FIELDS.values()])


def _sql_beside(segments: dict[str, str], subject: str) -> str:
    fields = ", ".join(f"t_{short}.{c} AS {name}_{short}" for short in segments.values() for c, name in _TREND_FIELDS.items())
    joins = " ".join(f"LEFT JOIN told t_{short} ON t_{short}.rbd = x.rbd AND t_{short}.grado = x.grado AND t_{short}.asignatura = {subject} AND t_{short}.segmento = '{s}'" for s, short in segments.items())
    return f"SELECT x.*, {fields} FROM x {joins}"


SCORE_SEGMENTS, GRADE_SEGMENTS = {"full_excl_hiatus": "full", "post_hiatus": "post"}, {"full": "full"}


@query(f"WITH {CTE_SERIES}, {_SEGMENTS}, {_sql_trend('segs')}, told AS ({_TREND_COLUMNS}), x AS ({_MELT_SQL}) {_sql_beside(SCORE_SEGMENTS, 'x.asignatura')}")
def scores_with_trends_all(spark: SparkSession, sf_dir: str, rbd: str | None = None, grade: str | None = None) -> DataFrame:
    """Every school's score series against the mean of all, with the trends of both segments; or one school's, one grade's."""
    trends = _told_trend(_trends(score_series(spark, sf_dir)), *KEYS, "segmento")
    return _beside(_of_grade(score_series_melt(spark, sf_dir, rbd), grade), trends, SCORE_SEGMENTS, F.col("asignatura"))


@query(f"""WITH {_GRADE_TREND_CTE}, told AS ({_TREND_COLUMNS.replace("asignatura, segmento", "asignatura, 'full' AS segmento")}),
x AS (SELECT rbd, agno, grado, asignatura, prom_notas, tasa_aprobacion, tasa_asistencia, n_alumnos FROM grade_rows) {_sql_beside(GRADE_SEGMENTS, 'substr(x.asignatura, 1, 40)')}""")
def grades_with_trends_all(spark: SparkSession, sf_dir: str, rbd: str | None = None, grade: str | None = None) -> DataFrame:
    """Every school's marks by subject and year, with their trend; or one school's, one grade's."""
    g = grade_series(spark, sf_dir)
    g = _of_grade(g if rbd is None else g.filter(F.col("rbd") == rbd), grade)
    return _beside(g, trend_grades(spark, sf_dir), GRADE_SEGMENTS, F.substring("asignatura", 1, 40))


# Texts --------------------------------------------------------------------------------------

# The texts of the insights. {c}: grade and subject; {s}: slope; {g}: segment;
# {k}: confidence; {p}: percentile; {b}, {b_abs}: gap with and without sign; {r}: correlation.
TEXTS = {
    "score_alert": "⚠ {c}: el puntaje SIMCE del último año se aleja de la tendencia histórica. Requiere análisis inmediato.",
    "score_up": "{c}: tendencia SIMCE al alza ({s} puntos/año en el segmento {g}). El establecimiento muestra mejora sostenida.",
    "score_down": "{c}: tendencia SIMCE a la baja ({s} puntos/año). Confianza del modelo: {k}.",
    "rank_low": "{c}: el establecimiento está en el percentil {p} comparado con colegios de la misma comuna. Hay margen de mejora significativo.",
    "rank_high": "{c}: el establecimiento está en el percentil {p} dentro de su comuna — rendimiento destacado.",
    "mark_alert": "⚠ Calificaciones internas {c}: el promedio del último año se aleja de la tendencia histórica.",
    "mark_down": "Calificaciones internas {c}: baja gradual ({s} puntos/año). Revisar metodología o contexto del curso.",
    "mark_up": "Calificaciones internas {c}: mejora continua ({s} puntos/año).",
    "gap_large": "⚠ {c}: brecha de {b} puntos entre notas internas y SIMCE. Una diferencia tan grande puede indicar inflación de calificaciones.",
    "gap_above": "{c}: las notas internas son {b_abs} puntos más altas que el puntaje SIMCE — posible desalineación entre evaluación interna y estándar nacional.",
    "gap_below": "{c}: el puntaje SIMCE supera en {b_abs} puntos al promedio de calificaciones internas — patrón inusual.",
    "gap_small": "{c}: buena coherencia entre calificaciones internas y puntaje SIMCE (brecha de {b} puntos).",
    "corr_high": "{c}: alta correlación (r={r}) entre notas internas y SIMCE. El sistema de evaluación interna predice bien el rendimiento externo.",
    "corr_low": "{c}: baja correlación (r={r}) entre notas internas y SIMCE. El sistema de evaluación interna no predice el rendimiento externo.",
}
LEVELS = ("critico", "advertencia", "info")

#: Which text and level a metric gets: (metric, condition, text, level), the first that holds; conditions are SQL of both engines.
RULES = (
    ("simce_tendencia", "tendencia_slope IS NOT NULL AND alerta", "score_alert", "'critico'"),
    ("simce_tendencia", "tendencia_slope > 0", "score_up", "'info'"),
    ("simce_tendencia", "tendencia_slope IS NOT NULL", "score_down", "CASE WHEN confianza IN ('alta', 'media') THEN 'advertencia' ELSE 'info' END"),
    ("simce_percentil", "percentil_comuna < 30", "rank_low", "'advertencia'"),
    ("simce_percentil", "percentil_comuna >= 70", "rank_high", "'info'"),
    ("sige_tendencia", "tendencia_slope IS NOT NULL AND alerta", "mark_alert", "'critico'"),
    ("sige_tendencia", "tendencia_slope < -0.05", "mark_down", "'advertencia'"),
    ("sige_tendencia", "tendencia_slope > 0.05", "mark_up", "'info'"),
    ("cruce_brecha_interno_simce", "abs(valor_real) > 50", "gap_large", "'critico'"),
    ("cruce_brecha_interno_simce", "valor_real > 20", "gap_above", "'advertencia'"),
    ("cruce_brecha_interno_simce", "valor_real < -20", "gap_below", "'advertencia'"),
    ("cruce_brecha_interno_simce", "valor_real IS NOT NULL", "gap_small", "'info'"),
    ("cruce_correlacion_interno_simce", "valor_real >= 0.6", "corr_high", "'info'"),
    ("cruce_correlacion_interno_simce", "valor_real < 0.3", "corr_low", "'advertencia'"),
)


def insights(m: DataFrame) -> DataFrame:
    """metrica, agno, grado, asignatura, texto, nivel for the metrics that a rule speaks about."""
    subject = F.coalesce(lookup(F.col("asignatura"), SUBJECTS, F.col("asignatura")), F.lit(""))
    grade = F.coalesce(lookup(F.lower("grado"), GRADES, F.col("grado")), F.lit(""))
    slope = F.when(F.col("metrica") == "simce_tendencia", fixed(F.col("tendencia_slope"), 1, True)).otherwise(fixed(F.col("tendencia_slope"), 2, True))
    parts = {"c": F.btrim(F.concat(grade, F.lit(" — "), subject), F.lit(" —")), "s": slope, "g": F.replace("segmento", F.lit("_"), F.lit("-")), "k": F.col("confianza"), "p": fixed(F.col("percentil_comuna"), 0),
             "b": fixed(F.col("valor_real"), 0, True), "b_abs": fixed(F.abs("valor_real"), 0), "r": fixed(F.col("valor_real"), 2)}
    text, level = F, F
    for metric, condition, name, lev in RULES:
        holds = (F.col("metrica") == metric) & F.expr(condition)
        text, level = text.when(holds, _filled(TEXTS[name], parts)), level.when(holds, F.expr(lev))
    return m.select("rbd", "metrica", "segmento", "agno", "grado", "asignatura", text.alias("texto"), level.alias("nivel")).filter("texto is not null")


def _filled(template: str, parts: dict[str, Column]) -> Column:
    """The template with its parts put in, as one concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(head), parts[name]]
    return F.concat(*out, F.lit(rest))


def _sql_fixed(value: str, digits: int, sign: bool = False) -> str:
    whole, step = f"CAST(round({value} * 10000) AS BIGINT)", 10 ** (4 - digits)
    n = f"((abs({whole}) + {step // 2}) // {step})"
    body = f"CAST({n} // {10**digits} AS VARCHAR)" + (f" || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0')" if digits else "")
    return f"(CASE WHEN {whole} < 0 THEN '-' ELSE '{'+' if sign else ''}' END || {body})"


def _sql_insights() -> str:
    label = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    parts = {
        "c": f"trim(coalesce({label('lower(grado)', GRADES)} ELSE grado END, '') || ' — ' || coalesce({label('asignatura', SUBJECTS)} ELSE asignatura END, ''), ' —')",
        "s": f"CASE WHEN metrica = 'simce_tendencia' THEN {_sql_fixed('tendencia_slope', 1, True)} ELSE {_sql_fixed('tendencia_slope', 2, True)} END",
        "g": "replace(segmento, '_', '-')", "k": "confianza", "p": _sql_fixed("percentil_comuna", 0), "b": _sql_fixed("valor_real", 0, True), "b_abs": _sql_fixed("abs(valor_real)", 0), "r": _sql_fixed("valor_real", 2)}

    def text(template: str) -> str:
        out = "'" + template + "'"
        for name in parts:
            out = out.replace("{" + name + "}", f"' || part_{name} || '")
        return out

    columns = ", ".join(f"{sql} AS part_{name}" for name, sql in parts.items())
    cases = lambda what: "CASE " + " ".join(f"WHEN metrica = '{m}' AND {c} THEN {what(t, v)}" for m, c, t, v in RULES) + " END"
    return f"""WITH {CTE_METRICS}, m AS MATERIALIZED (SELECT * FROM metrics), parts AS MATERIALIZED (SELECT *, {columns} FROM m),
told AS (SELECT rbd, metrica, segmento, agno, grado, asignatura, {cases(lambda t, v: text(TEXTS[t]))} AS texto, {cases(lambda t, v: v)} AS nivel FROM parts)
SELECT * FROM told WHERE texto IS NOT NULL"""


@query(_sql_insights())
def insights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for every school, the critical ones first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("nivel"))
    told = materialise(insights(_worked_out(spark, sf_dir, None)), "insights")  # a sort over ranges reads its input twice
    return told.orderBy("rbd", rank, "metrica", F.asc_nulls_last("grado"), F.asc_nulls_last("asignatura"), "segmento", "agno")
