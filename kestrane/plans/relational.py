"""Views, dimensions and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import insert_ignore, keep_last, lookup_or_create, merge_coalesce, merge_partial, merge_replace
from ..tables import table
from .model import CTE_MARKS, CTE_SCHOOLS, CTE_SCORES, half_up, hundredths, marks, rnd, schools, scores_wide, sql_half_up
from .registry import query

# Views --------------------------------------------------------------------------------------


@query(f"""WITH {CTE_SCHOOLS}, {CTE_SCORES}
SELECT agno, cod_grado, rbd, nom_rbd, cod_depe, cod_com, nom_com, cod_reg, nom_reg, (round(ptje_mat + 1e-7, 3) + 0e0) AS ptje_mat, (round(ptje_lect + 1e-7, 3) + 0e0) AS ptje_lect,
       (round(ptje_cie + 1e-7, 3) + 0e0) AS ptje_cie, n_eval_mat, n_eval_lect, gse
FROM scores JOIN schools USING (rbd)""")
def view_scores_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score fact with its school and territory."""
    s = scores_wide(spark, sf_dir).join(schools(spark, sf_dir), "rbd")
    return s.select("agno", "cod_grado", "rbd", "nom_rbd", "cod_depe", "cod_com", "nom_com", "cod_reg", "nom_reg",
                    *[rnd(f"ptje_{x}", 3).alias(f"ptje_{x}") for x in ("mat", "lect", "cie")], "n_eval_mat", "n_eval_lect", "gse")


@query(f"""WITH {CTE_SCHOOLS}, {CTE_SCORES}
SELECT rbd, nom_rbd, agno, cod_grado, {sql_half_up('cents_mat', 'n_eval_mat', 1)} AS avg_mat, {sql_half_up('cents_lect', 'n_eval_lect', 1)} AS avg_lect,
       {sql_half_up('cents_cie', 'n_eval_cie', 1)} AS avg_cie, n_eval_mat AS total_eval
FROM scores JOIN schools USING (rbd)""")
def view_scores_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by school, year and grade to one decimal: the fact has one row for each already."""
    s = scores_wide(spark, sf_dir).join(schools(spark, sf_dir).select("rbd", "nom_rbd"), "rbd")
    return s.select("rbd", "nom_rbd", "agno", "cod_grado", *[half_up(F.col(f"cents_{x}"), F.col(f"n_eval_{x}"), 1).alias(f"avg_{x}") for x in ("mat", "lect", "cie")], F.col("n_eval_mat").alias("total_eval"))


@query(f"""WITH {CTE_SCHOOLS}, {CTE_MARKS}
SELECT agno, cod_grado, rbd, nom_rbd, letra, alumno_id, c_mktsegment AS segmento_alumno, subsector, CAST(promedio AS DOUBLE) AS promedio,
       CAST(asistencia_pct AS DOUBLE) AS asistencia_pct, situacion_final
FROM marks JOIN schools USING (rbd) LEFT JOIN customer ON alumno_id = c_custkey""")
def view_grades_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course marks with their school and pupil; pupils not on file stay, without attributes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alumno_id"), F.col("c_mktsegment").alias("segmento_alumno"))
    m = marks(spark, sf_dir).join(schools(spark, sf_dir).select("rbd", "nom_rbd"), "rbd").join(c, "alumno_id", "left")
    return m.select("agno", "cod_grado", "rbd", "nom_rbd", "letra", "alumno_id", "segmento_alumno", "subsector", F.col("promedio").cast("double").alias("promedio"), F.col("asistencia_pct").cast("double").alias("asistencia_pct"), "situacion_final")


_SLOTS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, slot, nota FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 AS slot, CASE WHEN l_quantity >= 10 THEN l_quantity END AS nota FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 2, CASE WHEN l_discount > 0 THEN l_discount END FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 3, CASE WHEN l_tax > 0 THEN l_tax END FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 4, l_extendedprice FROM lineitem) WHERE nota IS NOT NULL""")
def view_marks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide columns of values to rows (slot, value), nulls left out: a narrow expansion."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    value = {"l_quantity": F.when(F.col("l_quantity") >= 10, F.col("l_quantity")), "l_discount": F.when(F.col("l_discount") > 0, F.col("l_discount")), "l_tax": F.when(F.col("l_tax") > 0, F.col("l_tax")), "l_extendedprice": F.col("l_extendedprice")}
    wide = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[value[c].alias(f"nota_{i}") for i, c in enumerate(_SLOTS, 1)])
    return unpivot_marks(wide, len(_SLOTS))


ALL_SLOTS = 25


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(slot AS INTEGER) AS slot, v / 10e0 AS nota FROM (
  SELECT *, (l_partkey * 7 + l_linenumber * 3 + slot * 13) % 71 AS v FROM lineitem, range(1, {ALL_SLOTS + 1}) s(slot)) WHERE v >= 10""")
def view_marks_long_all_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record sheet's 25 slots of marks as rows, empty ones left out."""
    raw = lambda i: (F.col("l_partkey") * 7 + F.col("l_linenumber") * 3 + i * 13) % 71
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.when(raw(i) >= 10, raw(i) / 10.0).alias(f"nota_{i}") for i in range(1, ALL_SLOTS + 1)])
    return unpivot_marks(wide, ALL_SLOTS)


def unpivot_marks(wide: DataFrame, slots: int) -> DataFrame:
    """nota_1..nota_n to rows (slot, nota)."""
    columns = [f"nota_{i}" for i in range(1, slots + 1)]
    stack = ", ".join(f"{i}, nota_{i}" for i in range(1, slots + 1))
    return wide.select(*[c for c in wide.columns if c not in columns], F.expr(f"stack({slots}, {stack}) as (slot, nota)")).filter("nota is not null")


@query(f"""WITH {CTE_SCHOOLS}, {CTE_MARKS}
SELECT agno, cod_grado, rbd, nom_rbd, letra, count(DISTINCT alumno_id) AS n_alumnos,
       {sql_half_up('sum(CAST(promedio * 100 AS BIGINT))', 'count(promedio)', 2)} AS prom_curso,
       {sql_half_up('sum(CAST(asistencia_pct * 100 AS BIGINT))', 'count(asistencia_pct)', 1)} AS asist_prom,
       count(*) FILTER (WHERE situacion_final = 'APR') AS aprobados, count(*) FILTER (WHERE situacion_final = 'REP') AS reprobados,
       count(*) FILTER (WHERE situacion_final = 'RET') AS retirados
FROM marks JOIN schools USING (rbd) GROUP BY ALL""")
def view_course_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir).groupBy("agno", "cod_grado", "rbd", "letra").agg(
        F.countDistinct("alumno_id").alias("n_alumnos"), hundredths("promedio").alias("p"), F.count("promedio").alias("np"), hundredths("asistencia_pct").alias("a"), F.count("asistencia_pct").alias("na"),
        *[F.count_if(F.col("situacion_final") == s).alias(n) for s, n in (("APR", "aprobados"), ("REP", "reprobados"), ("RET", "retirados"))])
    return m.join(schools(spark, sf_dir).select("rbd", "nom_rbd"), "rbd").select(
        "agno", "cod_grado", "rbd", "nom_rbd", "letra", "n_alumnos", half_up(F.col("p"), F.col("np"), 2).alias("prom_curso"), half_up(F.col("a"), F.col("na"), 1).alias("asist_prom"), "aprobados", "reprobados", "retirados")


# Dimensions ---------------------------------------------------------------------------------


@query("""SELECT CAST(a.agno AS INTEGER) AS agno, CAST(g.cod_grado AS INTEGER) AS cod_grado,
       CASE WHEN cod_grado <= 8 THEN cod_grado || '° básico' ELSE (cod_grado - 8) || '° medio' END AS grado_label,
       CASE WHEN cod_grado <= 8 THEN 'basico' ELSE 'medio' END AS nivel,
       CASE WHEN cod_grado <= 4 THEN 'primer_ciclo' WHEN cod_grado <= 8 THEN 'segundo_ciclo' ELSE 'EM' END AS ciclo
FROM range(2013, 2031) a(agno), range(1, 13) g(cod_grado)""")
def dim_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School years by grade, generated: 18 by 12 rows, whatever the data. The labels are fixed values."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(2013), F.lit(2030))).alias("agno")).select("agno", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("cod_grado"))
    g = F.col("cod_grado")
    return grid.select("agno", "cod_grado", F.when(g <= 8, F.concat(g, F.lit("° básico"))).otherwise(F.concat(g - 8, F.lit("° medio"))).alias("grado_label"),
                       F.when(g <= 8, "basico").otherwise("medio").alias("nivel"), F.when(g <= 4, "primer_ciclo").when(g <= 8, "segundo_ciclo").otherwise("EM").alias("ciclo"))


@query("""SELECT n_nationkey AS cod_com, n_name AS nom_com, r_regionkey AS cod_reg, r_name AS nom_reg, count(s_suppkey) AS n_establecimientos
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def dim_territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territories with their region and number of schools; schools are counted before the join."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("s_suppkey").alias("n_establecimientos"))
    t = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return t.select(F.col("n_nationkey").alias("cod_com"), F.col("n_name").alias("nom_com"), F.col("r_regionkey").alias("cod_reg"), F.col("r_name").alias("nom_reg"), F.coalesce("n_establecimientos", F.lit(0)).alias("n_establecimientos"))


@query(f"""WITH {CTE_SCHOOLS}, {CTE_SCORES}
SELECT rbd, nom_rbd, cod_depe, cod_com, l.agno, l.cod_grado, l.gse FROM schools LEFT JOIN (
  SELECT rbd, agno, cod_grado, gse FROM scores QUALIFY row_number() OVER (PARTITION BY rbd ORDER BY agno DESC, cod_grado DESC) = 1) l USING (rbd)""")
def dim_school_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each school with the attributes of its latest period."""
    last = scores_wide(spark, sf_dir).groupBy("rbd").agg(F.max_by(F.struct("agno", "cod_grado", "gse"), F.struct("agno", "cod_grado")).alias("l"))
    return schools(spark, sf_dir).join(last, "rbd", "left").select("rbd", "nom_rbd", "cod_depe", "cod_com", "l.agno", "l.cod_grado", "l.gse")


@query("""SELECT subsector, bool_or(known) AS conocida FROM (SELECT p_type AS subsector, true AS known FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT DISTINCT p_type, false FROM part JOIN lineitem ON l_partkey = p_partkey) GROUP BY subsector""")
def dim_subject_lookup_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of subjects completed by those that the facts name."""
    p = table(spark, sf_dir, "part")
    dim = p.filter("p_partkey % 2 = 0").select(F.col("p_type").alias("subsector")).distinct().withColumn("conocida", F.lit(True))
    used = p.join(table(spark, sf_dir, "lineitem").select("l_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_type").alias("subsector"))
    return lookup_or_create(dim, used, ["subsector"]).select("subsector", F.coalesce("conocida", F.lit(False)).alias("conocida"))


@query("""SELECT s_suppkey AS id, s_name AS nombre, false AS creado FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT DISTINCT l_suppkey, NULL, true FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)""")
def school_stub_from_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools with a minimal row for each that only the facts know."""
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.lit(False).alias("creado"))
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"))
    return lookup_or_create(known, wanted, ["id"]).withColumn("creado", F.coalesce("creado", F.lit(True)))


# Upserts ------------------------------------------------------------------------------------

_OLD = "old AS (SELECT c_custkey AS id, c_acctbal AS a, c_mktsegment AS b, c_name AS c FROM customer WHERE c_custkey % 4 <> 0)"
_NEW = """new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1000 END AS a, CASE WHEN c_custkey % 7 <> 0 THEN 'NEW' END AS b,
  upper(c_name) AS c FROM customer WHERE c_custkey % 2 = 0)"""


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.filter(k % 4 != 0).select(k.alias("id"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_name").alias("c"))
    new = c.filter(k % 2 == 0).select(k.alias("id"), F.when(k % 5 != 0, F.col("c_acctbal") + 1000).alias("a"), F.when(k % 7 != 0, F.lit("NEW")).alias("b"), F.upper("c_name").alias("c"))
    return old, new


@query(f"WITH {_OLD}, {_NEW} SELECT id, (round(a + 1e-7, 2) + 0e0) AS a, b, c FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new))")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replace(*_old_and_new(spark, sf_dir), ["id"]).withColumn("a", rnd("a", 2))


@query(f"WITH {_OLD}, {_NEW} SELECT id, (round(coalesce(n.a, o.a) + 1e-7, 2) + 0e0) AS a, coalesce(n.b, o.b) AS b, coalesce(n.c, o.c) AS c FROM old o FULL JOIN new n USING (id)")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_coalesce(*_old_and_new(spark, sf_dir), ["id"]).withColumn("a", rnd("a", 2))


@query(f"""WITH {_OLD}, {_NEW} SELECT id, (round(CASE WHEN n.c IS NOT NULL THEN n.a ELSE o.a END + 1e-7, 2) + 0e0) AS a, CASE WHEN o.c IS NOT NULL THEN o.b ELSE n.b END AS b,
       CASE WHEN o.c IS NOT NULL THEN o.c ELSE n.c END AS c FROM old o FULL JOIN new n USING (id)""")
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where both sides have a key only column a is replaced."""
    return merge_partial(*_old_and_new(spark, sf_dir), ["id"], ["a"]).withColumn("a", rnd("a", 2))


@query(f"WITH {_OLD}, {_NEW} SELECT id, (round(a + 1e-7, 2) + 0e0) AS a, b, c FROM (SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old))")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_ignore(*_old_and_new(spark, sf_dir), ["id"]).withColumn("a", rnd("a", 2))


# A batch that names a customer once for each of their orders; the last order in time counts.
_BATCH = """batch AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS b,
  o_orderpriority AS c, o_orderdate AS dia, o_orderkey AS k FROM orders)"""
_CHOSEN = "SELECT id, (round(a + 1e-7, 2) + 0e0) AS a, b, c"


def _old_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The old table, and a batch with the columns dia and k that its rows are in order of."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    batch = o.select(F.col("o_custkey").alias("id"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("a"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("b"),
                     F.col("o_orderpriority").alias("c"), F.col("o_orderdate").alias("dia"), k.alias("k"))
    old = _old_and_new(spark, sf_dir)[0]
    return old.select("*", F.lit(None).cast("timestamp").alias("dia"), F.lit(None).cast("bigint").alias("k")), batch.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in old.columns else c for c in batch.columns])


def _chosen(merged: DataFrame) -> DataFrame:
    return merged.select("id", rnd("a", 2).alias("a"), "b", "c")


@query(f"""WITH {_OLD}, {_BATCH}, last AS (SELECT id, a, b, c FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY dia DESC, k DESC) = 1)
{_CHOSEN} FROM (SELECT * FROM last UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM last))""")
def upsert_replace_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose keys repeat: the last row of a key wins."""
    return _chosen(merge_replace(*_old_and_batch(spark, sf_dir), ["id"], ["dia", "k"]))


@query(f"""WITH {_OLD}, {_BATCH}, folded AS (
  SELECT id, last(a ORDER BY dia, k) FILTER (WHERE a IS NOT NULL) AS a, last(b ORDER BY dia, k) FILTER (WHERE b IS NOT NULL) AS b, last(c ORDER BY dia, k) AS c FROM batch GROUP BY id)
SELECT id, (round(coalesce(n.a, o.a) + 1e-7, 2) + 0e0) AS a, coalesce(n.b, o.b) AS b, coalesce(n.c, o.c) AS c FROM old o FULL JOIN folded n USING (id)""")
def upsert_coalesce_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose keys repeat: column by column the last value that is not null wins."""
    return _chosen(merge_coalesce(*_old_and_batch(spark, sf_dir), ["id"], ["dia", "k"]))


@query(f"""WITH {_OLD}, {_BATCH}, firsts AS (SELECT id, a, b, c FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY dia, k) = 1)
{_CHOSEN} FROM (SELECT * FROM old UNION ALL SELECT * FROM firsts WHERE id NOT IN (SELECT id FROM old))""")
def insert_or_ignore_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose keys repeat: the first row of a new key is added."""
    return _chosen(insert_ignore(*_old_and_batch(spark, sf_dir), ["id"], ["dia", "k"]))


@query(f"""WITH {_OLD}, {_BATCH},
lasts AS (SELECT id, a FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY dia DESC, k DESC) = 1),
firsts AS (SELECT id, b, c FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY dia, k) = 1)
SELECT id, (round(CASE WHEN n.id IS NOT NULL THEN n.a ELSE o.a END + 1e-7, 2) + 0e0) AS a, CASE WHEN o.id IS NOT NULL THEN o.b ELSE f.b END AS b,
       CASE WHEN o.id IS NOT NULL THEN o.c ELSE f.c END AS c FROM old o FULL JOIN lasts n USING (id) LEFT JOIN firsts f USING (id)""")
def upsert_partial_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose keys repeat: the last value of column a, the other columns of the first row of a new key."""
    return _chosen(merge_partial(*_old_and_batch(spark, sf_dir), ["id"], ["a"], ["dia", "k"]))


@query("""SELECT user_id, event_type, event_id, (round(value + 1e-7, 4) + 0e0) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key in an explicit order."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", rnd("value", 4).alias("value"), "ts")
    return keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS nombre, CAST(c_nationkey AS INTEGER) AS pais, c_mktsegment AS segmento, CAST(NULL AS VARCHAR) AS origen FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier""")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag union of inputs whose columns differ."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.col("c_nationkey").alias("pais"), F.col("c_mktsegment").alias("segmento"))
    b = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.col("s_nationkey").alias("pais"), F.lit("supplier").alias("origen"))
    return a.unionByName(b, allowMissingColumns=True)


_ENROL_RAW = """raw AS (
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN ' x1 ' ELSE ' ' || o_custkey || ' ' END AS mrun, ' ' || (o_orderkey % 150) || ' ' AS rbd,
         CASE WHEN o_orderkey % 13 = 0 THEN '19' ELSE ' ' || year(o_orderdate) END AS agno, '' || (o_orderkey % 7 + 1) || ' ' AS cod_grado,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y%m%d')
              ELSE strftime(o_orderdate, '%Y-%m') END AS fec_nac_alu, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS let_cur
  FROM orders)"""


@query(f"""WITH {CTE_SCHOOLS}, {_ENROL_RAW}
SELECT CAST(trim(mrun) AS BIGINT) AS mrun, s.rbd, CAST(trim(agno) AS INTEGER) AS agno, CAST(trim(cod_grado) AS INTEGER) AS cod_grado,
       max(nullif(trim(let_cur), '')) AS let_cur, count(*) AS n_filas,
       max(CAST(CASE WHEN regexp_full_match(trim(fec_nac_alu), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(trim(fec_nac_alu), '%Y-%m-%d')
            WHEN regexp_full_match(trim(fec_nac_alu), '\\d{{8}}') THEN try_strptime(trim(fec_nac_alu), '%Y%m%d') END AS DATE)::VARCHAR) AS fec_nac
FROM raw JOIN schools s ON s.rbd = lpad(regexp_replace(trim(raw.rbd), '[^0-9]', '', 'g'), 8, '0')
WHERE regexp_full_match(trim(mrun), '\\d+') AND regexp_full_match(trim(raw.rbd), '\\d+') AND regexp_full_match(trim(agno), '\\d{{4}}')
  AND regexp_full_match(trim(cod_grado), '\\d+')
GROUP BY ALL""")
def enrolment_expr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty enrolment rows: filtered by pattern, coerced, joined to schools on a derived key, one row per key."""
    return enrolments(spark, sf_dir).groupBy("mrun", "rbd", "agno", "cod_grado").agg(F.max("let_cur").alias("let_cur"), F.count("*").alias("n_filas"), F.max("fec_nac").alias("fec_nac"))


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolment rows that are good, of known schools: mrun, rbd, agno, cod_grado, let_cur, fec_nac, and the order they come from (o_orderkey, o_orderstatus)."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = table(spark, sf_dir, "orders").select(
        F.when(k % 11 == 0, " x1 ").otherwise(F.concat(F.lit(" "), F.col("o_custkey"), F.lit(" "))).alias("mrun"), F.concat(F.lit(" "), k % 150, F.lit(" ")).alias("rbd"),
        F.when(k % 13 == 0, "19").otherwise(F.concat(F.lit(" "), F.year(day))).alias("agno"), F.concat(k % 7 + 1, F.lit(" ")).alias("cod_grado"),
        F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy-MM")).alias("fec_nac_alu"),
        F.when(k % 5 == 0, "").otherwise(F.substring("o_orderpriority", 1, 1)).alias("let_cur"), k, "o_orderstatus")
    t = {c: F.trim(c) for c in raw.columns[:6]}
    good = raw.filter(t["mrun"].rlike(r"^\d+$") & t["rbd"].rlike(r"^\d+$") & t["agno"].rlike(r"^\d{4}$") & t["cod_grado"].rlike(r"^\d+$"))
    born = F.when(t["fec_nac_alu"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t["fec_nac_alu"], "yyyy-MM-dd")).when(t["fec_nac_alu"].rlike(r"^\d{8}$"), F.try_to_date(t["fec_nac_alu"], "yyyyMMdd"))
    rows = good.select(t["mrun"].try_cast("bigint").alias("mrun"), F.lpad(F.regexp_replace(t["rbd"], "[^0-9]", ""), 8, "0").alias("rbd"), t["agno"].try_cast("int").alias("agno"),
                       t["cod_grado"].try_cast("int").alias("cod_grado"), F.nullif(t["let_cur"], F.lit("")).alias("let_cur"), born.cast("string").alias("fec_nac"), "o_orderkey", "o_orderstatus")
    return rows.join(schools(spark, sf_dir).select("rbd"), "rbd", "left_semi")
