"""Cleaning of dirty text, file names and incremental batches, and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.quality import column_profile as profile_of
from ..operators.quality import value_counters
from ..tables import table
from .model import CTE_SCHOOLS, rnd, schools
from .registry import query

_KEY = "CAST(p_partkey AS VARCHAR)"
_DIRTY_NUMBER = f"""CASE p_partkey % 9 WHEN 0 THEN ' ' || {_KEY} || ',5 ' WHEN 1 THEN {_KEY} || '.25' WHEN 2 THEN '1.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',75'
  WHEN 3 THEN '' WHEN 4 THEN 'nan' WHEN 5 THEN ' None' WHEN 6 THEN {_KEY} || 'x' WHEN 7 THEN '-' ELSE '  ' || {_KEY} || '  ' END"""


def _dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = (
        F.when(k % 9 == 0, F.concat(F.lit(" "), k, F.lit(",5 "))).when(k % 9 == 1, F.concat(k, F.lit(".25")))
        .when(k % 9 == 2, F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",75"))).when(k % 9 == 3, "").when(k % 9 == 4, "nan").when(k % 9 == 5, " None")
        .when(k % 9 == 6, F.concat(k, F.lit("x"))).when(k % 9 == 7, "-").otherwise(F.concat(F.lit("  "), k, F.lit("  "))))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query(f"""WITH d AS (SELECT p_partkey, {_DIRTY_NUMBER} AS raw FROM part),
t AS (SELECT p_partkey, CASE WHEN trim(raw) NOT IN ('', 'nan', 'None', 'NaN') THEN trim(raw) END AS s FROM d)
SELECT p_partkey, s AS texto, TRY_CAST(CASE WHEN length(replace(s, ',', '.')) - length(replace(replace(s, ',', '.'), '.', '')) > 1
         THEN replace(left(replace(s, ',', '.'), length(s) - instr(reverse(replace(s, ',', '.')), '.')), '.', '') || '.' || right(s, instr(reverse(replace(s, ',', '.')), '.') - 1)
         ELSE replace(s, ',', '.') END AS DOUBLE) AS numero,
       CAST(trunc(TRY_CAST(s AS DOUBLE)) AS INTEGER) AS entero, TRY_CAST(replace(CASE WHEN s <> '-' THEN s END, ',', '.') AS DOUBLE) AS nota
FROM t""")
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _dirty_numbers(spark, sf_dir).select("p_partkey", clean.clean_str(raw).alias("texto"), clean.to_float(raw).alias("numero"), clean.to_int(raw).alias("entero"), clean.mark(raw).alias("nota"))


_DIRTY_DATE = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m')
  WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') || '.0' WHEN 4 THEN '' WHEN 5 THEN '20011345' ELSE 'no date' END"""


@query(f"""WITH d AS (SELECT o_orderkey, {_DIRTY_DATE} AS raw FROM orders)
SELECT o_orderkey, CAST(CAST(CASE WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(raw, '%Y-%m-%d')
         WHEN regexp_full_match(raw, '\\d{{8}}') THEN try_strptime(raw, '%Y%m%d') WHEN regexp_full_match(raw, '\\d{{6}}') THEN try_strptime(raw || '01', '%Y%m%d') END AS DATE) AS VARCHAR) AS fecha,
       regexp_replace(regexp_replace(raw, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3'), '^(\\d{{4}})(\\d{{2}})$', '\\1-\\2') AS nacimiento,
       regexp_replace(regexp_replace(split_part(raw, '.', 1), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3'), '^(\\d{{4}})(\\d{{2}})$', '\\1-\\2') AS nacimiento_docente
FROM d""")
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(k % 7 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 7 == 1, F.date_format(day, "yyyyMMdd")).when(k % 7 == 2, F.date_format(day, "yyyyMM"))
        .when(k % 7 == 3, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0"))).when(k % 7 == 4, "").when(k % 7 == 5, "20011345").otherwise("no date"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return d.select("o_orderkey", clean.to_date(F.col("raw")).cast("string").alias("fecha"), clean.birth_date(F.col("raw")).alias("nacimiento"), clean.birth_date(F.col("raw"), True).alias("nacimiento_docente"))


_CK = "CAST(c_custkey AS VARCHAR)"


@query(f"""WITH d AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'RBD ' || {_CK} WHEN 1 THEN {_CK} || '-K' WHEN 2 THEN 'none' ELSE '00' || {_CK} || '123456789' END AS rbd,
  CASE c_custkey % 3 WHEN 0 THEN '1.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.000-7' WHEN 1 THEN {_CK} ELSE 'x-1' END AS run,
  CASE c_custkey % 5 WHEN 0 THEN '4B' WHEN 1 THEN ' 2m ' WHEN 2 THEN '7' WHEN 3 THEN 'zz' END AS grado FROM customer)
SELECT c_custkey, CASE WHEN regexp_replace(rbd, '[^0-9]', '', 'g') <> '' THEN lpad(regexp_replace(rbd, '[^0-9]', '', 'g'), CAST(greatest(8, length(regexp_replace(rbd, '[^0-9]', '', 'g'))) AS INTEGER), '0') END AS rbd,
       TRY_CAST(split_part(replace(run, '.', ''), '-', 1) AS BIGINT) AS run,
       CASE lower(trim(grado)) WHEN '2b' THEN 2 WHEN '4b' THEN 4 WHEN '6b' THEN 6 WHEN '8b' THEN 8 WHEN '2m' THEN 10 WHEN '4m' THEN 12 ELSE TRY_CAST(trim(grado) AS INTEGER) END AS grado
FROM d""")
def clean_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rbd = F.when(k % 4 == 0, F.concat(F.lit("RBD "), k)).when(k % 4 == 1, F.concat(k, F.lit("-K"))).when(k % 4 == 2, "none").otherwise(F.concat(F.lit("00"), k, F.lit("123456789")))
    run = F.when(k % 3 == 0, F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".000-7"))).when(k % 3 == 1, k.cast("string")).otherwise("x-1")
    grade = F.when(k % 5 == 0, "4B").when(k % 5 == 1, " 2m ").when(k % 5 == 2, "7").when(k % 5 == 3, "zz")
    return table(spark, sf_dir, "customer").select("c_custkey", clean.norm_rbd(rbd).alias("rbd"), clean.parse_run(run).alias("run"), clean.parse_grade(grade).alias("grado"))


@query(f"""WITH {CTE_SCHOOLS}, d AS (
  SELECT rbd, CAST(rbd AS BIGINT) AS k, CAST(rbd AS BIGINT) || '_110_' || (CAST(rbd AS BIGINT) % 8 + 1) || 'B_A_0' || (CAST(rbd AS BIGINT) % 9 + 1) || '03' || (2000 + CAST(rbd AS BIGINT) % 25) || '_101500.pdf' AS hoja,
         'simce' || (2010 + CAST(rbd AS BIGINT) % 20) || CASE CAST(rbd AS BIGINT) % 5 WHEN 0 THEN '_rbd_' WHEN 1 THEN '_comuna_' WHEN 2 THEN '_DEPROV_' WHEN 3 THEN '_region_' ELSE '_x_' END || 'final.csv' AS archivo FROM schools)
SELECT rbd, CAST(2010 + k % 20 AS INTEGER) AS agno, CASE k % 5 WHEN 0 THEN 'rbd' WHEN 1 THEN 'comuna' WHEN 2 THEN 'deprov' WHEN 3 THEN 'region' END AS granularidad,
       lpad(split_part(hoja, '_', 1), 8, '0') AS hoja_rbd, split_part(hoja, '_', 2) AS codigo, split_part(hoja, '_', 3) AS grado, split_part(hoja, '_', 4) AS letra,
       CAST(CAST(try_strptime(split_part(hoja, '_', 5), '%d%m%Y') AS DATE) AS VARCHAR) AS fecha, '101500' AS hora
FROM d""")
def file_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("rbd").cast("bigint")
    kind = F.when(k % 5 == 0, "_rbd_").when(k % 5 == 1, "_comuna_").when(k % 5 == 2, "_DEPROV_").when(k % 5 == 3, "_region_").otherwise("_x_")
    d = schools(spark, sf_dir).select("rbd", F.concat(k, F.lit("_110_"), k % 8 + 1, F.lit("B_A_0"), k % 9 + 1, F.lit("03"), k % 25 + 2000, F.lit("_101500.pdf")).alias("hoja"), F.concat(F.lit("simce"), k % 20 + 2010, kind, F.lit("final.csv")).alias("archivo"))
    f = clean.sheet_fields(F.col("hoja"))
    return d.select("rbd", clean.year_in_name(F.col("archivo"), F.lit("")).alias("agno"), clean.granularity(F.col("archivo")).alias("granularidad"), f["rbd"].alias("hoja_rbd"), f["codigo"].alias("codigo"), f["grado"].alias("grado"), f["letra"].alias("letra"), f["fecha"].cast("string").alias("fecha"), f["hora"].alias("hora"))


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 180 - 90 AS VARCHAR) || ',5' WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 300 - 150 AS VARCHAR) || '.25' ELSE '1,2,3' END AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(raw, '-?\\d+,\\d+') THEN replace(raw, ',', '.') ELSE raw END AS texto,
       CASE WHEN TRY_CAST(replace(raw, ',', '.') AS DOUBLE) BETWEEN -90 AND 90 THEN TRY_CAST(replace(raw, ',', '.') AS DOUBLE) END AS latitud FROM d""")
def geo_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates outside their bounds become null; the row stays."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(k % 180 - 90, F.lit(",5"))).when(k % 3 == 1, F.concat(k % 300 - 150, F.lit(".25"))).otherwise("1,2,3")
    text = clean.lat_lon(F.col("raw"))
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", text.alias("texto"), clean.bounded(text.try_cast("double"), -90, 90).alias("latitud"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(2000 + p_partkey % 20 AS INTEGER) END AS agno FROM part""")
def year_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest plausible year in a text."""
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("acta 1999 y "), k % 20 + 2000, F.lit(" o 2000, folio 9999"))).otherwise("folio 0042")
    return table(spark, sf_dir, "part").select("p_partkey", clean.last_year_in_text(text).alias("agno"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, CASE WHEN l_discount > 0.05 THEN l_discount END, l_quantity) AS puntaje FROM lineitem""")
def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several source columns of one meaning: the first that has a value, in their order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    first = F.coalesce(F.when(F.col("l_tax") > 0.02, F.col("l_tax")), F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.col("l_quantity"))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", first.alias("puntaje"))


# Incremental --------------------------------------------------------------------------------


@query("""WITH days AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, count(*) AS n FROM events GROUP BY ALL),
ledger AS (SELECT dia FROM days WHERE hash_ok(dia))
SELECT dia, n FROM days WHERE dia NOT IN (SELECT dia FROM ledger)""".replace("hash_ok(dia)", "CAST(right(dia, 2) AS INTEGER) % 3 = 0"))
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose content the ledger does not hold as loaded; failed ones come again."""
    from ..sources.ledger import pending

    batches = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("dia")).agg(F.count("*").alias("n")).withColumn("sha256", F.sha2(F.concat_ws("|", "dia", "n"), 256))
    day = F.substring("dia", -2, 2).cast("int")
    ledger = batches.select("sha256", F.when(day % 3 == 0, "ok").otherwise("error").alias("status"))
    return pending(batches, ledger).drop("sha256")


@query("""SELECT event_type, count(*) AS leidas, count(*) FILTER (WHERE value >= 0) AS insertadas, count(*) FILTER (WHERE value IS NULL OR value < 0) AS omitidas FROM events GROUP BY event_type""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, taken and skipped, in one aggregation."""
    good = F.coalesce(F.col("value") >= 0, F.lit(False))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("leidas"), F.count_if(good).alias("insertadas"), F.count_if(~good).alias("omitidas"))


@query("SELECT event_type, string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) AS fuentes FROM events GROUP BY event_type")
def source_file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sources of each kind: pairs are made distinct before they are gathered."""
    d = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("f")).distinct()
    return d.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("fuentes"))


@query("""SELECT p_partkey, to_json(struct_pack(p_name := p_name, p_brand := p_brand, p_size := p_size)) AS fila FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def top_n_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest parts as JSON rows: a top-k report."""
    p = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)
    return p.select("p_partkey", F.to_json(F.struct("p_name", "p_brand", "p_size")).alias("fila"))


@query("""SELECT user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a property of their JSON text."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS desde, event_type, count(*) AS n, (round(sum(value) + 1e-7, 3) + 0e0) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind: the batch form of the streaming aggregation."""
    from ..streaming.events import hourly

    return hourly(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("desde"), "event_type", "n", rnd("total", 3).alias("total"))


# Quality ------------------------------------------------------------------------------------


def _dirty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 17 == 0, "1889").when(k % 19 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("agno"),
        F.when(k % 23 == 0, "x").otherwise(k.cast("string")).alias("mrun"), F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("fec_nac_alu"),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("f"), F.year("o_orderdate"), F.lit(".csv"))).alias("_source_file"))


_DIRTY_TABLE = """dirty AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '1889' WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS agno,
  CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS mrun,
  CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m') END AS fec_nac_alu,
  CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'f' || year(o_orderdate) || '.csv' END AS _source_file FROM orders)"""


@query(f"""WITH {_DIRTY_TABLE}, c AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE TRY_CAST(nullif(agno, '') AS DOUBLE) IS NULL OR TRY_CAST(nullif(agno, '') AS DOUBLE) NOT BETWEEN 1990 AND 2030) AS a,
  count(*) FILTER (WHERE agno <> '' AND TRY_CAST(agno AS DOUBLE) IS NULL) AS na, count(*) FILTER (WHERE mrun <> '' AND TRY_CAST(mrun AS DOUBLE) IS NULL) AS nm,
  count(*) FILTER (WHERE fec_nac_alu <> '' AND NOT regexp_full_match(fec_nac_alu, '\\d{{4}}-\\d{{2}}(-\\d{{2}})?')) AS d,
  count(*) FILTER (WHERE agno = '') AS ea, count(*) FILTER (WHERE _source_file = '') AS es FROM dirty),
l AS (SELECT total, unnest([{{'code': 'AGNO_OUT_OF_RANGE', 'n': a}}, {{'code': 'NUMERIC_BAD_AGNO', 'n': na}}, {{'code': 'NUMERIC_BAD_MRUN', 'n': nm}},
  {{'code': 'DATE_BAD_FEC_NAC_ALU', 'n': d}}, {{'code': 'NULL_MANDATORY_AGNO', 'n': ea}}, {{'code': 'NULL_MANDATORY__SOURCE_FILE', 'n': es}}]) AS x FROM c)
SELECT CASE WHEN x.code = 'AGNO_OUT_OF_RANGE' THEN 'CRITICAL' WHEN x.code LIKE 'NUMERIC%' AND x.n > 0.05 * total THEN 'CRITICAL'
       WHEN x.code LIKE 'NULL%' AND x.n > 0.1 * total THEN 'CRITICAL' ELSE 'WARNING' END AS level, x.code AS code, x.n AS n, (round(100e0 * x.n / total + 1e-7, 4) + 0e0) AS pct FROM l WHERE x.n > 0""")
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counters(_dirty_table(spark, sf_dir), numeric=["agno", "mrun"], dates=["fec_nac_alu"], mandatory=["agno", "_source_file"])


@query(f"""WITH {_DIRTY_TABLE}, l AS (SELECT unnest(['agno', 'mrun', 'fec_nac_alu', '_source_file']) AS col, unnest([nullif(agno, ''), nullif(mrun, ''), nullif(fec_nac_alu, ''), nullif(_source_file, '')]) AS v FROM dirty)
SELECT col, CASE WHEN count(v) = 0 THEN 'empty' WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) THEN 'numeric'
       WHEN count(CASE WHEN regexp_full_match(v, '\\d{{4}}-\\d{{2}}(-\\d{{2}})?') THEN 1 END) = count(v) THEN 'date' ELSE 'string' END AS type,
       count(*) - count(v) AS nulls, (round(100e0 * (count(*) - count(v)) / count(*) + 1e-7, 1) + 0e0) AS null_pct, count(DISTINCT v) AS cardinality, min(v) AS least, max(v) AS greatest,
       array_to_string(list_sort(list(DISTINCT v))[1:3], '|') AS samples
FROM l GROUP BY col""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_of(_dirty_table(spark, sf_dir))
