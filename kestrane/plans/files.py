"""Queries over files and stored tables: each writes its inputs to the shared folder and reads them back as a load would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import fallback
from ..functions.labels import SUBJECTS
from ..operators.quality import row_count_level
from ..scratch import shared_path
from ..sources import csv_files, ledger, sheets
from ..sources.tables import append_write, delete_rows, merge_write
from ..tables import table
from .registry import query

# Delimited files ----------------------------------------------------------------------------


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS nombre, CAST(s_nationkey AS VARCHAR) AS pais, '' AS segmento, '2019' AS agno FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name || ' de Ñuñoa', CAST(c_nationkey AS VARCHAR), c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '2021' ELSE '2020' END FROM customer
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name || ', “' || p_brand || '”', '', '', '2018' FROM part""")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with three headers, encodings and separators as one table: sniffed, aligned by alias, years from cells or folders."""
    root = shared_path(spark, "csv")
    s, c, p = (table(spark, sf_dir, t) for t in ("supplier", "customer", "part"))
    s.select(F.col("s_suppkey").alias("S SUPPKEY"), F.col("s_name").alias("Nombre"), F.col("s_nationkey").alias("PAIS")).write.csv(f"{root}/2019", sep=";", header=True)
    c = c.select(F.col("c_custkey").alias("ID"), F.concat("c_name", F.lit(" de Ñuñoa")).alias("nom-cliente"), F.col("c_nationkey").alias("pais"), F.col("c_mktsegment").alias("SEGMENTO"),
                 F.when(F.col("c_custkey") % 2 == 0, "2021").otherwise("2020").alias("agno"))
    c.write.csv(f"{root}/clientes", sep="|", header=True, encoding="ISO-8859-1")
    p.select(F.col("p_partkey").alias("id"), F.translate(F.concat("p_name", F.lit(", “"), "p_brand", F.lit("”")), *reversed(csv_files.SIGNS)).alias("nombre")) \
        .write.csv(f"{root}/2018", sep=",", header=True, encoding="ISO-8859-1")  # the bytes of Windows-1252
    aliases = {"s_suppkey": "id", "nom_cliente": "nombre"}
    return csv_files.read_folder(spark, root, priority=["id", "nombre"], aliases=aliases).drop("_source_file")


@query("""SELECT 'AB' || id AS id, nullif(trim(v), '') AS v, nullif(trim(w), '') AS w FROM (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN ' x ' || c_name ELSE '' END AS v, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END AS w FROM customer)
WHERE NOT (nullif(trim(v), '') IS NULL AND nullif(trim(w), '') IS NULL)""")
def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of white space are null, and rows without any other cell than their key are dropped."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" x "), "c_name")).otherwise("").alias("v"),
                                                  F.when(k % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("w"))
    rows = csv_files.blank_to_null(raw).select(F.struct("id").alias("key"), "v", "w").dropna("all", subset=["v", "w"])
    return rows.select(F.concat(F.lit("AB"), "key.id").alias("id"), "v", "w")


@query("""SELECT c_custkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'sin dato') AS valor FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_name END AS a, CASE WHEN c_custkey % 5 <> 0 THEN ' ' || c_mktsegment ELSE '' END AS b FROM customer)""")
def fallback_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column with text; empty cells count as missing."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("c_name")).alias("a"), F.when(k % 5 != 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("").alias("b"))
    return rows.select("c_custkey", fallback(F.col("a"), F.col("b"), F.lit("sin dato")).alias("valor"))


@query("""SELECT sha256(content) AS sha256, length(content) AS length FROM (
  SELECT 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',"' || r_name || '"' || chr(10), '' ORDER BY r_regionkey) AS content FROM region
  UNION ALL SELECT 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',"' || n_name || '"' || chr(10), '' ORDER BY n_nationkey) FROM nation)""")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of each file, one of them hashed as a stream."""
    out = shared_path(spark, "hashed")
    for t, (key, name) in {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name")}.items():
        lines = table(spark, sf_dir, t).select(key, F.concat(F.col(key), F.lit(',"'), F.col(name), F.lit('"')).alias("value"))
        head = spark.range(1).select(F.lit(-1).alias(key), F.lit(f"{key},{name}").alias("value"))
        head.unionByName(lines).coalesce(1).sortWithinPartitions(key).select("value").write.text(f"{out}/{t}")  # fixed tables
    return ledger.hashed_files(spark, out, "*.txt", whole=200).select("sha256", "length")


@query("SELECT CASE WHEN count(*) = 0 THEN 'CRITICAL' WHEN count(*) < 1000 THEN 'WARNING' ELSE 'INFO' END AS level, 'ROW_COUNT' AS code, count(*) AS n FROM customer")
def row_count_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count_level(table(spark, sf_dir, "customer"))


# Record sheets ------------------------------------------------------------------------------

_SHEET = "lpad(CAST(o_custkey AS VARCHAR), 8, '0')"


@query(f"""SELECT {_SHEET} AS rbd, CAST(year(o_orderdate) AS INTEGER) AS agno, CAST(o_orderkey % 8 + 1 AS VARCHAR) AS grado, 'B' AS letra, l_linenumber AS n_orden, 'P' || l_partkey AS nombre,
       (round(1 + l_discount * 50, 1) + 0e0) AS nota_1, CASE WHEN l_linenumber % 2 = 0 THEN (round(2 + l_tax * 50, 1) + 0e0) END AS nota_2, CAST(l_quantity AS INTEGER) AS asistencia_pct, l_linestatus AS situacion_final
FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)
JOIN orders ON l_orderkey = o_orderkey""")
def sheet_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pupils' marks from the tables of record sheets: a sheet per order, a pupil per line number."""
    one = F.min_by(F.struct("l_partkey", "l_discount", "l_tax", "l_quantity", "l_linestatus"), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("x")
    pupils = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(one).select("l_orderkey", "l_linenumber", "x.*")
    lines = pupils.groupBy("l_orderkey").agg(F.collect_list(F.struct(*pupils.columns[1:])).alias("lines"))  # a sheet has as many rows as line numbers
    shown = lambda c: F.format_string("%.1f", F.round(c, 1))
    blank = F.lit("")

    def cells(x: Column) -> Column:
        marks = [shown(1 + x["l_discount"] * 50), F.when(x["l_linenumber"] % 2 == 0, F.replace(shown(2 + x["l_tax"] * 50), F.lit("."), F.lit(","))).otherwise("-")]
        return F.array(x["l_linenumber"].cast("string"), F.concat(F.lit("P"), x["l_partkey"]), blank, blank, blank, *marks, *[blank] * (sheets.SLOTS - 2), blank, blank,
                       x["l_quantity"].cast("int").cast("string"), x["l_linestatus"], blank)

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    name = F.concat_ws("_", "o_custkey", F.concat(F.lit("c"), "o_orderkey"), F.col("o_orderkey") % 8 + 1, F.lit("b"), F.date_format("o_orderdate", "ddMMyyyy"), F.lit("120000.pdf"))
    head = F.array(F.array(F.lit("Nº"), F.lit("Nombre")), F.array(F.lit(""), F.lit("")))
    files = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(name.alias("file"), F.concat(head, F.transform("lines", cells)).alias("grid"))
    got = sheets.marks_of(files.withColumn("table_no", F.lit(1)), "without_municipality")
    return got.select("rbd", "agno", "grado", "letra", "n_orden", "nombre", "nota_1", "nota_2", "asistencia_pct", "situacion_final")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SUBJECTS.items()) + ") t(asignatura, nombre)")
def dim_subject_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded dimension of the five subjects."""
    return spark.createDataFrame(list(SUBJECTS.items()), "asignatura string, nombre string")


# Stored tables ------------------------------------------------------------------------------

@query("""SELECT o_custkey AS id, o_orderstatus AS estado, (round(o_totalprice + 1e-7, 2) + 0e0) AS total FROM (
  SELECT *, o_orderkey % 2 AS file FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY file DESC, o_orderdate DESC, o_orderkey DESC) = 1""")
def merge_write_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged into a stored table, one after the other; in a batch the last row of a key wins."""
    path, o = shared_path(spark, "merged"), table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("estado"), F.col("o_totalprice").alias("total"), "o_orderdate", "o_orderkey")
    out = None
    for batch in (0, 1):
        out = merge_write(rows.filter(F.col("o_orderkey") % 2 == batch), path, ["id"], ["o_orderdate", "o_orderkey"])
    return out.select("id", "estado", (F.round(F.col("total") + 1e-7, 2) + F.lit(0.0)).alias("total"))


@query("""SELECT c_custkey AS id, c_mktsegment AS segmento FROM customer WHERE NOT coalesce(c_nationkey = 3, false)
UNION ALL SELECT s_suppkey, NULL FROM supplier""")
def append_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended to a stored table, from which rows are then removed by a condition."""
    path = shared_path(spark, "appended")
    schema = ("id", "segmento", "pais")
    append_write(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").toDF(*schema), path)
    append_write(table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string"), F.lit(None).cast("int")).toDF(*schema), path)
    return delete_rows(spark, path, "pais = 3").select("id", "segmento")
