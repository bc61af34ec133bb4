"""Queries over loads: batches merged into partitions, chunks written once, numbers, counters, samples and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import nan_to_null, safe_file_name, to_int
from ..functions.rounding import half_even
from ..operators.merge import insert_ignore, merge_coalesce
from ..operators.numbering import number_new, numbered
from ..operators.quality import sampled_counters
from ..scratch import shared_path
from ..sources import commits, csv_files, ledger
from ..sources.tables import merge_partitions, merge_write
from ..streaming.events import EVENTS, merge_batches, read_events
from ..tables import table
from .ingest import _DIRTY_TABLE, _dirty_table
from .model import CTE_SCHOOLS, cents, rbd_of, rnd
from .registry import query
from .relational import _ENROL_RAW, enrolments

#: The enrolment facts in SQL, as `relational.enrolments` gives them; later orders come later in a batch.
_ENROLLED = f"""{CTE_SCHOOLS}, {_ENROL_RAW.replace("AS let_cur", "AS let_cur, o_orderkey, o_orderstatus")},
enrolled AS (
  SELECT CAST(trim(mrun) AS BIGINT) AS mrun, s.rbd, CAST(trim(agno) AS INTEGER) AS agno, CAST(trim(cod_grado) AS INTEGER) AS cod_grado, nullif(trim(let_cur), '') AS let_cur,
         CAST(CAST(CASE WHEN regexp_full_match(trim(fec_nac_alu), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime(trim(fec_nac_alu), '%Y-%m-%d')
              WHEN regexp_full_match(trim(fec_nac_alu), '\\d{{8}}') THEN try_strptime(trim(fec_nac_alu), '%Y%m%d') END AS DATE) AS VARCHAR) AS fec_nac, o_orderkey, o_orderstatus = 'P' AS late
  FROM raw JOIN schools s ON s.rbd = lpad(regexp_replace(trim(raw.rbd), '[^0-9]', '', 'g'), 8, '0')
  WHERE regexp_full_match(trim(mrun), '\\d+') AND regexp_full_match(trim(raw.rbd), '\\d+') AND regexp_full_match(trim(agno), '\\d{{4}}') AND regexp_full_match(trim(cod_grado), '\\d+'))"""


def enrolment_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The enrolment rows as two batches: orders that are settled, then those that are pending, which fall into few years."""
    rows = enrolments(spark, sf_dir)
    return [rows.filter(c).drop("o_orderstatus") for c in ("o_orderstatus <> 'P' OR o_orderstatus IS NULL", "o_orderstatus = 'P'")]


@query(f"""WITH {_ENROLLED}
SELECT mrun, rbd, agno, cod_grado, let_cur FROM enrolled QUALIFY row_number() OVER (PARTITION BY mrun, rbd, agno, cod_grado ORDER BY late DESC, o_orderkey DESC) = 1""")
def enrolment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolments upserted into a table that is stored by year: the second batch replaces the partitions of its years only."""
    path, keys, out = shared_path(spark, "matricula"), ["mrun", "rbd", "agno", "cod_grado"], None
    for batch in enrolment_batches(spark, sf_dir):
        out = merge_partitions(batch.select(*keys, "let_cur", "o_orderkey"), path, keys, ["agno"], ["o_orderkey"])
    return out.select(*keys, "let_cur")


@query(f"""WITH {_ENROLLED}
SELECT mrun, max_by(fec_nac, (late, o_orderkey)) FILTER (WHERE fec_nac IS NOT NULL) AS fec_nac FROM enrolled GROUP BY mrun""")
def pupil_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension of pupils, by two batches: a date that is known stays where a batch has none."""
    path, out = shared_path(spark, "alumnos"), None
    for batch in enrolment_batches(spark, sf_dir):
        out = merge_write(batch.select("mrun", "fec_nac", "o_orderkey"), path, ["mrun"], ["o_orderkey"], merge_coalesce)
    return out.select("mrun", "fec_nac")


@query("SELECT event_id, user_id, event_type, value FROM events")
def exactly_once_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files streamed into a table chunk by chunk, and streamed again without the stream's own checkpoint: the log of commits skips what is there."""
    files, path = shared_path(spark, "event-files"), shared_path(spark, "chunks")
    table(spark, sf_dir, "events").repartitionByRange(3, "event_id").write.parquet(files)
    for _ in range(2):
        stream = read_events(spark, files, 1)
        merge_batches(stream, commits.once(path, "events"), shared_path(spark, "stream")).awaitTermination()
    return commits.read_committed(spark, path, EVENTS).select("event_id", "user_id", "event_type", "value")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS mrun FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS mrun FROM orders WHERE o_custkey NOT IN (SELECT mrun FROM a))
SELECT mrun, row_number() OVER (ORDER BY mrun) AS alumno_id FROM a UNION ALL SELECT mrun, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY mrun) FROM b""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pupils numbered without gaps; those of the second batch go on after the first one's, whose numbers stay."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mrun"), "o_orderstatus")
    return number_new(numbered(o.filter("o_orderstatus = 'F'"), ["mrun"], "alumno_id"), o, ["mrun"], "alumno_id")


#: Rows of the sample in the query.
SAMPLED = 500
_HASH = "md5(concat_ws('|', agno, mrun, fec_nac_alu, _source_file))"


@query(f"""WITH {_DIRTY_TABLE}, s AS (SELECT * FROM dirty ORDER BY {_HASH} LIMIT {SAMPLED}), t AS (SELECT count(*) AS total FROM dirty), c AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE TRY_CAST(nullif(agno, '') AS DOUBLE) IS NULL OR TRY_CAST(nullif(agno, '') AS DOUBLE) NOT BETWEEN 1990 AND 2030) AS a, count(*) FILTER (WHERE mrun <> '' AND TRY_CAST(mrun AS DOUBLE) IS NULL) AS m,
  count(*) FILTER (WHERE _source_file = '') AS f FROM s)
SELECT 'INFO' AS level, 'SAMPLE' AS code, n, round(100e0 * n / total, 4) AS pct FROM c, t
UNION ALL SELECT 'CRITICAL', 'AGNO_OUT_OF_RANGE', a, round(100e0 * a / n, 4) FROM c WHERE a > 0
UNION ALL SELECT CASE WHEN m > 0.05 * n THEN 'CRITICAL' ELSE 'WARNING' END, 'NUMERIC_BAD_MRUN', m, round(100e0 * m / n, 4) FROM c WHERE m > 0
UNION ALL SELECT CASE WHEN f > 0.1 * n THEN 'CRITICAL' ELSE 'WARNING' END, 'NULL_MANDATORY__SOURCE_FILE', f, round(100e0 * f / n, 4) FROM c WHERE f > 0""")
def sampled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality report over a bounded sample, the rows with the least hashes, which states the sample."""
    return sampled_counters(_dirty_table(spark, sf_dir), SAMPLED, numeric=["mrun"], mandatory=["_source_file"])


@query("""SELECT source, 'ok' AS status, leidas, insertadas, leidas - insertadas AS omitidas FROM (
  SELECT 'events' AS source, count(*) AS leidas, count(*) FILTER (WHERE value >= 0) AS insertadas FROM events UNION ALL
  SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_discount > 0.02) FROM lineitem UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders)""")
def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, inserted and skipped of three loads, counted by the writes themselves."""
    path = shared_path(spark, "loads")
    for name, good in {"events": "value >= 0", "lineitem": "l_discount > 0.02", "orders": "o_orderstatus <> 'P'"}.items():
        commits.write_counted(table(spark, sf_dir, name), F.expr(good), lambda df, name=name: df.write.parquet(f"{path}/{name}"), f"{path}/ledger", name)
    return commits.loads(spark, f"{path}/ledger").drop("message")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x, CAST(printf('%.2f', x) AS DOUBLE) + 0e0 AS par, CAST(printf('%.0f', x) AS DOUBLE) + 0e0 AS entero, (round(x + 1e-7, 2) + 0e0) AS arriba
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 8 ELSE l_extendedprice / 1000e0 - 10 END AS x FROM lineitem)""")
def half_even_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded half-even by their exact binary value, beside the half-up rounding: eighths are ties."""
    x = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 8).otherwise(F.col("l_extendedprice") / 1000e0 - 10)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"))
    return rows.withColumns({"par": half_even(F.col("x"), 2), "entero": half_even(F.col("x"), 0), "arriba": F.round(F.col("x") + 1e-7, 2) + F.lit(0.0)})


@query("""SELECT CASE WHEN k % 7 = 0 THEN 'rechazada' ELSE 'leida' END AS destino, CASE WHEN k % 7 = 0 THEN '4 cells, 3 columns' END AS motivo,
  CASE WHEN k % 7 = 0 THEN k || ';' || c_name || ';x;y' END AS fila, CASE WHEN k % 7 <> 0 THEN CAST(k AS VARCHAR) END AS id, CASE WHEN k % 7 <> 0 THEN c_name END AS nombre
FROM (SELECT c_custkey AS k, c_name FROM customer)""")
def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of delimited files, those that were read and those that were left out, with the reason: together all lines."""
    root, k = shared_path(spark, "csv-long"), F.col("c_custkey")
    tail = F.when(k % 7 == 0, ";x;y").when(k % 7 == 1, "").otherwise(";z")
    lines = table(spark, sf_dir, "customer").repartition(4, "c_custkey").select(F.concat(k, F.lit(";"), "c_name", tail).alias("value"))
    heads = spark.range(0, 4, 1, 4).select(F.lit("id;nombre;otro").alias("value"))
    parts = heads.select(F.spark_partition_id().alias("p"), F.lit(0).alias("place"), "value").unionAll(lines.select(F.spark_partition_id().alias("p"), F.lit(1).alias("place"), "value"))
    parts.repartition("p").sortWithinPartitions("p", "place").select("p", "value").write.partitionBy("p").text(f"{root}/in")
    read, rejected = csv_files.load_folder(spark, f"{root}/in", f"{root}/out", pattern="*.txt", mandatory=())
    none = F.lit(None).cast("string")
    return read.select(F.lit("leida").alias("destino"), none.alias("motivo"), none.alias("fila"), "id", "nombre").unionAll(
        rejected.select(F.lit("rechazada"), "_motivo", "_fila", none, none))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS pasada, CAST(year(o_orderdate) AS VARCHAR) AS agno FROM orders")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files normalised and then loaded by their content: a second run, over more files, takes up the new ones alone."""
    root, o = shared_path(spark, "manifest"), table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("agno"), (F.coalesce("o_orderstatus", F.lit("")) == "P").alias("late"))
    for run, late in enumerate((False, True), 1):
        lines.filter(F.col("late") == late).select("id", "agno").repartitionByRange(3, "id").write.mode("append").csv(f"{root}/in", header=True, sep=";")
        ledger.normalise_pending(spark, f"{root}/in", f"{root}/ledger", f"{root}/normalised", lambda paths: csv_files.read_folder(spark, f"{root}/in", only=set(paths)))
        ledger.load_normalised(spark, f"{root}/ledger", f"{root}/normalised", f"{root}/loaded", lambda df, run=run: df.withColumn("pasada", F.lit(run)))
    return spark.read.parquet(f"{root}/loaded").select("id", "pasada", "agno")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS nombre, CAST(c_nationkey AS VARCHAR) AS col_2, coalesce(c_mktsegment, '') AS nombre__2, '' AS sin_dato FROM customer")
def csv_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers have blank and repeated names, with a column transformed, written again in a fixed order of columns."""
    root = shared_path(spark, "csv-aligned")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = c.select(F.concat_ws(";", "c_custkey", "c_name", "c_nationkey", F.coalesce("c_mktsegment", F.lit(""))).alias("value"), F.lit(1).alias("place"), F.pmod("c_custkey", F.lit(3)).alias("p"))
    heads = spark.range(3).select(F.lit("ID;Nombre;;nombre").alias("value"), F.lit(0).alias("place"), F.col("id").alias("p"))
    rows.unionByName(heads).repartition("p").sortWithinPartitions("p", "place").select("p", "value").write.partitionBy("p").text(f"{root}/in")
    read = csv_files.read_folder(spark, f"{root}/in", "*.txt", mandatory=(), transforms={"nombre": F.upper})
    columns = ["id", "nombre", "col_2", "nombre__2", "sin_dato"]
    csv_files.write_aligned(csv_files.require(read, columns[:4]), f"{root}/out", columns)
    out = spark.read.csv(f"{root}/out", header=True, schema=", ".join(f"{x} string" for x in columns), escape='"')
    return out.na.fill("")


@query("""SELECT c_mktsegment AS segmento, count(*) AS filas, translate(c_mktsegment, '<>:"/\\|?*', '_________') || '.csv' AS archivo FROM customer GROUP BY c_mktsegment""")
def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files below their headers, by the folder they lie in, and a safe name for each."""
    path = shared_path(spark, "csv-lines")
    table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("s")).write.partitionBy("s").csv(path, header=True)
    segment = F.url_decode(F.regexp_extract("path", "/s=([^/]*)/", 1))
    n = csv_files.line_counts(spark, path).groupBy(F.nullif(segment, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("segmento")).agg(F.sum("rows").alias("filas"))
    return n.withColumn("archivo", safe_file_name(F.col("segmento")))


@query("SELECT event_id, user_id, event_type FROM events")
def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files that hold every event twice, streamed batch by batch into a table that keeps the first row of a key."""
    files, path = shared_path(spark, "uploads"), shared_path(spark, "uploaded")
    e = table(spark, sf_dir, "events")
    for _ in range(2):
        e.coalesce(2).write.mode("append").parquet(files)
    stream = read_events(spark, files, 1).select("event_id", "user_id", "event_type")
    merge_batches(stream, lambda df, n: merge_write(df, path, ["event_id"], how=insert_ignore), shared_path(spark, "upload-stream")).awaitTermination()
    return spark.read.parquet(path)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS tasa, CASE WHEN l_linenumber % 3 = 1 THEN CAST(trunc(l_quantity) AS INTEGER) END AS cantidad FROM lineitem""")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are NaN, and texts that are none, become null."""
    k = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k != 0, F.col("l_tax")).otherwise(float("nan")).alias("x"),
                                                   F.when(k == 1, F.col("l_quantity").cast("string")).when(k == 2, "n/a").otherwise("NaN").alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nan_to_null(F.col("x")).alias("tasa"), to_int(F.col("t")).alias("cantidad"))


# The five subjects of scores, by the remainder of the part's key.
FIVE = ("mat", "lect", "cie", "his", "ing")


@query(f"""WITH f AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(8, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS rbd, CAST(year(l_shipdate) AS INTEGER) AS agno, l_linenumber AS cod_grado,
         ['{"', '".join(FIVE)}'][l_partkey % 5 + 1] AS asignatura, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS DOUBLE) / 100e0 / count(*) AS puntaje, count(*) AS n_evaluados
  FROM lineitem GROUP BY ALL), b AS (SELECT agno, cod_grado, asignatura, avg(puntaje) AS prom FROM f GROUP BY ALL)
SELECT rbd, agno, cod_grado, asignatura, (round(puntaje + 1e-7, 3) + 0e0) AS puntaje, n_evaluados, (round(prom + 1e-7, 3) + 0e0) AS prom_nacional, (round(puntaje - prom + 1e-7, 3) + 0e0) AS dif_nacional
FROM f JOIN b USING (agno, cod_grado, asignatura)""")
def score_series_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of five subjects, melted from one row a school, year and grade, against the mean of all schools."""
    l, price = table(spark, sf_dir, "lineitem"), cents(F.col("l_extendedprice"))  # noqa: E741
    hits = {s: F.col("l_partkey") % 5 == i for i, s in enumerate(FIVE)}
    wide = l.groupBy(rbd_of("l_suppkey").alias("rbd"), F.year("l_shipdate").alias("agno"), F.col("l_linenumber").alias("cod_grado")).agg(
        *[F.sum(F.when(h, price)).alias(f"cents_{s}") for s, h in hits.items()], *[F.count_if(h).alias(f"n_{s}") for s, h in hits.items()])
    rows = F.stack(F.lit(len(FIVE)), *[x for s in FIVE for x in (F.lit(s), F.col(f"cents_{s}"), F.col(f"n_{s}"))]).alias("asignatura", "cents", "n_evaluados")
    long = wide.select("rbd", "agno", "cod_grado", rows).filter("n_evaluados > 0").withColumn("puntaje", F.col("cents") / 100e0 / F.col("n_evaluados"))
    bench = long.groupBy("agno", "cod_grado", "asignatura").agg(F.avg("puntaje").alias("prom"))
    return long.join(bench, ["agno", "cod_grado", "asignatura"]).select(
        "rbd", "agno", "cod_grado", "asignatura", rnd("puntaje", 3).alias("puntaje"), "n_evaluados", rnd("prom", 3).alias("prom_nacional"), rnd(F.col("puntaje") - F.col("prom"), 3).alias("dif_nacional"))
