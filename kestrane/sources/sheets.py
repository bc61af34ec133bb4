"""Record sheets: rows of already extracted tables to pupils' marks and teachers.

Input: one row per table, (file, table_no, grid), grid an array of rows of text cells. A sheet
has one table of pupils and one of teachers; which they are is told from their cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_str, last_year_in_text, mark, sheet_fields, to_int

# Columns of the pupils' table in its two layouts; the mark slots follow `marks`.
LAYOUTS = {
    "with_municipality": {"n_orden": 0, "nombre": 1, "run": 2, "fec_nac": 3, "comuna": 4, "sexo": 5, "marks": 6, "promedio": 31, "prom_literario": 32, "asistencia_pct": 33, "situacion_final": 34, "observaciones": 35},
    "without_municipality": {"n_orden": 0, "nombre": 1, "run": 2, "fec_nac": 3, "sexo": 4, "marks": 5, "promedio": 30, "prom_literario": 31, "asistencia_pct": 32, "situacion_final": 33, "observaciones": 34},
}
SLOTS = 25
TEACHER_COLUMNS = 6
# Words that mark the teachers' table in one of its first rows.
TEACHER_WORDS = "subsector|nombre profesor"
TEACHER_FIELDS = ("n_asig", "subsector", "nombre_profesor", "run_profesor", "habilitacion")


def _numbered(row: Column) -> Column:
    return F.coalesce(F.trim(F.try_element_at(row, F.lit(1))).rlike(r"^\d+$"), F.lit(False))


def _cell(row: Column, place: int) -> Column:
    return F.try_element_at(row, F.lit(place + 1))


def _of_most_rows(tables: DataFrame, kept: Column) -> DataFrame:
    """(file, <kept>): what is kept of each file's table of three rows or more with most numbered rows."""
    score = F.size(F.filter("grid", _numbered))
    return tables.filter(F.size("grid") >= 3).select("file", kept.alias("kept"), F.struct(score, -F.col("table_no")).alias("score")).groupBy("file").agg(F.max_by("kept", "score").alias("kept"))


def pupil_tables(tables: DataFrame) -> DataFrame:
    """(file, grid): of each file's tables of three rows or more, the one with most numbered rows."""
    return _of_most_rows(tables, F.col("grid")).withColumnRenamed("kept", "grid")


def teacher_tables(tables: DataFrame) -> DataFrame:
    """(file, grid): each file's first table of six columns that names teachers' subjects at its head."""
    head = F.exists(F.slice("grid", 1, 3), lambda r: F.lower(F.array_join(r, " ")).rlike(TEACHER_WORDS))
    fits = tables.filter((F.size(F.try_element_at("grid", F.lit(1))) == TEACHER_COLUMNS) & head)
    return fits.groupBy("file").agg(F.min_by("grid", "table_no").alias("grid"))


def _with_file(rows: DataFrame, texts: DataFrame | None) -> DataFrame:
    f = sheet_fields(F.col("file"))
    rows = rows.withColumns({"rbd": f["rbd"], "grado": f["grado"], "letra": F.upper(f["letra"]), "fecha_acta": f["fecha"]})
    year = F.year("fecha_acta")
    if texts is not None:
        rows = rows.join(texts.select("file", last_year_in_text(F.col("text"), 1990, 2030).alias("__year")), "file", "left")
        year = F.coalesce("__year", year)
    return rows.withColumn("agno", year).drop("__year")


def marks_of(tables: DataFrame, layout: str, texts: DataFrame | None = None) -> DataFrame:
    """One row per pupil: file fields, the pupil's cells and nota_1..nota_25.

    Slots count from the first that any pupil of the sheet has a mark in, up to the first
    empty one after it; marks beyond are not part of the sheet. The year is the greatest in
    the sheet's text, else the file name's.
    """
    at = LAYOUTS[layout]
    # most cells are empty: as text a sheet is several times smaller while it is shuffled and sorted
    grids = _of_most_rows(tables, F.to_json(F.filter("grid", _numbered))).select("file", F.from_json("kept", "array<array<string>>").alias("rows"))
    marks_in = lambda r: F.transform(F.slice(r, at["marks"] + 1, SLOTS), mark)
    grids = grids.select("file", F.transform("rows", lambda r: F.struct(r.alias("r"), marks_in(r).alias("marks"))).alias("rows"))
    places = lambda row: F.filter(F.transform(row["marks"], lambda x, i: F.when(x.isNotNull(), i + 1)), lambda i: i.isNotNull())
    grids = grids.withColumn("used", F.array_distinct(F.flatten(F.transform("rows", places))))
    grids = grids.withColumn("first", F.array_min("used"))
    gaps = F.filter(F.array(*[F.lit(i + 1) for i in range(SLOTS)]), lambda i: (i > F.col("first")) & ~F.array_contains("used", i))
    grids = grids.withColumn("end", F.coalesce(F.array_min(gaps), F.lit(SLOTS + 1)))
    rows = _with_file(grids.select("file", "first", "end", F.explode("rows").alias("x")).select("file", "first", "end", "x.*"), texts)
    slot = lambda i: F.when((F.col("first") <= i + 1) & (F.col("end") > i + 1), F.try_element_at("marks", F.lit(i + 1))).alias(f"nota_{i + 1}")
    kinds = {"n_orden": to_int, "asistencia_pct": to_int, "promedio": mark}
    cells = {k: kinds.get(k, clean_str)(_cell(F.col("r"), place)).alias(k) for k, place in at.items() if k != "marks"}
    return rows.select("rbd", "agno", "grado", "letra", "fecha_acta", *cells.values(), *[slot(i) for i in range(SLOTS)])


def teachers_of(tables: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per subject: file fields and the teacher's cells."""
    rows = _with_file(teacher_tables(tables).select("file", F.explode(F.filter("grid", _numbered)).alias("r")), texts)
    cells = [(to_int if i == 0 else clean_str)(_cell(F.col("r"), i)).alias(name) for i, name in enumerate(TEACHER_FIELDS)]
    return rows.select("rbd", "agno", "grado", "letra", "fecha_acta", *cells)
