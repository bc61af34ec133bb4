from kestrane.functions.clean import last_year_in_text, sheet_fields
from kestrane.plans import read_api, registry, runner
from kestrane.plans.analytics import metrics
from kestrane.sources import sheets
from pyspark.sql import functions as F

FILE = "123_110_4_b_05032021_101500.pdf"
TABLES = "file string, table_no int, grid array<array<string>>"


def pupil(n, marks, layout="with_municipality"):
    at = sheets.LAYOUTS[layout]
    row = [None] * 36
    for k, v in {"n_orden": str(n), "nombre": f"P{n}", "run": "1-9", "sexo": "F", "promedio": "5,5", "asistencia_pct": "93.0", "situacion_final": "P"}.items():
        row[at[k]] = v
    for i, m in marks.items():
        row[at["marks"] + i] = m
    return row


def test_pupils_and_teachers(spark):
    grid = [["Nº", "Nombre"], pupil(1, {1: "6,0", 2: "5.5", 5: "7,0"}), pupil(2, {1: "-", 3: "4,0"}), ["total", "x"]]
    teachers = [["N", "Subsectores", "Profesor", "RUN", "Hab.", ""], ["1", "Música", "Ana", "2-7", "si", None], [None] * 6]
    df = spark.createDataFrame([(FILE, 0, [["a"], ["1"]]), (FILE, 1, grid), (FILE, 2, teachers)], TABLES)
    texts = spark.createDataFrame([(FILE, "Acta 2019 y 2020, folio 12020")], "file string, text string")
    got = sheets.marks_of(df, "with_municipality", texts).orderBy("n_orden").collect()
    assert [(r.rbd, r.agno, r.letra, r.n_orden, r.promedio, r.asistencia_pct) for r in got] == [("00000123", 2020, "B", 1, 5.5, 93), ("00000123", 2020, "B", 2, 5.5, 93)]
    assert [[r[f"nota_{i}"] for i in range(1, 8)] for r in got] == [[None, 6.0, 5.5, None, None, None, None], [None, None, None, 4.0, None, None, None]]
    (t,) = sheets.teachers_of(df).collect()
    assert (t.agno, t.n_asig, t.subsector, t.nombre_profesor, t.run_profesor, t.habilitacion) == (2021, 1, "Música", "Ana", "2-7", "si")
    other = spark.createDataFrame([(FILE, 0, [["h"], pupil(1, {0: "6.0"}, "without_municipality"), ["x"]])], TABLES)
    assert sheets.marks_of(other, "without_municipality").head().nota_1 == 6.0


def test_sheets_are_small_while_they_are_sorted(spark):
    """Odd cells come through the packed form, and rows without numbers and empty cells take no room in it."""
    odd = pupil(1, {0: "6,0", 24: "3.5"}, "without_municipality")
    odd[1] = 'Ñ "x", [\\] \n\u2028'
    short = ["2", "corto"]
    df = spark.createDataFrame([(FILE, 0, [["h"], odd, short, [], None, [None], ["x"]])], TABLES)
    got = sheets.marks_of(df, "without_municipality").orderBy("n_orden")
    first, second = got.collect()
    assert (first.nombre, first.nota_1, first.nota_2, first.nota_25) == (odd[1], 6.0, None, None) and (second.nombre, second.nota_1) == ("corto", None)
    sorts = [x for x in got.drop("n_orden")._jdf.queryExecution().sparkPlan().toString().split("\n") if "SortAggregate" in x or "max_by" in x]
    assert sorts and not any("max_by(grid" in x for x in sorts)


def test_names_and_years(spark):
    df = spark.createDataFrame([("x 1999 20250 2031 2007",), ("none",)], "t string")
    assert [r.y for r in df.select(last_year_in_text(F.col("t")).alias("y")).collect()] == [2007, None]
    f = sheet_fields(F.lit(FILE))
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in f.items()]).head())[:4] == ("00000123", "110", "4", "b")


def test_runs_are_independent(spark, sf_dir, tmp_path):
    bad = dict(registry.QUERIES, score_series_all=lambda s, d: s.read.parquet(f"{d}/nothing"))
    told = runner.run(spark, sf_dir, str(tmp_path), ["simce_serie", "cruce", "unknown"], bad)
    assert told.status == "error" and set(told.errors) == {"simce_serie", "unknown"} and set(told.paths) == {"cross_gap", "cross_correlation"}
    assert {r.module: r.status for r in runner.status(spark, str(tmp_path), told.run_id).collect()} == {"simce_serie": "error", "cruce": "ok", "unknown": "error"}
    events = spark.read.parquet(f"{tmp_path}/_ledger")
    assert {(r.status, r["count"]) for r in events.groupBy("status").count().collect()} == {("running", 3), ("ok", 1), ("error", 2)}
    assert runner.health(spark)


def test_reads_of_stored_metrics(spark, sf_dir, tmp_path):
    path = runner.store_metrics(spark, sf_dir, str(tmp_path), 4)
    stored = runner.stored_metrics(spark, str(tmp_path))
    assert path.endswith("/metrics") and stored.count() == metrics(spark, sf_dir).count()
    for read in (read_api.metrics_by_school, read_api.active_alerts):
        got = read(spark, sf_dir, stored=stored)
        assert sorted(map(str, got.collect())) == sorted(map(str, read(spark, sf_dir).collect()))
    plan = read_api.metrics_by_school(spark, sf_dir, stored=stored)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(rbd), EqualTo(rbd,00000001)]" in plan
    files = stored.select(F.input_file_name().alias("f"), "rbd").distinct().groupBy("rbd").count()
    assert files.filter("count > 1").isEmpty()  # a school lies in one file


def test_families_share_stored_facts(spark, sf_dir):
    from kestrane.plans.analytics import Facts

    rows = lambda df: sorted(map(repr, df.collect()))
    shared = metrics(spark, sf_dir, Facts(spark, sf_dir, stored=True))
    assert not any("lineitem" in f or "orders" in f for f in shared.inputFiles())
    assert rows(shared) == rows(metrics(spark, sf_dir))
    plan = read_api.metrics_by_school_all(spark, sf_dir)
    assert not any("lineitem" in f or "orders" in f for f in plan.inputFiles())


def test_texts_are_sorted_from_a_table(spark, sf_dir):
    """A sort over ranges reads its input twice, so what is below it is a scan, not the working out of metrics."""
    df = read_api.insights_text(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not any(x in plan for x in ("Join", "Aggregate", "Window"))


def test_trends_beside_series(spark, sf_dir):
    one = read_api.scores_with_trends_all(spark, sf_dir, "00000001", "4B").collect()
    assert one and {(r.rbd, r.grado) for r in one} == {("00000001", "4b")} and any(r.slope_full is not None for r in one)
    assert {r.rbd for r in read_api.grades_with_trends_all(spark, sf_dir, "00000002").collect()} == {"00000002"}
