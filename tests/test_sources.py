import pytest
from pyspark.sql import functions as F

from kestrane.functions import clean
from kestrane.operators.merge import keep_last
from kestrane.operators.quality import row_count_level
from kestrane.operators.stats import correlation, outside_share, trend
from kestrane.plans.model import Config, config_from
from kestrane.plans.read_api import school_key
from kestrane.plans.relational import unpivot_marks
from kestrane.sources import csv_files, ledger
from kestrane.streaming import events


@pytest.mark.parametrize("head,want", [
    (b"a;b\n1;2\n", ("utf-8", ";")), ("año,b\n1,ñ\n".encode("latin-1"), ("iso-8859-1", ",")), (b"a|b\r\n1|2\r\n", ("utf-8", "|")), (b"a\tb\n", ("utf-8", "\t")),
    ("﻿a,b\n1,2\n".encode(), ("utf-8", ",")), (b"\x00\x01\x02binary", None), (b"", None), (b"one\ntwo\n", None)])
def test_sniff(head, want):
    assert csv_files.sniff_bytes(head) == want


def test_headers_and_names():
    assert csv_files.distinct_names([" NOM RBD", "﻿AGNO", "a-b", "a__b", "", "agno"]) == ["nom_rbd", "agno", "a_b", "a_b__2", "col_4", "agno__2"]
    assert csv_files.union_columns([["mrun", "z"], ["agno", "b"]], ["agno", "rbd"], ["rbd"]) == ["agno", "rbd", "b", "mrun", "z", "_source_file"]


def test_folder_with_diverging_files(spark, tmp_path):
    (tmp_path / "2019").mkdir()
    (tmp_path / "a_2018.csv").write_text("AGNO;MRUN;campo a\n2018;1;x\n2018;2\n2018;3;y;too many\n", encoding="utf-8")
    (tmp_path / "2019" / "b.csv").write_text("mrun,nom rbd\n4,\"Ñuñoa, x\"\n", encoding="latin-1")
    (tmp_path / "junk.csv").write_bytes(b"\x00\x01\x02")
    df = csv_files.read_folder(spark, str(tmp_path), priority=["agno", "mrun"], aliases={"nom_rbd": "nombre"}, transforms={"mrun": lambda c: F.concat(F.lit("0"), c)})
    assert df.columns == ["agno", "mrun", "campo_a", "nombre", "_source_file"]
    assert sorted(map(tuple, df.collect())) == [("2018", "01", "x", "", "a_2018.csv"), ("2018", "02", "", "", "a_2018.csv"), ("2019", "04", "", "Ñuñoa, x", "b.csv")]
    with pytest.raises(ValueError, match="missing"):
        csv_files.require(df, ["mrun", "nothing"])
    assert csv_files.line_count(spark, str(tmp_path / "a_2018.csv")) == 3


def test_years_are_not_taken_from_random_ids(spark, tmp_path):
    (tmp_path / "2018").mkdir()
    for name in ("part-00000-1b2a2035-4c11-4d2e-9f00-5b2c6d7e8f90-c000.csv", "part-00000-0b2a1135-2041-4d2e-9f00-5b2c6d7e8f90-c000.csv", "notas_2016_3f0c1135-4041-4d2e-9f00-5b2c6d7e2019.csv"):
        (tmp_path / "2018" / name).write_text("id,nombre\n1,a\n")
    got = {r._source_file[:10]: r.agno for r in csv_files.read_folder(spark, str(tmp_path)).filter("_source_file not like '%-2041-%'").collect()}
    assert got == {"part-00000": "2018", "notas_2016": "2016"}
    assert {r.agno for r in csv_files.read_folder(spark, str(tmp_path), pattern="part-*.csv").collect()} == {"2018"}


def test_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / f"{n}.csv").write_text(f"x,y\n{n},1\n")
    path = str(tmp_path / "ledger")
    files = ledger.hashed_files(spark, str(tmp_path / "in"))
    assert ledger.pending(files, ledger.latest(spark, path)).count() == 3
    ledger.record(files.filter("path like '%a.csv'"), path, "error")
    ledger.record(files.filter("path like '%a.csv'"), path, "ok")
    ledger.record(files.filter("path like '%b.csv'"), path, "error")
    assert sorted(r.path[-5:] for r in ledger.pending(files, ledger.latest(spark, path)).collect()) == ["b.csv", "c.csv"]
    expected = files.select("path", F.when(F.col("path").like("%a.csv"), "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert {r.status: r.n for r in ledger.verify(expected, files).collect()} == {"ok": 2, "corrupt": 1, "missing": 1}


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, clean.clean_str, [None, "", " nan", "NaN", "None", " a "]) == [None] * 5 + ["a"]
    assert values(spark, clean.to_int, ["3", "3.0", "3.9", "-3.9", "", "x", None]) == [3, 3, 3, -3, None, None, None]
    assert values(spark, clean.to_float, ["3,5", "1.234,5", "1.234.567", "", None, "nan"]) == [3.5, 1234.5, 1234.567, None, None, None]
    assert [str(v) for v in values(spark, clean.to_date, ["20200131", "2020-01-31", "202001", "20201345", ""])] == ["2020-01-31", "2020-01-31", "2020-01-01", "None", "None"]
    assert values(spark, clean.norm_rbd, ["123", "00000123", "12345678", "123456789", "abc", "a1b2"]) == ["00000123", "00000123", "12345678", "123456789", None, "00000012"]
    assert values(spark, clean.parse_run, ["12.345.678-9", "123", "x", ""]) == [12345678, 123, None, None]
    assert values(spark, clean.parse_grade, ["4b", "2M", "7", "zz", None]) == [4, 10, 7, None, None]
    assert values(spark, clean.mark, ["6.5", "6,5", "", "-", None]) == [6.5, 6.5, None, None, None]
    assert values(spark, clean.safe_file_name, ['a<b>:"c.', "x.CSV"]) == ["a_b___c.csv", "x.CSV"]
    assert school_key(spark, "RBD-123") == "00000123"
    with pytest.raises(ValueError):
        school_key(spark, "none")


def test_trend_shapes(spark):
    series = {"line": [(2000 + i, 10.0 + 2 * i) for i in range(6)], "one": [(2000, 1.0)], "two": [(2000, 1.0), (2001, 5.0)], "flat": [(2000 + i, 3.0) for i in range(4)], "missing": [(2000, None), (2001, None)],
              "jump": [(2000 + i, 10.0) for i in range(8)] + [(2008, 90.0)]}
    df = spark.createDataFrame([(k, y, v) for k, s in series.items() for y, v in s], "k string, agno int, puntaje double")
    got = {r.k: r for r in trend(df, ["k"]).collect()}
    assert set(got) == {"line", "two", "flat", "jump"}
    assert abs(got["line"].slope - 2) < 1e-9 and abs(got["line"].proyectado - 22) < 1e-9 and not got["line"].alerta
    assert got["two"].n_puntos == 2 and not got["two"].alerta and got["flat"].r2 == 1.0 and got["jump"].alerta


@pytest.mark.parametrize("points", [
    [(1995, 3.4), (1996, 6.4), (1997, 5.8), (1998, 5.2), (1999, 5.8), (2000, 6.4), (2001, 3.4)],
    [(1995, 1.6), (1996, 3.25), (1997, 3.4), (1998, 3.1), (1999, 4.6), (2000, 4.0), (2001, 7.0)],
    [(1995, 5.5), (1997, 4.6), (1998, 4.0), (1999, 3.1), (2000, 4.6)],
    [(1996, 5.2), (1997, 4.6), (1999, 4.0), (2000, 2.8), (2001, 6.4)],
    [(1995, 3.4), (1996, 4.0), (1997, 5.8), (1998, 5.2), (1999, 6.4), (2000, 4.6), (2001, 2.8)],
])
def test_last_value_as_far_off_as_the_threshold_is_no_alert(spark, points):
    """Each last value lies exactly 1.5 errors off its fit, whatever the order of the rows."""
    sums = [sum(f(x - 1995, round(100 * y)) for x, y in points) for f in (lambda x, y: x, lambda x, y: y, lambda x, y: x * x, lambda x, y: x * y, lambda x, y: y * y)]
    (sx, sy, sxx, sxy, syy), n, (x, y) = sums, len(points), (points[-1][0] - 1995, round(100 * points[-1][1]))
    d, b = n * sxx - sx * sx, n * sxy - sx * sy
    assert 4 * (d * (n * y - sy) - b * (n * x - sx)) ** 2 == 9 * (d * (n * syy - sy * sy) - b * b) * d
    further = [*points[:-1], (points[-1][0], points[-1][1] + (0.01 if d * (n * y - sy) > b * (n * x - sx) else -0.01))]
    rows = [(f"{i}{name}", a, v) for i in range(n) for name, p in (("tie", points), ("further", further)) for a, v in [*p[i:], *p[:i]]]
    got = trend(spark.createDataFrame(rows, "k string, agno int, puntaje double"), ["k"], digits=2)
    assert got.columns == trend(spark.createDataFrame(rows, "k string, agno int, puntaje double"), ["k"]).columns
    assert {(r.k[1:], r.alerta) for r in got.collect()} == {("tie", False), ("further", True)}


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i), 5.0) for i in range(4)], "k string, x double, y double")
    assert df.groupBy("k").agg(correlation(F.col("x"), F.col("y")).alias("r")).head().r is None
    peers = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0)], "g string, v double")
    pilots = spark.createDataFrame([("g", 2.0, 1), ("g", 0.5, 2), ("none", 1.0, 3)], "g string, v double, id int")
    assert {r.id: (r.p, r.p_n) for r in outside_share(pilots, peers, ["g"], "v", "p").collect()} == {1: (pytest.approx(200 / 3), 3), 2: (0.0, 3), 3: (None, 0)}
    assert keep_last(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "k int, s int, v string"), ["k"], ["s"]).count() == 2
    assert row_count_level(df).head().level == "WARNING"
    wide = spark.createDataFrame([(1, 5.0, None), (2, None, 6.0)], "id int, nota_1 double, nota_2 double")
    assert sorted(map(tuple, unpivot_marks(wide, 2).collect())) == [(1, 1, 5.0), (2, 2, 6.0)]
    rows = spark.createDataFrame([("hiatus_start", "2019"), ("alert_threshold", "x"), ("other", "1")], "key string, value string")
    assert config_from(rows, hiatus_end=2021) == Config(hiatus_start=2019, hiatus_end=2021)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(source))
    query = events.hourly(events.read_events(spark, str(source), 1), "100 days").writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.hourly(spark.read.parquet(str(source)))
    told = lambda df: sorted((str(r.window.start), r.event_type, r.n) for r in df.collect())
    assert told(spark.table("hourly")) == told(batch)
    seen = []
    events.merge_batches(events.read_events(spark, str(source)), lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == spark.read.parquet(str(source)).count()
