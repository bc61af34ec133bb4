import random

import pytest
from pyspark.sql import functions as F

from kestrane.functions.clean import nan_to_null
from kestrane.operators import merge
from kestrane.sources import csv_files, ledger, tables

SCHEMA = "k int, row string, o string, n int"
COLUMNS = ["k", "row", "o", "n"]


def replayed(old, new, how):
    """The rows of a batch applied one by one; new: (place, row)."""
    out = {r[0]: list(r) for r in old}
    for _, r in sorted(new):
        if how == "replace" or r[0] not in out:
            out[r[0]] = list(r)
        elif how == "coalesce":
            out[r[0]] = [b if b is not None else a for a, b in zip(out[r[0]], r)]
        elif how == "partial":
            out[r[0]][1] = r[1]
    return sorted(map(tuple, out.values()), key=repr)


@pytest.mark.parametrize("how,apply", [
    ("replace", merge.merge_replace), ("ignore", merge.insert_ignore), ("coalesce", merge.merge_coalesce),
    ("partial", lambda o, n, k, s: merge.merge_partial(o, n, k, ["row"], s))])
def test_batches_with_repeated_keys(spark, how, apply):
    r = random.Random(7)
    value = lambda x: r.choice([None, f"{x}{r.randrange(9)}"])
    old = [(k, value("r"), value("o"), r.randrange(5)) for k in [*range(8), None]]
    new = [(i, (r.choice([None, *range(12)]), value("R"), value("O"), r.choice([None, i]))) for i in range(60)]
    shuffled = new[:]
    r.shuffle(shuffled)
    batch = spark.createDataFrame([(*row, i) for i, row in shuffled], SCHEMA + ", place int")
    table = spark.createDataFrame([(*row, -1) for row in old], batch.schema)
    got = apply(table, batch, ["k"], ["place"]).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == replayed(old, new, how)


def test_batches_edges(spark):
    batch = spark.createDataFrame([(1, "b", None, 2), (1, "a", None, 1)], SCHEMA)
    nothing = batch.limit(0)
    for f in (merge.merge_replace, merge.insert_ignore, merge.merge_coalesce, lambda o, n, k: merge.merge_partial(o, n, k, ["n"])):
        assert f(nothing, nothing, ["k"]).count() == 0 and f(batch.limit(1), nothing, ["k"]).count() == 1
        one = f(nothing, batch, ["k"]).collect()  # without a sequence the same row each time
        assert len(one) == 1 and one == f(nothing, batch.orderBy("n"), ["k"]).collect()
    assert merge.merge_replace(nothing.select("k"), batch.select("k"), ["k"]).count() == 1


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, file int")
    assert not tables.exists(spark, path)
    tables.merge_write(rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), path, ["k"], ["file"])
    got = tables.merge_write(rows((2, "e", 2), (2, "d", 1), (None, "f", 1)), path, ["k"], ["file"])
    assert {(r.k, r.v) for r in got.collect()} == {(1, "b"), (2, "e"), (None, "f")}
    with pytest.raises(Exception, match="boom"):
        tables.swap_write(got.select(F.raise_error(F.lit("boom")).alias("k")), path)
    assert spark.read.parquet(path).count() == 3
    assert {r.v for r in tables.delete_rows(spark, path, "k = 1").collect()} == {"e", "f"}
    tables.append_write(rows((2, "g", 9)), path)
    assert spark.read.parquet(path).count() == 3


def test_encodings(spark, tmp_path):
    text = "nombre;ciudad\nÑandú;“Ñuñoa”\n"
    assert csv_files.sniff_bytes(text.encode("cp1252")) == ("windows-1252", ";")
    assert csv_files.sniff_bytes(text.encode("utf-8-sig")) == ("utf-8", ";") and csv_files.sniff_bytes(text.encode("utf-16")) == ("utf-16le", ";")
    assert csv_files.sniff_bytes(text.encode()[: text.encode().index("ñoa".encode()) + 1]) == ("utf-8", ";")  # a cut last character
    assert csv_files.sniff_bytes("a;ñ\n".encode("latin-1"), "utf-8") == ("utf-8", ";") and csv_files.sniff_bytes("a;b\n".encode(), "iso-8859-1") == ("iso-8859-1", ";")
    assert csv_files.sniff_bytes("a;\x81ñ\n".encode("latin-1"))[0] == "iso-8859-1"
    for name, encoding in (("a", "cp1252"), ("b", "utf-8-sig"), ("c", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    got = csv_files.read_folder(spark, str(tmp_path), mandatory=()).collect()
    assert sorted(r._source_file for r in got) == ["a.csv", "b.csv", "c.csv"] and {(r.nombre, r.ciudad) for r in got} == {("Ñandú", "“Ñuñoa”")}
    assert csv_files.grade_in_names(["agno", "ptje_4b_rbd"], "x_8b.csv") == "4b" and csv_files.grade_in_names(["agno"], "x_8B.csv") == "8b" and csv_files.grade_in_names([], "x") is None
    cells = csv_files.without_empty_rows(csv_files.blank_to_null(spark.createDataFrame([(" ", ""), (" a ", None)], "x string, y string")))
    assert list(map(tuple, cells.collect())) == [("a", None)]


def test_hashes_of_large_files_are_streamed(spark, tmp_path):
    for n in (10, 3000):
        (tmp_path / f"{n}.csv").write_bytes(b"x" * n)
    small, large = (sorted(map(tuple, ledger.hashed_files(spark, str(tmp_path), whole=w).collect())) for w in (100, 1 << 30))
    assert small == large and len(small) == 2


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    assert [r.x for r in df.select(nan_to_null(F.col("x")).alias("x")).collect()] == [None, 1.5, None]
