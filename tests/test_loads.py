import os
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kestrane.functions.rounding import half_even
from kestrane.operators.merge import insert_ignore, merge_coalesce
from kestrane.operators.numbering import number_new, numbered
from kestrane.operators.quality import bottom_rows, row_hash, sampled_counters
from kestrane.plans import loads, read_api, registry, runner
from kestrane.sources import commits, csv_files, tables
from kestrane.streaming import events

ROWS = "k int, year int, v string, place int"
KEYS = ["k", "year"]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_touched_partitions_change(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(k, y, f"a{k}", 0) for k in range(20) for y in (2001, 2002, 2003, None)], ROWS)
    tables.merge_partitions(first, path, KEYS, ["year"], ["place"])
    before = files(path)
    batch = spark.createDataFrame([(1, 2002, "late", 2), (1, 2002, "early", 1), (99, 2002, "new", 0), (5, None, "null year", 0), (7, 2009, "new year", 0)], ROWS)
    got = tables.merge_partitions(batch, path, KEYS, ["year"], ["place"])
    assert got.schema.simpleString() == first.schema.simpleString().replace("year:int,v:string,place:int", "v:string,place:int,year:int") or set(got.columns) == set(first.columns)
    assert dict(got.dtypes)["year"] == "int"
    want = {(k, y): f"a{k}" for k in range(20) for y in (2001, 2002, 2003, None)} | {(1, 2002): "late", (99, 2002): "new", (5, None): "null year", (7, 2009): "new year"}
    assert {(r.k, r.year): r.v for r in got.collect()} == want
    after = files(path)
    kept = {f for f in before if "year=2001" in f or "year=2003" in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(after.get(f) == before[f] for f in before if f not in kept)


def test_old_side_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.merge_partitions(spark.createDataFrame([(k, y, "a", 0) for k in range(5) for y in range(2000, 2010)], ROWS), path, KEYS, ["year"])
    old = tables.read_stored(spark, path).filter(tables.partition_filter(["year"], [(2003,), (None,)]))
    assert {f.split("year=")[1].split("/")[0] for f in old.inputFiles()} == {"2003"} or len(old.select(F.input_file_name()).distinct().collect()) <= 5
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2003" in plan.split("PartitionFilters")[1].split("]")[0]
    two = tables.partition_filter(["year", "k"], [(2003, 1), (None, 2)])
    assert tables.read_stored(spark, path).filter(two).count() == 1


@pytest.mark.parametrize("how,want", [(insert_ignore, {1: "a", 2: "b", 3: "first"}), (merge_coalesce, {1: "x", 2: "b", 3: "last"})])
def test_other_merges(spark, tmp_path, how, want):
    batches = [[(1, 2001, "a", 0), (2, 2001, "b", 0)], [(1, 2001, "x", 0), (2, 2001, None, 1), (3, 2001, "first", 0), (3, 2001, "last", 1), (3, 2001, None, 2)]]
    for merge, path in ((lambda b, p: tables.merge_partitions(b, p, KEYS, ["year"], ["place"], how), str(tmp_path / "p")), (lambda b, p: tables.merge_write(b, p, KEYS, ["place"], how), str(tmp_path / "w"))):
        for b in batches:
            got = merge(spark.createDataFrame(b, ROWS), path)
        assert {r.k: r.v for r in got.collect()} == want


def test_types_of_partition_columns_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("01", "x"), ("1", "y"), (None, "z")], "code string, v string")
    assert rows(tables.merge_partitions(first, path, ["code"], ["code"]).select("code", "v")) == rows(first)
    assert rows(tables.merge_partitions(first.limit(0), path, ["code"], ["code"]).select("code", "v")) == rows(first)
    assert tables.merge_partitions(first.limit(0), str(tmp_path / "none"), ["code"], ["code"]).count() == 0
    with pytest.raises(ValueError, match="no keys"):
        tables.merge_partitions(first, path, ["code"], ["v"])


def test_a_writer_that_dies_while_it_replaces_partitions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.merge_partitions(spark.createDataFrame([(1, 2001, "a", 0), (2, 2002, "b", 0)], ROWS), path, KEYS, ["year"])
    batch = spark.createDataFrame([(1, 2001, "c", 0)], ROWS)

    def dies(merged, at, by):
        tables.remove(spark, f"{at}/year=2001")
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tables, "_finish", dies)
        with pytest.raises(RuntimeError, match="killed"):
            tables.merge_partitions(batch, path, KEYS, ["year"])
    assert {r.v for r in tables.read_stored(spark, path).collect()} == {"c", "b"}
    assert not tables.exists(spark, f"{path}.redo")


def test_swap_that_cannot_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    real = tables._rename

    def refuses(s, source, target):
        if ".new-" in source:
            raise OSError("could not rename")
        real(s, source, target)

    with monkeypatch.context() as m:
        m.setattr(tables, "_rename", refuses)
        with pytest.raises(OSError):
            tables.swap_write(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    real(spark, path, f"{path}.old-abc")  # a writer died between its two renames
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="nothing"):
        real(spark, f"{path}-nothing", f"{path}-x")


def test_chunks_are_written_once(spark, tmp_path, monkeypatch):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    spark.range(30).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type")).repartition(3).write.parquet(source)
    schema = "event_id long, event_type string"
    checkpoint = str(tmp_path / "checkpoint")
    real, failed = commits.commit, []

    def dies_once(s, at, name, batch):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("killed between write and commit")
        real(s, at, name, batch)

    monkeypatch.setattr(commits, "commit", dies_once)
    stream = lambda: events.merge_batches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), commits.once(path, "s"), checkpoint)
    with pytest.raises(Exception, match="killed"):
        stream().awaitTermination()
    assert commits.read_committed(spark, path, schema).count() == 10  # what is not committed is not seen
    written = files(f"{path}/source=s/batch=1")
    stream().awaitTermination()
    assert failed and files(f"{path}/source=s/batch=1") == written  # logged, not written again
    assert rows(commits.read_committed(spark, path, schema)) == [(i, "x") for i in sorted(range(30), key=lambda i: repr((i, "x")))]
    df = spark.range(5).select(F.col("id").alias("event_id"), F.lit("y").alias("event_type"))
    assert [commits.write_once(df, path, "t", 0) for _ in range(2)] == ["written", "skipped"]
    df.write.parquet(f"{path}/source=t/batch=1")
    os.remove(f"{path}/source=t/batch=1/_SUCCESS")  # written in part
    assert commits.write_once(df, path, "t", 1) == "written" and commits.read_committed(spark, path, schema).count() == 40
    assert commits.read_committed(spark, str(tmp_path / "none"), schema).count() == 0


def test_numbers_are_dense_and_stay(spark):
    r = random.Random(3)
    words = [None if i % 97 == 0 else f"w{r.randrange(400)}" for i in range(2000)]
    first = numbered(spark.createDataFrame([(w,) for w in words[:1000]], "w string"), ["w"])
    assert rows(first.select("id", "w")) == rows(spark.createDataFrame([(i, w) for i, w in enumerate(sorted(set(words[:1000]), key=lambda w: (w is not None, w)), 1)], "id long, w string"))
    both = number_new(first, spark.createDataFrame([(w,) for w in words], "w string"), ["w"])
    old, new = {x.w: x.id for x in first.collect()}, {x.w: x.id for x in both.collect()}
    assert sorted(new.values()) == list(range(1, len(set(words)) + 1)) and all(new[w] == i for w, i in old.items())
    nothing = spark.createDataFrame([], "w string")
    assert numbered(nothing, ["w"]).count() == 0 and number_new(first, nothing, ["w"]).count() == first.count()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("BroadcastExchange", "").split("Window")[0] or "Window" in plan


def test_sampled_scan(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("agno"), F.when(F.col("id") % 3 == 0, None).otherwise("a").alias("v")).repartition(7)
    want = rows(df.withColumn("h", row_hash(df)).orderBy("h").limit(100).drop("h"))
    assert rows(bottom_rows(df, 100)) == want == rows(bottom_rows(df.repartition(3), 100))
    assert bottom_rows(df, 9000).count() == 5000 and bottom_rows(df.limit(0), 5).count() == 0
    same = spark.range(400).select(F.lit("1999").alias("agno"))
    assert bottom_rows(same, 10).count() == 10
    got = {r.code: (r.n, r.pct) for r in sampled_counters(df, 100, mandatory=["v"]).collect()}
    assert got["SAMPLE"] == (100, 2.0) and got["NULL_MANDATORY_V"][0] == sum(v is None for _, v in want)


def test_counts_come_from_the_write(spark, tmp_path):
    source, out, ledger = (str(tmp_path / x) for x in ("in", "out", "ledger"))
    spark.range(100).select(F.when(F.col("id") % 10 != 3, F.col("id")).alias("v")).write.parquet(source)
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(out)

    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("counted", "counted")
    got = commits.write_counted(spark.read.parquet(source), F.col("v") >= 50, write, ledger, "s")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"leidas": 100, "insertadas": 45, "omitidas": 55} and spark.read.parquet(out).count() == 45
    assert plans[0].count("FileScan") == 1 and "PushedFilters: []" in plans[0] and len(jobs()) >= 1
    with pytest.raises(Exception):
        commits.write_counted(spark.read.parquet(source), F.col("v") >= 50, write, ledger, "s")  # the folder is there
    assert [(r.source, r.status, r.leidas) for r in commits.loads(spark, ledger).collect()] == [("s", "error", None)]
    assert commits.write_counted(spark.read.parquet(source).limit(0), F.lit(True), lambda d: d.write.parquet(f"{out}2"), ledger, "e")["leidas"] == 0


def exact(x, digits):
    return float(round(Fraction(x) * 10**digits)) / 10**digits + 0.0  # Python rounds fractions half to even


def test_half_even_on_the_binary_value(spark):
    r = random.Random(5)
    values = [0.125, 2.675, 0.375, 1.005, 2.5, 3.5, -0.125, -2.675, 0.0, -0.0, 1e-300, 4.35, 1e15 + 0.5, 4503599627370497.5, 1e300, 0.285, 0.49999999999999994, 5e-324]
    values += [r.uniform(-1000, 1000) for _ in range(2000)] + [r.randrange(-8000, 8000) / 8 for _ in range(500)] + [round(r.uniform(0, 100), 3) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        got = [x.y for x in df.select(half_even(F.col("x"), digits).alias("y")).collect()]
        assert got == [exact(v, digits) if abs(v) < 1e15 else round(v, digits) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "x double").select(half_even(F.col("x"), 2).alias("y")).collect()
    assert odd[0].y is None and odd[1].y != odd[1].y and odd[2].y == float("-inf")


def test_rows_left_out_are_kept_beside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_2018.csv").write_text("AGNO;MRUN;campo a\n2018;1;x\n2018;2\n2018;3;y;too many\n\n2018;4;\"a;b\"\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("mrun,nom rbd\n4,\"Ñuñoa, x\"\n5,a,b,c\n", encoding="latin-1")
    good, bad = csv_files.load_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r._source_file, r.mrun) for r in good.collect()) == [("a_2018.csv", "1"), ("a_2018.csv", "2"), ("a_2018.csv", "4"), ("b.csv", "4")]
    assert rows(bad) == [("a_2018.csv", "4 cells, 3 columns", "2018;3;y;too many"), ("b.csv", "4 cells, 2 columns", "5,a,b,c")]
    assert good.columns == ["agno", "campo_a", "mrun", "nom_rbd", "_source_file"]


def test_modules_at_once(spark, sf_dir, tmp_path):
    slow = lambda s, d: s.range(1, numPartitions=1).select(F.col("id").cast("string").alias("x")).mapInPandas(_sleepy, "x string")
    queries = dict(registry.QUERIES, score_series_all=lambda s, d: s.read.parquet(f"{d}/nothing"), percentile_records=slow, cross_gap=lambda s, d: s.range(3), cross_correlation=lambda s, d: s.range(3))
    out = str(tmp_path / "a")
    began = time.time()
    run = runner.start(spark, sf_dir, out, ["simce_serie", "simce_percentil", "cruce"], queries)
    assert time.time() - began < 10 and run.threads
    states = lambda: {r.module: r.status for r in runner.status(spark, out, run.run_id).collect()}
    while states().get("cruce") not in ("ok", "error") or states().get("simce_serie") not in ("ok", "error"):
        assert time.time() - began < 90
        time.sleep(0.2)
    assert states() == {"simce_serie": "error", "cruce": "ok", "simce_percentil": "running"}
    run.cancel()
    told = run.wait(60)
    assert states() == {"simce_serie": "error", "cruce": "ok", "simce_percentil": "cancelled"}
    assert told.status == "error" and set(told.errors) == {"simce_serie", "simce_percentil"} and time.time() - began < 100
    with pytest.raises(ValueError, match="unknown"):
        runner.start(spark, sf_dir, out, ["cruce", "nothing"])
    assert runner.start(spark, sf_dir, str(tmp_path / "b"), ["cruce"], queries).wait().status == "ok"


def _sleepy(batches):
    for b in batches:
        for _ in range(600):
            time.sleep(0.1)
        yield b


def test_plans_do_not_run_as_they_are_built(spark, sf_dir):
    spark.sparkContext.setJobGroup("building", "building")
    from kestrane.plans.analytics import metrics

    metrics(spark, sf_dir)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8  # reading the footers of the tables


def test_modules_can_be_imported_alone():
    import subprocess
    import sys

    for name in ("analytics", "read_api", "runner", "loads"):
        subprocess.run([sys.executable, "-c", f"import kestrane.plans.{name}"], check=True, timeout=120)
