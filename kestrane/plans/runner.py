"""Analytics modules that write their tables on their own, one after the other or all at once, and a ledger that tells how it went."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import QUERIES

#: Modules by name: the queries whose tables they write.
MODULES = {
    "simce_serie": ("score_series_all",), "simce_tendencia": ("trend_full_excl_hiatus", "trend_post_hiatus"), "simce_percentil": ("percentile_records",),
    "sige_serie": ("grade_series", "trend_grades"), "cruce": ("cross_gap", "cross_correlation")}
LEDGER = "run_id string, module string, status string, message string, at timestamp"


@dataclass
class Run:
    """What a run did: its id, the written paths and the errors by module."""

    run_id: str
    paths: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "error" if self.errors else "ok"


def run(spark: SparkSession, sf_dir: str, out: str, modules: Sequence[str] = tuple(MODULES), queries: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None) -> Run:
    """Write the modules' tables under `out`; a module that fails does not stop the others. Unknown names are errors.

    The ledger gets an event for each module as the run starts, and one with its outcome.
    """
    told, known = Run(uuid.uuid4().hex), queries or QUERIES
    _record(spark, out, [(told.run_id, m, "running", None) for m in modules])
    for name in modules:
        _module(spark, sf_dir, out, name, known, told)
    _record(spark, out, [(told.run_id, m, "error" if m in told.errors else "ok", told.errors.get(m)) for m in modules])
    return told


def _module(spark: SparkSession, sf_dir: str, out: str, name: str, known: dict[str, Callable[[SparkSession, str], DataFrame]], told: Run) -> None:
    """Write the tables of one module; its error is told, not raised: the others are independent."""
    try:
        for q in MODULES[name]:
            path = f"{out}/{q}"
            known[q](spark, sf_dir).write.mode("overwrite").parquet(path)
            told.paths[q] = path
    except Exception as e:  # noqa: BLE001
        told.errors[name] = f"{type(e).__name__}: {e}".splitlines()[0][:500]


@dataclass
class Running:
    """A run whose modules go on at the same time: what it has done so far is in `told`."""

    spark: SparkSession
    told: Run
    threads: list[threading.Thread] = field(default_factory=list)
    stopped: threading.Event = field(default_factory=threading.Event)

    @property
    def run_id(self) -> str:
        return self.told.run_id

    def wait(self, seconds: float | None = None) -> Run:
        """What the run did, once all modules have ended, or after so many seconds what they did so far."""
        for t in self.threads:
            t.join(seconds)
        return self.told

    def cancel(self) -> None:
        cancel(self.spark, self.run_id)


_running: dict[str, Running] = {}


def start(spark: SparkSession, sf_dir: str, out: str, modules: Sequence[str] = tuple(MODULES), queries: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None, at_once: int = 4) -> Running:
    """Begin a run and return at once; at most `at_once` modules go on at the same time, each in a thread with the run's tag on its jobs.

    Names of modules that are not known raise ValueError before anything runs. `status` tells
    each module as waiting, running, ok, error or cancelled.
    """
    if unknown := sorted(set(modules) - MODULES.keys()):
        raise ValueError(f"unknown modules {unknown}; there are {sorted(MODULES)}")
    run_ = Running(spark, Run(uuid.uuid4().hex))
    known, slots = queries or QUERIES, threading.Semaphore(at_once)
    _record(spark, out, [(run_.run_id, m, "waiting", None) for m in modules])

    def work(name: str) -> None:
        with slots:
            if not run_.stopped.is_set():
                spark.sparkContext.addJobTag(run_.run_id)
                _record(spark, out, [(run_.run_id, name, "running", None)])
                _module(spark, sf_dir, out, name, known, run_.told)
                spark.sparkContext.removeJobTag(run_.run_id)
        error = run_.told.errors.get(name)
        if run_.stopped.is_set() and (error or not all(q in run_.told.paths for q in MODULES[name])):
            run_.told.errors[name], state = "cancelled", "cancelled"
        else:
            state = "error" if error else "ok"
        _record(spark, out, [(run_.run_id, name, state, error)])

    run_.threads = [InheritableThread(target=work, args=(m,), daemon=True) for m in modules]
    _running[run_.run_id] = run_
    for t in run_.threads:
        t.start()
    return run_


def cancel(spark: SparkSession, run_id: str) -> None:
    """Stop a run that `start` began: its jobs end, and modules that have not begun do not begin."""
    if run_id in _running:
        _running[run_id].stopped.set()
    spark.sparkContext.cancelJobsWithTag(run_id)


def _record(spark: SparkSession, out: str, events: list[tuple]) -> None:
    rows = spark.createDataFrame(events, "run_id string, module string, status string, message string")
    # a folder of its own: writers that append to one folder at the same time remove each other's files
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(f"{out}/_ledger/event={uuid.uuid4().hex}")


def store_metrics(spark: SparkSession, sf_dir: str, out: str, files: int | None = None) -> str:
    """Write the table of all metrics, worked out once, by ranges of schools; gives its path.

    Within a file rows are sorted by school, so that a read of one school skips all files and
    row groups whose range of schools does not hold it.
    """
    from .analytics import Facts, metrics

    m, path = metrics(spark, sf_dir, Facts(spark, sf_dir, stored=True)), f"{out}/metrics"
    dealt = m.repartitionByRange(files, "rbd") if files else m.repartitionByRange("rbd")
    dealt.sortWithinPartitions("rbd").write.mode("overwrite").parquet(path)
    return path


def stored_metrics(spark: SparkSession, out: str) -> DataFrame:
    """The table that `store_metrics` wrote."""
    from .analytics import METRIC_COLUMNS

    return spark.read.schema(", ".join(f"{c} {t}" for c, t in METRIC_COLUMNS.items())).parquet(f"{out}/metrics")


def status(spark: SparkSession, out: str, run_id: str) -> DataFrame:
    """(module, status, message) of a run, as last recorded."""
    events = spark.read.schema(LEDGER).parquet(f"{out}/_ledger").filter(F.col("run_id") == run_id)
    return events.groupBy("module").agg(F.max_by(F.struct("status", "message"), "at").alias("x")).select("module", "x.*")


def health(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1
