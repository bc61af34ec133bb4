import pytest

import __spark_entry__ as entry

from . import oracle

SQL = entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op")])
def test_query_equals_its_sql(name, spark, con, sf_dir):
    columns, rows = oracle.of_spark(entry.queries()[name](spark, sf_dir))
    want_columns, want = oracle.of_sql(con, SQL[name])
    assert columns == want_columns
    assert rows == want
    assert rows, "an empty result tests nothing"


def test_every_query_is_registered():
    assert set(SQL) <= set(entry.queries()) and len(entry.queries()) >= 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_schools_are_registered(spark, sf_dir):
    q = entry.queries()
    for name in ("score_series_melt", "metrics_by_school", "active_alerts", "scores_by_grade", "grades_by_grade"):
        assert q[f"{name}_all"](spark, sf_dir).select("rbd").distinct().count() > 1
