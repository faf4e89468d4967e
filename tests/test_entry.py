import os

import pytest

import __spark_entry__ as entry


def test_names_and_sql_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{i}_found" for i in range(1, 6)} <= set(queries)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "sensor", "slot"] and df.count() > 0
