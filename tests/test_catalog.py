"""Every query with SQL must give the same rows as the SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import canonical

SF_DIR = "/root/testdata/sf0.01"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_plans_have_no_python(spark):
    for name in ("item_stats", "A19_item_table", "R1_wide_to_long", "B11_label_tags", "M4_student_school_table"):
        plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
