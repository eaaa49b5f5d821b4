"""Registered queries against their checking SQL on the smallest data set.

All of them are compared by `python -m strideframe.checks.compare DIR`; here the quick ones are.
"""

import os

import pytest

import __spark_entry__ as registered
from strideframe.checks.compare import connection, difference

SF_DIR = "/root/testdata/sf0.001"
QUICK = ("d0", "f06", "f08", "f16", "x", "u01", "a07", "a09", "a10", "a11", "a12", "a14", "a15", "a22", "a26_corr",
         "a28", "a29_box", "a30", "w01_rolling_std_orders", "w02", "w03_forward", "w04", "w06", "w08", "w10", "j06",
         "j07", "j08", "k0", "s14", "s15")
NAMES = [n for n in registered.queries() if n.startswith(QUICK) and n != "x22_race_reports"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, name):
    sql = registered.oracle_sql().get(name)
    assert difference(spark, con, SF_DIR, registered.queries()[name], sql) is None


def test_every_relational_query_has_checking_sql():
    assert {n for n in set(registered.queries()) - set(registered.oracle_sql()) if not n.startswith(("op", "pipeline"))} == set()


def test_entry_has_rows(spark):
    assert registered.entry(spark).columns == ["o_custkey", "period_end", "spent"]
