"""Every query with SQL equals DuckDB's result on the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tools.check_oracles import compare

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    fn, sql = contract.queries()[name], contract.oracle_sql()[name]
    status, detail, _ = compare(spark, SMALL, name, fn, sql)
    assert status == "ok", detail


def test_entry(spark):
    assert contract.entry(spark).count() > 0
