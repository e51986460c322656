"""Every query that has SQL, beside it, on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from folioflow.plans import registry
from tools.compare import arrow_of, canon

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    mine = registry.queries()[name](spark, SF).toArrow().to_pandas()
    other = arrow_of(con.sql(registry.oracle_sql()[name])).to_pandas()
    assert sorted(mine.columns) == sorted(other.columns)
    assert canon(mine) == canon(other)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
