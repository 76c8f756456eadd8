"""Each further query against its SQL over small tables."""

import math
from pathlib import Path

import pytest

from corpuscope.plans import records

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def value(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(records.SQL))
def test_query_equals_sql(spark, duck, name):
    df = records.Q[name](spark, SF)
    found = duck.sql(records.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(value, r)) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in found.fetchall())


def test_featurized_rows_are_parsed_once(spark):
    """The plan over the written evaluations has no Python in it."""
    plan = records.featurized_vectors(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
