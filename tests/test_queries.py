"""Each query of the catalog against its SQL over small tables."""

import math
from pathlib import Path

import pytest

from corpuscope.plans import catalog

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


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.Q[name](spark, SF)
    found = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(value, r)) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in found.fetchall())


def test_every_query_has_sql_or_a_test():
    assert set(catalog.Q) - set(catalog.SQL) == {"featurize_log", "serve_log"}


def test_featurized_log(spark):
    rows = catalog.featurize_log(spark, SF).collect()
    assert rows and all(len(r.features) == 50 and r.features[49] == 1.0 for r in rows)
    assert len({r.uniq_key for r in rows}) == len(rows)


def test_served_log(spark):
    rows = catalog.serve_log(spark, SF).collect()
    assert {r.status for r in rows} <= {200, 404} and all((r.isSlowQuery is None) == (r.status != 200) for r in rows)


def test_flagship(spark):
    df = catalog.flagship(spark, SF)
    assert df.count() > 0 and {r.label for r in df.select("label").distinct().collect()} <= {0, 1}


def test_no_python_in_relational_plans(spark):
    for name in ("dedup_median", "knee", "threshold_sweep", "misclassified", "ensemble_vote", "feature_norm", "log_valid_rows"):
        plan = catalog.Q[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
