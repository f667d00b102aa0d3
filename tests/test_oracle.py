"""Every registered query against its DuckDB SQL on the sf0.001 tables."""
import pytest

import __spark_entry__ as E
from tools.oracle_check import canon
from conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    odf = duck.execute(ORACLES[name]).fetchdf()
    sc, sr = canon(sdf)
    oc, orows = canon(odf)
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_model_query_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert len(df.schema.fields) > 0
    assert df.count() >= 0


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert rows and abs(sum(r["Percentage"] for r in rows) - 100) < 0.1
