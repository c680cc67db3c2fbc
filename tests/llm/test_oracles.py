import os

import duckdb
import pytest

from glintdex.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    duck = duckdb.connect()
    for t in os.listdir(sf):
        duck.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b.astype(a.dtypes.to_dict()))
