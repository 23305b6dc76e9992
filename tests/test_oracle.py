"""Each registered query of the engine's own operators against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from driftledger.plans import registry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> list:
    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list | tuple):
            return tuple(map(value, x))
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool):
            return x
        return round(float(x), 6) if isinstance(x, int | float) or type(x).__name__ == "Decimal" else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got)
