"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from clausegraph.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(str([value(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registered()[0]))
def test_query(spark, sf, duck, name):
    found = registered()[0][name](spark, sf).toPandas()
    if name in registered()[1]:
        want = duck.execute(registered()[1][name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
