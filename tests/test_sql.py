"""Every registered query of the reference part, next to its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from papyra.plans import q_functions, q_more, q_relational, q_retrieval  # noqa: F401
from papyra.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
    assert len(mine), "an empty result shows nothing"


def test_all_registered():
    assert len(QUERIES) >= 130 and len(ORACLE) >= len(QUERIES) - 25
