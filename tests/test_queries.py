"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import meshline.plans.cache_queries  # noqa: F401  (registers)
import meshline.plans.entry_queries  # noqa: F401  (registers)
import meshline.plans.label_queries  # noqa: F401  (registers)
import meshline.plans.layout_queries  # noqa: F401  (registers)
import meshline.plans.nearby_queries  # noqa: F401  (registers)
import meshline.plans.path_queries  # noqa: F401  (registers)
import meshline.plans.scene_queries  # noqa: F401  (registers)
import meshline.plans.shape_queries  # noqa: F401  (registers)
from meshline.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
