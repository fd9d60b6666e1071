"""Every query of the library against its SQL, over the small tables."""

import duckdb
import pytest

from labelweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, sf_dir, duck):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.SQL[name]).df()
    assert rows(got) == rows(want)
    assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(t) for c, t in want.dtypes.items()} or got.empty


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
