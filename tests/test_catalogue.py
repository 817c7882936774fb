"""Every catalogue query against its DuckDB equivalent."""

import duckdb
import pandas as pd
import pytest

from verdictflow.plans import catalogue, harness  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_matches_duckdb(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF_DIR).toPandas()
    wanted = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
