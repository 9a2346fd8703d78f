"""Every query of the library against its DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from runweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


#: Choices one after another, open circuits and snippets by form: tested against brute force in test_sequential.
SEQUENTIAL = {"k7_diversify", "x4_circuit_stream", "t1_locate", "t2_closest_regions"}


def test_every_query_has_an_oracle():
    assert set(registry.queries()) - SEQUENTIAL == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
