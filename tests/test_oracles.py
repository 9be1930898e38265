"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from weftline.plans import catalog

duckdb = pytest.importorskip("duckdb")


def cell(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, oracle):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    found = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.oracles():
        assert found
        return
    result = oracle.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert found == sorted(tuple(cell(r[i]) for i in place) for r in result.fetchall())
