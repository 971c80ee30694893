"""Every registered query of the library with SQL, side by side with DuckDB."""

import pytest

from siftwell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_duckdb(name, same_as_duckdb):
    same_as_duckdb(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    df.collect()
