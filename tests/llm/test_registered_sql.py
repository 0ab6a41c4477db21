from __future__ import annotations

import duckdb
import pytest
from docweave.llm import registry

TABLES = "documents pages benchmark labels embeddings conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        found = con.sql(registry.oracle_sql()[name])
        assert sorted(found.columns) == names
        order = [found.columns.index(c) for c in names]
        want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want
