"""Text operators that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from loomframe.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*columns).collect())) == sorted(want.fetchall())
