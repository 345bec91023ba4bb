"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
import os

import duckdb
import pytest

from loomframe import catalogue
from loomframe.plans.relations import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, str | bool) else float(v) if not isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([tuple(map(plain, r)) for r in df.select(*names).collect()], key=repr)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    order = sorted(range(len(found.description)), key=lambda k: found.description[k][0])
    assert [found.description[k][0] for k in order] == names
    want = sorted([tuple(plain(r[k]) for k in order) for r in found.fetchall()], key=repr)
    assert len(got) == len(want)
    assert got == want
