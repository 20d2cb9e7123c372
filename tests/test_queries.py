"""Every query with SQL against DuckDB, over whole tables."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from quiltwork.plans import exports, project_files, shapes, streams  # noqa: F401
from quiltwork.plans.assembly import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in found.collect()], key=str)
    assert got
    if name in ORACLE_SQL:
        answer = duck.sql(ORACLE_SQL[name])
        assert sorted(answer.columns) == columns
        order = [answer.columns.index(c) for c in columns]
        assert got == sorted([tuple(plain(r[i]) for i in order) for r in answer.fetchall()], key=str)
