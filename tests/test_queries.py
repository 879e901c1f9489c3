"""Each registered query against its DuckDB SQL on the smallest tables; those without SQL must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from lakeloom.plans import ORACLE_SQL, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(FOLDER.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, str(FOLDER))
    found = df.collect()
    if name not in ORACLE_SQL:
        assert found
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, result.fetchall())
    got = rows(df.columns, found)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if g != w][:3] == []


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
