"""Every query that SQL can say against the same SQL on another engine, and every other one for rows of a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
CORE = {n: q for n, q in entry.queries().items() if not n.startswith(("p1_", "p2_", "p3_", "p6_", "p7_", "p8_"))}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in CORE if n in SQL))
def test_same_as_sql(spark, data, duck, name):
    df = CORE[name](spark, data)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
