"""Every registered query runs, and agrees with its SQL where it has one."""

import datetime
import os

import duckdb
import pytest

from sparkveil.plans import registry


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    cur = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("name", "keys"),
    [
        ("identifier_spans", [16, 391476, 391513, 899967]),  # telephone numbers that begin with 91
        ("context_spans", [8, 9, 538292, 538293, 1438292]),  # a repair that repeats its value
    ],
)
def test_keys_of_larger_tables(spark, tmp_path, name, keys):
    duckdb.execute(f"COPY (SELECT unnest({keys})::BIGINT AS c_custkey) TO '{tmp_path}/customer.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    line = lambda r: "|".join(map(plain, r))
    assert sorted(map(line, df.collect())) == sorted(map(line, want))
