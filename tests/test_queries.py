"""Every registered query with SQL returns the rows its SQL returns."""

import datetime
import importlib.util
import math
import os

import duckdb
import pytest

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    relation = duck.execute(ORACLE[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    exact = [c for c in order if dict(df.dtypes)[c] != "double"]

    def sort_key(row):
        return ([str(row[c]) for c in exact], [row[c] or 0.0 for c in order if c not in exact])

    got = sorted(({c: plain(r[c]) for c in order} for r in df.collect()), key=sort_key)
    want = sorted(({c: plain(v) for c, v in zip(names, r)} for r in relation.fetchall()), key=sort_key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(close(g[c], w[c]) for c in order), (g, w)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 5 and {"impute", "encode", "log1p", "scale"} <= set(out.columns)
