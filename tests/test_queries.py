"""Every query of the graph engine against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tracelode.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def comparable(v):
    return float(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(tuple(comparable(r[c]) for c in cols) for r in got.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(comparable(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert rows == want


def test_packets_are_json(spark, sf_dir):
    import json

    got = catalogue.queries()["packet_json"](spark, sf_dir).limit(5).collect()
    assert got and all("files" in json.loads(r["packet"]) for r in got)


def test_all_operators_are_listed():
    assert set(SQL) <= set(catalogue.queries())
