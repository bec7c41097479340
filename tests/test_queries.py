"""The engine's queries against the same SQL in another engine, on the shared tables."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_all(spark):
    from millrace.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")

    def plain(v):
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else list(v) if isinstance(v, (list, tuple)) else v

    for name, query in QUERIES.items():
        df = query(spark, SF)
        want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr), name


def test_flagship_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c_mktsegment", "o_orderpriority", "revenue", "lines"]
