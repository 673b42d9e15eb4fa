"""Every registered query with SQL against DuckDB on the smallest given tables, and the driver's contract."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tideline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, duck, name):
    q = registry()[name]
    df = q.build(spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if q.sql is None:
        return
    result = duck.sql(q.sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3])


def test_driver_contract(spark):
    import __spark_entry__ as entry

    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and set(registry()) <= names
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).limit(1).count() == 1


def test_rest_stands_alone():
    """Nothing outside tideline/llm, tests/llm, corpus_pipeline.py and the guard in __spark_entry__.py names that subpackage."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in [*root.glob("tideline/**/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts and f.exists():
            assert "tideline.llm" not in f.read_text(), f
