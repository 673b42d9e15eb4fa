"""Queries on games of late seasons: nothing may be cut off, however far the table reaches."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from test_queries import plain

from tideline.plans import registry
from tideline.sources.views import DAYS_PER_SEASON, PER_DAY

#: Days of the seasons 22000, 22004 and 22170.
DAYS = [DAYS_PER_SEASON * s + d for s in (0, 4, 170) for d in range(6)]


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """A folder with orders only, as all these queries read games."""
    path = tmp_path_factory.mktemp("late")
    rows = [(d * PER_DAY + s, float(1000 + (d * 7919 + s * 104729) % 90001) + 0.25) for d in DAYS for s in range(PER_DAY)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"file://{path}/orders.parquet")
    return str(path)


def _whole(spark, late, name):
    """The query's rows, which must be those of its statement."""
    q = registry()[name]
    df = q.build(spark, f"file://{late}")
    columns = sorted(df.columns)
    rows = df.collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{late}/orders.parquet/*.parquet'")
    result = con.sql(q.sql)
    at = [result.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == want, (list((got - want).elements())[:3], list((want - got).elements())[:3])
    return rows


@pytest.mark.parametrize("name", ["standings_panel", "clinch_and_pressure", "preferred_opponent", "motivation_score"])
def test_standings_of_all_seasons(spark, late, name):
    assert Counter(r.season_id for r in _whole(spark, late, name)) == {s: 6 * 30 for s in (22000, 22004, 22170)}


@pytest.mark.parametrize("name", ["absence_streaks", "freshest_absence"])
def test_absences_of_all_seasons(spark, late, name):
    last = DAYS[-1] * PER_DAY
    assert any(r.game_id >= last for r in _whole(spark, late, name))


def test_calibration_of_all_seasons(spark, late):
    games = [d * PER_DAY + s for d in DAYS for s in range(PER_DAY)]
    rows = _whole(spark, late, "calibration_deltas")
    assert sum(r.n_missing for r in rows) == 2 * 2 * sum(g % 4 == 0 for g in games)  # two sides, two metrics


def test_date_spine_of_all_seasons(spark, late):
    assert Counter(r.season_id for r in _whole(spark, late, "date_spine")) == {s: 6 * 30 for s in (22000, 22004, 22170)}
