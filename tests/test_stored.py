"""Stored upserts and incremental windows against full rebuilds."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.operators.form import rolling_form
from tideline.sources import stored

SCHEMA = "k int, part string, v long, note string"


def _files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet")}


def _rows(table, spark):
    return {(r.k, r.part): (r.v, r.note) for r in table.read(spark).collect()}


def test_batches_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    table = stored.Stored(f"file://{tmp_path}/t", SCHEMA, ("k", "part"), buckets=8)
    assert _rows(table, spark) == {}
    want = {}
    for step in range(6):
        batch = {(rng.randrange(30), rng.choice(["x", None])): (rng.randrange(100), rng.choice(["n", None])) for _ in range(rng.choice([1, 12]))}
        df = spark.createDataFrame([(*k, *v) for k, v in batch.items()], SCHEMA)
        if step % 3 == 0:
            table.replace(df)
            table.replace(df)  # twice changes nothing
            want |= batch
        elif step % 3 == 1:
            table.ignore(df)
            want = batch | want
        else:
            table.update(df.where("part IS NOT NULL"), "v")
            want |= {k: (v[0], want[k][1]) for k, v in batch.items() if k in want and k[1] is not None}
        assert _rows(table, spark) == want
    assert table.replace(df.where("false")) == []


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = stored.Stored(f"file://{tmp_path}/t", SCHEMA, ("k", "part"), buckets=16)
    table.replace(spark.range(500).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("part"), "id", F.lit("n").alias("note")).withColumnRenamed("id", "v"))
    before = _files(tmp_path / "t")
    touched = table.replace(spark.createDataFrame([(3, "x", -1, "new")], SCHEMA))
    after = _files(tmp_path / "t")
    assert len(touched) == 1 and len(before - after) == 1 and {f.split("/")[0] for f in before ^ after} == {f"bucket={touched[0]}"}
    assert _rows(table, spark)[3, "x"] == (-1, "new") and table.read(spark).count() == 500


@pytest.mark.parametrize("whole", [True, False])
def test_changes_cut_short(spark, tmp_path, monkeypatch, whole):
    """A change that was written whole is applied by whoever comes next; one that was not leaves the table as it was."""
    table = stored.Stored(f"file://{tmp_path}/t", SCHEMA, ("k", "part"), buckets=4)
    table.replace(spark.createDataFrame([(1, "x", 1, "old"), (2, "x", 2, "old")], SCHEMA))
    finish = stored.Stored.finish
    monkeypatch.setattr(stored.Stored, "finish", lambda self, spark: None)
    table.replace(spark.createDataFrame([(1, "x", 9, "new")], SCHEMA))
    monkeypatch.setattr(stored.Stored, "finish", finish)
    if not whole:
        (tmp_path / "t" / stored.PENDING / "_SUCCESS").unlink()
    assert _rows(table, spark) == {(1, "x"): (9, "new") if whole else (1, "old"), (2, "x"): (2, "old")}
    assert not (tmp_path / "t" / stored.PENDING).exists()


@pytest.mark.parametrize("seed", range(2))
def test_extended_windows_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i // 4), rng.randrange(5), rng.random() < 0.5, rng.randrange(80, 120), 100, 1, rng.randrange(20, 40), 80, 9, rng.choice([0, 12])) for i in range(240)]
    df = spark.createDataFrame(rows, "game_id int, game_date date, team int, is_home boolean, pts int, opp_pts int, win int, fgm int, fga int, ftm int, fta int")
    cuts = sorted(rng.sample(range(240), 4))
    tail, got = df.limit(0), []
    for a, b in zip([0, *cuts], [*cuts, 240], strict=True):
        new = df.where(f"game_id >= {a} AND game_id < {b}")
        assert stored.late_rows(tail, new, ["team", "is_home"], ["game_date", "game_id"]).count() == 0
        made, tail = stored.extend(tail, new, ["team", "is_home"], ["game_date", "game_id"], 6, lambda x: rolling_form(x, (3, 6)))
        tail = spark.createDataFrame(tail.collect(), df.schema)
        got += made.collect()
    want = rolling_form(df, (3, 6)).collect()
    assert sorted(got) == sorted(want)
    assert tail.groupBy("team", "is_home").count().agg(F.max("count")).collect()[0][0] == 6
    late = df.where("game_id IN (5, 239)").withColumn("game_id", F.when(F.col("game_id") == 239, 1000).otherwise(5))
    assert [r.game_id for r in stored.late_rows(tail, late, ["team", "is_home"], ["game_date", "game_id"]).collect()] == [5]
