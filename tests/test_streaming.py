"""Streaming twins against their batch operators."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tideline.operators import elo, market
from tideline.streaming import live


def _run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_bars_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, t0 + dt.timedelta(seconds=20 * i), round(rng.random(), 3), i % 9 + 1, "BUY", True, i) for i in range(200)]
    schema = "market long, ts timestamp, price double, size long, side string, is_ref boolean, event_id long"
    batch = market.normalise(spark.createDataFrame(rows, schema))
    for k in range(4):  # one file a micro-batch, in time order
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    stream = market.normalise(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks"))
    got = {(r.market, r.bar_start): (r.open, r.high, r.low, r.close, r.volume, r.n_trades) for r in _run(live.streaming_bars(stream, "5 minutes", "1 minute"), spark, "bars")}
    want = {(r.market, r.bar_start): (r.open, r.high, r.low, r.close, r.volume, r.n_trades) for r in market.bars(batch, "5 minutes").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 6  # only bars that the watermark has not passed are missing


def test_elo_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        h, a = rng.sample(range(6), 2)
        rows.append(("x" if i % 2 else "y", i, dt.date(2020, 1, 1) + dt.timedelta(days=i), 1 + i // 30, h, a, rng.randrange(80, 120), rng.randrange(80, 120)))
    schema = "league string, game_id long, game_date date, season_id int, home int, away int, pts_home long, pts_away long"
    games = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/games")
    files = sorted((tmp_path / "games").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for k, f in enumerate(files):
        import os

        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/games")
    got = {r.game_id: (round(r.elo_home, 9), round(r.elo_away, 9)) for r in _run(live.streaming_elo(stream), spark, "ratings")}
    want = {r.game_id: (round(r.elo_home, 9), round(r.elo_away, 9)) for r in elo.elo_ratings(games, league="league").collect()}
    assert got == want
    assert games.select(F.count("*")).collect()[0][0] == len(got)


def test_dips_of_a_stream(spark, tmp_path):
    """Ticks shuffled within the lateness, in micro-batches, and some far too late: the last row of each dip is that of the batch operator."""
    from tideline.streaming import dips

    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    price = {m: 0.5 for m in range(3)}
    rows = []
    for i in range(600):
        m = i % 3
        price[m] = min(0.99, max(0.01, price[m] + rng.choice([-0.06, 0.05])))
        rows.append((m, t0 + dt.timedelta(seconds=20 * i), round(price[m], 3), i))
    schema = "market long, ts timestamp, ref_price double, event_id long"
    blocks = [rows[k : k + 60] for k in range(0, 600, 60)]
    for k, block in enumerate(blocks):
        block = rng.sample(block, len(block))
        if k == 7:
            block.append((0, t0, 0.001, 9999))  # two hours late
        if k == 9:
            block.append((9, t0 + dt.timedelta(days=1), 0.5, 10_000))  # pushes the watermark past all bars
        spark.createDataFrame(block, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    import os

    for k, f in enumerate(sorted((tmp_path / "ticks").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    seen = []

    def keep(batch, number):
        seen.extend((number, r) for r in batch.collect())

    q = dips.streaming_dips(stream, 300, "25 minutes", (0.2, 0.4)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset(provider)
    got = {(r.market, r.side, r.p): (r.cross_ts, r.trough, r.trough_ts, r.max_high, r.max_high_after_trough) for _, r in seen}
    batch = market.both_perspectives(market.bars(spark.createDataFrame([(*r[:3], 1, True, r[3]) for r in rows], "market long, ts timestamp, ref_price double, size long, is_ref boolean, event_id long"), "5 minutes"))
    want = {(r.market, r.side, r.p): (r.cross_ts, r.trough, r.trough_ts, r.max_high, r.max_high_after_trough) for r in market.dips(batch, (0.2, 0.4)).collect()}
    assert want and got == want
