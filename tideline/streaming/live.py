"""Bars with a watermark and ratings with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import safe_div
from tideline.operators.elo import EloRules, entering, step
from tideline.session import ship_package


def streaming_bars(ticks: DataFrame, size: str, late: str, seq: str = "event_id") -> DataFrame:
    """bars() for a stream: a bar is emitted once the watermark passes its end; ticks later than `late` don't count."""
    at, p, q = F.struct("ts", seq), F.col("ref_price"), F.col("size")
    rows = ticks.withWatermark("ts", late).groupBy("market", F.window("ts", size))
    out = rows.agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum(q).alias("volume"), F.count("*").alias("n_trades"), safe_div(F.sum(p * q), F.sum(q)).alias("vwap"))
    return out.select("market", F.col("window.start").alias("bar_start"), *[c for c in out.columns if c not in ("market", "window")])


def streaming_elo(games: DataFrame, rules: EloRules = EloRules()) -> DataFrame:
    """game_id, elo_home, elo_away per arriving game, with the ratings of each league as state.

    Within a micro-batch games are taken in order of (game_date, game_id); a game that arrives after later ones is rated on what
    stands then. games: league, game_id, game_date, season_id, home, away, pts_home, pts_away.
    """
    ship_package(games.sparkSession)
    lean = games.select("league", "game_id", "game_date", "season_id", "home", "away", (F.col("pts_home") - F.col("pts_away")).cast("double").alias("margin"))

    def update(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        teams, values, seasons = state.get if state.exists else ([], [], [])
        ratings, played = dict(zip(teams, values, strict=True)), dict(zip(teams, seasons, strict=True))
        rows = pd.concat(list(batches)).sort_values(["game_date", "game_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            home, away, season = int(r.home), int(r.away), int(r.season_id)
            h, a = entering(ratings, played, home, season, rules), entering(ratings, played, away, season, rules)
            out.append((r.game_id, h, a))
            d = step(h, a, r.margin, rules)
            ratings[home], ratings[away] = h + d, a - d
        state.update((list(ratings), list(ratings.values()), [played[t] for t in ratings]))
        yield pd.DataFrame(out, columns=["game_id", "elo_home", "elo_away"])

    return lean.groupBy("league").applyInPandasWithState(update, "game_id long, elo_home double, elo_away double", "teams array<int>, ratings array<double>, seasons array<int>", "append", "NoTimeout")
