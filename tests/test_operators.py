"""Operators on small hand-made tables with worked expectations."""

from __future__ import annotations

import datetime as dt
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import asof, elo, evaluate, form, health, market, neighbours, pairs, players, ranks, standings, style, tables
from tideline.operators.windows import by, centred, with_streak
from tideline.sources import sinks
from tideline.sources.views import STYLE, perspective

D = dt.date


def _games(spark, rows, season=22000):
    """rows: (day, home, away, pts_home, pts_away[, season])."""
    full = [(i, D(2020, 1, 1) + dt.timedelta(days=r[0]), r[5] if len(r) > 5 else season, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "game_id long, game_date date, season_id int, home int, away int, pts_home long, pts_away long")


def _value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0].x


# --- columns -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("id_", "text"), [(22011, "2011-12"), (21946, "1946-47"), (21999, "1999-00"), (22008, "2008-09")])
def test_season_ids(spark, id_, text):
    assert _value(spark, C.season_id_to_text(F.lit(id_), 2028)) == text
    assert _value(spark, C.season_text_to_id(F.lit(text), 2028)) == id_


@pytest.mark.parametrize("bad", [32011, 2011, 220117, 21940, 22031])
def test_bad_season_ids(spark, bad):
    assert _value(spark, C.season_id_to_text(F.lit(bad), 2028)) is None


@pytest.mark.parametrize("bad", ["2011", "2011-13", "2011-2012", "11-12", "1940-41", "2031-32", "what-so", ""])
def test_bad_season_texts(spark, bad):
    assert _value(spark, C.season_text_to_id(F.lit(bad), 2028)) is None


def test_season_of_dates(spark):
    assert _value(spark, C.season_of(F.lit(D(2023, 10, 1)))) == "2023-24"
    assert _value(spark, C.season_of(F.lit(D(2000, 9, 30)))) == "1999-00"


def test_scalars(spark):
    assert _value(spark, C.safe_div(F.lit(1), F.lit(0))) is None
    assert _value(spark, C.clip(F.lit(5.0), 0, 1)) == 1 and _value(spark, C.clip(F.lit(None).cast("double"), 0, 1)) is None
    for z in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert _value(spark, C.normal_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)
    assert _value(spark, C.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 3958.8)
    assert _value(spark, C.half_even(F.lit(0.125), 2)) == 0.12
    assert _value(spark, C.normal_name(F.lit("  Luka  Dončić Jr. "))) == "luka doncic"
    assert len(C.ACCENTED) == len(C.FOLDED)
    assert _value(spark, C.flip_name(F.lit("James, LeBron"))) == "LeBron James"
    assert _value(spark, C.spread_line(F.lit("Spread: Lakers (-4.5)"))) == -4.5 and _value(spark, C.spread_line(F.lit("no line"))) is None
    assert _value(spark, C.totals_line(F.lit("A vs. B: O/U 221.5"))) == 221.5
    assert _value(spark, C.first_timestamp(F.lit("later"), F.lit("2024-01-02 03:04:05"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert _value(spark, C.matching_outcome(F.array(F.lit("LA Lakers"), F.lit("Celtics")), F.lit("celtics "))) == 1
    assert _value(spark, C.matching_outcome(F.array(F.lit("LA Lakers")), F.lit("Bulls"))) is None
    assert _value(spark, C.first_argmax(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.5)))) == 1
    assert _value(spark, C.clip_impact(F.lit(-30.0), F.lit(12.0), F.lit(20.0))) == -12
    assert _value(spark, C.absence_decay(F.lit(1000), 10.0)) == 0.1


@pytest.mark.parametrize(("reason", "kind"), [("Torn left ACL; sprain", "severe"), ("ankle SPRAIN, sore", "moderate"), ("Rest", "minor"), ("Fractured hand", "minor"), (None, "minor")])
def test_severity_order(spark, reason, kind):
    assert _value(spark, C.severity(F.lit(reason).cast("string"))) == kind


def test_ranks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None)], "g string, x double")
    got = sorted(r.p for r in rows.select(C.rank_pct(F.col("x"), "g").alias("p")).collect() if r.p is not None)
    assert got == [0.25, 0.625, 0.625, 1.0]
    for n in (4, 10, 11, 37):
        import pandas as pd

        want = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=False).tolist()
        assert [r.q for r in spark.range(1, n + 1).select(C.quartile(F.col("id"), F.lit(n)).alias("q")).collect()] == want


def test_decayed_means_with_gaps(spark):
    rng = random.Random(1)
    xs = [None if rng.random() < 0.2 else rng.random() for _ in range(150)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i int, x double")
    got = {r.i: r.x for r in C.decayed_means(df, ["x"], ["k"], ["i"], 37, 5.0).collect()}
    for i in range(len(xs)):
        past = [(x, 0.5 ** ((i - 1 - j) / 5.0)) for j, x in enumerate(xs[:i]) if j >= i - 37 and x is not None]
        want = sum(x * w for x, w in past) / sum(w for _, w in past) if past else None
        assert got[i] == (pytest.approx(want) if want is not None else None)


# --- windows -------------------------------------------------------------------------------------------------------------


def test_volume_weighted_shooting(spark):
    g = _games(spark, [(i, 100, 200 + i, 100, 90) for i in range(4)])
    made = {0: (10, 20), 1: (1, 1), 2: (10, 20), 3: (5, 9)}
    shots = spark.createDataFrame([(i, m, a, 5, 6) for i, (m, a) in made.items()], "game_id long, fgm long, fga long, ftm long, fta long")
    tg = perspective(g).join(shots, "game_id")
    got = form.rolling_form(tg, (3,)).where("team = 100 AND game_id = 3").collect()[0]
    assert got.fg_pct_l3 == pytest.approx(21 / 41, abs=1e-6) and got.win_pct_l3 == 1


def test_first_game_sees_nothing(spark):
    got = form.rolling_form(perspective(_games(spark, [(0, 1, 2, 9, 8)])).withColumns({c: F.lit(1) for c in ("fgm", "fga", "ftm", "fta")}), (5,)).collect()
    assert all(r.win_pct_l5 is None and r.fg_pct_l5 is None for r in got)


def test_rest(spark):
    g = _games(spark, [(0, 1, 2, 9, 8), (1, 1, 3, 9, 8), (3, 1, 2, 9, 8), (4, 1, 3, 9, 8)])
    got = {r.game_id: r for r in form.rest(perspective(g), ["team", "is_home"]).where("team = 1").collect()}
    assert [got[i].rest_days for i in range(4)] == [3, 1, 2, 1]
    assert [got[i].back_to_back for i in range(4)] == [0, 1, 0, 1]
    assert [got[i].fourth_in_four for i in range(4)] == [0, 0, 0, 1]


def test_streaks_and_medians(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate([True, True, False, True, False, False, True])], "i int, out boolean").withColumn("k", F.lit(1))
    got = with_streak(df, F.col("out"), ["k"], ("i",), "s").orderBy("i").collect()
    assert [r.s for r in got] == [1, 2, 0, 1, 0, 0, 1]
    x = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 1.0, 9.0, 2.0])], "k int, i int, v double")
    few = market.robust_minimum(_ticks(spark, [(i, p, 1) for i, p in enumerate([0.5, 0.2, 0.4, 0.3])])).collect()[0]
    import pandas as pd

    assert few.robust_min == pytest.approx(pd.Series([0.5, 0.2, 0.4, 0.3]).rolling(4, min_periods=1, center=True).median().min())
    med = x.select("i", F.percentile("v", F.lit(0.5)).over(centred(by("k", order=("i",)), 3)).alias("m")).orderBy("i").collect()
    assert [r.m for r in med] == [3.0, 5.0, 2.0, 5.5]


# --- pairs and standings -------------------------------------------------------------------------------------------------


def test_head_to_head_is_symmetric(spark):
    g = _games(spark, [(0, 1, 2, 100, 90), (5, 2, 1, 80, 90), (9, 1, 2, 95, 100), (12, 2, 1, 100, 99)])
    rows = pairs.head_to_head(g).orderBy("game_id").collect()
    assert [r.margin_all for r in rows] == [None, -10.0, 10.0, pytest.approx(-5.0)]
    assert [r.a2_score for r in rows][0] == 0.0
    assert rows[3].win_rate_l5 == pytest.approx(1 / 3)
    v = pairs.venue_splits(g).orderBy("game_id").collect()
    assert (v[2].win_pct_here, v[2].win_pct_there) == (1.0, 1.0)
    assert (v[3].win_pct_here, v[3].win_pct_there) == (0.0, 0.5)


def test_three_season_bound(spark):
    g = _games(spark, [(0, 1, 2, 100, 90, 22000), (400, 1, 2, 80, 90, 22003), (800, 1, 2, 95, 90, 22004)])
    assert [r.recent_win_pct for r in pairs.recent_seasons_win_pct(g).orderBy("game_id").collect()] == [None, 1.0, 0.0]


def test_round_robin_standings(spark):
    g = _games(spark, [(0, 1, 2, 9, 8), (0, 3, 4, 9, 8), (1, 1, 3, 9, 8), (1, 2, 4, 9, 8), (2, 1, 4, 9, 8), (2, 2, 3, 9, 8)])
    tg = perspective(g)
    p = standings.panel(tg, standings.conferences(tg, F.lit("C")))
    m = standings.standings_metrics(p, 2, 1).where("game_date = date '2020-01-03'").collect()
    by_team = {r.team: r for r in m}
    assert [by_team[t].wins for t in (1, 2, 3, 4)] == [2, 1, 1, 0]
    assert sorted(by_team, key=lambda t: by_team[t].seed) == [1, 2, 3, 4]
    assert by_team[1].clinch_ceiling == 0 and by_team[4].clinch_floor == 0
    assert by_team[2].pressure == 1


def test_preferred_opponent_tiers(spark):
    wins = [50, 45, 40, 36, 33, 32, 20, 18, 16, 14, 12, 10, 8, 6, 4]
    rows = [(22000, D(2020, 4, 1), "W", t, i + 1, w, w / (w + 20), 5) for i, (t, w) in enumerate(zip(range(1, 16), wins, strict=True))]
    p = spark.createDataFrame(rows, "season_id int, game_date date, conference string, team int, seed int, wins long, win_pct double, remaining long")
    got = {r.seed: r.preferred_opponent_delta for r in standings.preferred_opponent(p, 20).collect()}
    assert got[1] == pytest.approx(20 / 40 - 18 / 38)
    assert got[8] == pytest.approx(45 / 65 - 50 / 70)
    assert all(got[s] == 0 for s in range(9, 16))
    assert all(r.preferred_opponent_delta == 0 for r in standings.preferred_opponent(p.withColumn("remaining", F.lit(30)), 20).collect())


# --- as-of ---------------------------------------------------------------------------------------------------------------


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", D(2020, 1, 5)), (2, "a", D(2020, 1, 1)), (3, "b", D(2020, 1, 5)), (4, "a", D(2020, 1, 10)), (5, "a", None)], "id int, k string, d date")
    right = spark.createDataFrame([("a", D(2020, 1, 5), 10.0), ("a", D(2020, 1, 3), 7.0), ("a", D(2020, 1, 9), None), ("b", None, 5.0)], "k string, at date, v double")
    one = lambda **kw: {r.id: r.v for r in asof.asof_backward(left, right, ["k"], "d", "at", ["v"], **kw).collect()}
    assert one() == {1: 10.0, 2: None, 3: None, 4: None, 5: None}  # a match whose value is NULL counts
    assert one(lag_days=1) == {1: 7.0, 2: None, 3: None, 4: None, 5: None}
    first = right.where("v = 7")
    assert {r.id: r.v for r in asof.asof_preferring(left, first, right, ["k"], "d", "at", "v").collect()} == {1: 7.0, 2: None, 3: None, 4: 7.0, 5: None}


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(4), rng.randrange(60)) for i in range(150)]
    right = [(rng.randrange(4), t, rng.randrange(1000)) for t in range(0, 60, 2) for _ in range(1)]
    got = {r.id: r.v for r in asof.asof_backward(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "t", "t", ["v"]).collect()}
    for i, k, t in left:
        past = [(u, v) for q, u, v in right if q == k and u <= t]
        assert got[i] == (max(past)[1] if past else None)


def test_active_near(spark):
    left = spark.createDataFrame([(1, "a", D(2020, 3, 1)), (2, "a", D(2020, 9, 1)), (3, "b", D(2020, 3, 1))], "id int, k string, d date")
    seen = spark.createDataFrame([("a", D(2020, 4, 15)), ("a", D(2020, 6, 1))], "k string, seen date")
    assert {r.id for r in asof.active_near(left, seen, "k", "d", "seen", 60).collect()} == {1}


def test_player_average_is_strictly_before(spark):
    stats = spark.createDataFrame([(1, D(2020, 1, i), "PTS", float(i)) for i in range(1, 21)], "player int, stat_date date, stat_name string, stat_value double")
    got = {r.stat_date.day: r.rolling for r in players.rolling(stats, 5).collect()}
    assert got[1] == 0.0 and got[2] == 1.0 and got[20] == 17.0
    assert players.project(stats, "2020-01-21", (5, 10, 20)).collect()[0].projection == pytest.approx((18 + 15.5 + 10.5) / 3, abs=1e-6)


# --- health --------------------------------------------------------------------------------------------------------------


def test_missing_impact_rules(spark):
    dates = spark.createDataFrame([(D(2020, 2, 1), 1), (D(2020, 2, 2), 1)], "game_date date, team int")
    inj = spark.createDataFrame([(D(2020, 2, 1), 1, p, s, "knee") for p, s in ((10, "Out"), (11, "Doubtful"), (12, "Questionable"), (13, "Out"))], "game_date date, team int, player int, status string, reason string")
    impacts = spark.createDataFrame([(10, D(2020, 1, 1), 4.0, 100.0), (10, D(2020, 2, 1), 99.0, 100.0), (11, D(2020, 1, 1), 2.0, 100.0), (12, D(2020, 1, 1), 9.0, 100.0), (13, D(2020, 1, 1), 50.0, 1.0)], "player int, as_of_date date, impact double, minutes double")
    got = {r.game_date.day: (r.missing_impact, r.n_rated) for r in health.missing_impact(dates, inj, impacts).collect()}
    assert got == {1: (pytest.approx(4.0 + 0.8 * 2.0), 2), 2: (0.0, 0)}


def test_name_resolution(spark):
    index = [(1, "José García"), (2, "Jose Garcia Jr."), (3, "Al Horford"), (4, "Bo Diaz"), (5, "Bo  Díaz"), (6, "Cy Young"), (7, "CY. YOUNG"), (8, "..."), (9, "...."), (10, None)]
    reports = [("JOSE  GARCIA", D(2020, 3, 1)), ("JOSE  GARCIA", D(2020, 1, 10)), ("Al Horford", D(2020, 1, 1)), ("Bo Diaz", D(2020, 5, 1)), ("Cy Young", D(2020, 5, 1)), ("Nobody", D(2020, 1, 1)), ("....", D(2020, 1, 1)), (None, D(2020, 1, 1))]
    seen = [(1, D(2020, 3, 11)), (2, D(2020, 3, 10)), (4, D(2019, 1, 1)), (6, D(2020, 4, 1)), (7, D(2020, 6, 1)), (3, D(2010, 1, 1))]
    got = health.resolve_names(
        spark.createDataFrame(reports, "printed string, report_date date"), spark.createDataFrame(index, "player int, full_name string"), spark.createDataFrame(seen, "player int, active_date date")
    )
    assert {r.printed: (r.player, r.method, r.confidence) for r in got.collect()} == {
        "JOSE  GARCIA": (2, "normalized+disambiguated", "medium"),  # 60 days after the first report, the other 61
        "Al Horford": (3, "normalized", "high"),
        "Bo Diaz": (4, "normalized+ambiguous", "low"),  # nobody active
        "Cy Young": (6, "normalized+ambiguous", "low"),  # both
        "Nobody": (None, "unmatched", "none"),
        "....": (9, "exact_fallback", "high"),
        None: (None, "unmatched", "none"),
    }


def test_absence_runs(spark):
    games = spark.createDataFrame([(t, 10 * t + i, D(2020, 1, 1 + i // 2)) for t in (1, 2) for i in range(8)], "team int, game_id int, game_date date")
    out = {(5, 1): [0, 1, 3, 4, 5, 7], (6, 1): [2], (5, 2): [6, 7]}
    rows = [(p, t, 10 * t + i, "Out") for (p, t), v in out.items() for i in v] * 2 + [(6, 1, 13, "Doubtful")]
    runs = health.absence_runs(games, spark.createDataFrame(rows, "player int, team int, game_id int, status string"))
    want = {(5, 10): 1, (5, 11): 2, (5, 13): 1, (5, 14): 2, (5, 15): 3, (5, 17): 1, (6, 12): 1, (5, 26): 1, (5, 27): 2}
    assert {(r.player, r.game_id): r.streak for r in runs.collect()} == want
    schedule = games.where("team = 1").selectExpr("5 AS player", "*")
    assert [r.streak for r in health.absence_streaks(schedule, runs).orderBy("game_id").collect()] == [1, 2, 0, 1, 2, 3, 0, 1]


def test_two_archetypes_add_up(spark):
    fp = spark.createDataFrame([(1, 1, 100.0)], "game_id int, team int, pace double")
    sev = spark.createDataFrame([(1, 1, "rim", 1.0), (1, 1, "scorer", 0.5)], "game_id int, team int, archetype string, severity double")
    deltas = spark.createDataFrame([("rim", "pace", -2.0), ("scorer", "pace", -4.0)], "archetype string, metric string, delta double")
    assert health.adjusted(fp, sev, deltas, ["game_id", "team"], ["pace"]).collect()[0].pace == 96.0


# --- market --------------------------------------------------------------------------------------------------------------


def _ticks(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    full = [(1, t0 + dt.timedelta(seconds=s), p, q, "BUY", True, i) for i, (s, p, q) in enumerate(rows)]
    return market.normalise(spark.createDataFrame(full, "market long, ts timestamp, price double, size long, side string, is_ref boolean, event_id long"))


def test_worked_bar(spark):
    got = market.bars(_ticks(spark, [(3, 0.62, 4), (17, 0.71, 9), (29, 0.58, 16), (41, 0.66, 7), (59, 0.6, 1)]), "1 minute").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.open, r.high, r.low, r.close, r.volume, r.n_trades) == (0.62, 0.71, 0.58, 0.6, 37, 5)
    assert r.vwap == pytest.approx((2.48 + 6.39 + 9.28 + 4.62 + 0.6) / 37)
    assert market.bars(_ticks(spark, [(0, 0.4, 1), (90, 0.5, 1)]), "1 minute").count() == 2


def test_robust_minimum_and_pregame(spark):
    rows = [(i, 0.5, 1) for i in range(20)]
    rows[10] = (10, 0.01, 1)
    got = market.robust_minimum(_ticks(spark, rows)).collect()[0]
    assert got.raw_min == 0.01 and got.robust_min > 0.3
    last = market.last_before(_ticks(spark, [(900, 0.5, 1), (950, 0.6, 1), (1000, 0.9, 1)]), F.lit(dt.datetime(2024, 1, 1, 0, 16, 40))).collect()[0]
    assert last.pregame_price == 0.6


def test_dips_by_brute_force(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(m, "ref", t0 + dt.timedelta(minutes=i), (lo := round(rng.random(), 2)), round(min(1.0, lo + rng.random() / 5), 2)) for m in range(4) for i in range(15)]
    got = {(r.market, r.p): r for r in market.dips(spark.createDataFrame(rows, "market long, side string, bar_start timestamp, low double, high double"), (0.1, 0.3)).collect()}
    for m in range(4):
        series = [r for r in rows if r[0] == m]
        for p in (0.1, 0.3):
            cross = next((i for i, r in enumerate(series) if r[3] < p), None)
            assert ((m, p) in got) == (cross is not None)
            if cross is not None:
                rest = series[cross:]
                k = min(range(len(rest)), key=lambda i: (rest[i][3], i))
                r = got[m, p]
                assert (r.trough, r.trough_ts, r.max_high) == (rest[k][3], rest[k][2], max(x[4] for x in rest))
                assert r.max_high_after_trough == max((x[4] for x in rest[k + 1 :]), default=None)


def test_event_flags(spark):
    doc = '{"markets":[{"slug":"a","type":"moneyline","volume":5,"outcomes":"[\\"X\\",\\"Y\\"]","prices":"[\\"0.2\\",\\"oops\\"]"},{"slug":"b","type":"moneyline","volume":5}]}'
    rows = market.parse_event(spark.createDataFrame([(1, doc)], "event int, doc string"), "doc")
    assert [(r.slug, r.outcomes, r.prices) for r in rows.orderBy("slug").collect()] == [("a", ["X", "Y"], [0.2, None]), ("b", None, None)]
    got = market.classify(rows, "event", ("moneyline", "spread")).collect()[0]
    assert (got.moneyline, got.spread, got.flags) == ("a", None, "several_moneyline;no_spread")


def test_global_rank(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r.id: (r.rank, r.n_rows) for r in ranks.global_rank(df, ["v", "id"]).collect()}
    assert got == {i: (k + 1, 500) for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    falling = {r.id: r.rank for r in ranks.global_rank(df, [F.desc("v"), "id"], 7).collect()}
    assert falling == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert ranks.global_rank(df.where("false"), ["v"]).collect() == []


def test_global_rank_splits_a_constant_first_column(spark):
    df = spark.range(20_000).select(F.lit(1).alias("c"), (F.col("id") * 7919 % 20_000).alias("id"))
    ranked = ranks.global_rank(df, ["c", "id"], 40).withColumn("file", F.input_file_name())
    assert ranked.where("rank != id + 1").count() == 0
    sizes = [r["count"] for r in ranked.groupBy("file").count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 2500


def test_group_quantiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), None if rng.random() < 0.1 else rng.choice([1.0, rng.gauss(0, 1)])) for _ in range(700)] + [("c", None), ("d", 2.5), (None, 1.0), (None, 2.0)]
    got = {r.k: (r.low, r.mid, r.top) for r in ranks.group_quantiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", {"low": 0.0, "mid": 0.5, "top": 0.9}, 13).collect()}
    assert set(got) == {"a", "b", "d", None}
    for k, v in got.items():
        own = [x for g, x in rows if g == k and x is not None]
        assert v == pytest.approx([float(np.quantile(own, q)) for q in (0, 0.5, 0.9)])


# --- Elo, style, evaluation ----------------------------------------------------------------------------------------------


def test_elo_by_hand(spark):
    g = _games(spark, [(0, 1, 2, 100, 90, 1), (1, 2, 1, 100, 90, 1), (2, 1, 2, 100, 90, 2)])
    rules = elo.EloRules()
    rows = elo.elo_ratings(g, rules).orderBy("game_id").collect()
    assert (rows[0].elo_home, rows[0].elo_away) == (1500, 1500)
    d = elo.step(1500, 1500, 10, rules)
    assert (rows[1].elo_home, rows[1].elo_away) == (pytest.approx(1500 - d), pytest.approx(1500 + d))
    e = elo.step(1500 - d, 1500 + d, 10, rules)
    assert rows[2].elo_home == pytest.approx(1500 + (1 - rules.regression) * (d - e))
    assert elo.elo_ratings(g.limit(0)).count() == 0
    two = g.withColumn("league", F.lit("x")).unionByName(g.withColumn("league", F.lit("y")).withColumn("game_id", F.col("game_id") + 10))
    both = {r.game_id: r.elo_home for r in elo.elo_ratings(two, rules, "league").collect()}
    assert all(both[i] == both[i + 10] for i in range(3))


def test_elo_of_late_dates_and_many_batches(spark):
    """dates past the year 9999 rate alike, and leagues go through in batches, each row on what stood before it."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        h, a = rng.sample([*range(8), None], 2)
        rows.append((rng.choice(["x", "y", None]), i, i // 4, 1 + i // 700, h, a, None if rng.random() < 0.02 else rng.randrange(80, 120), rng.randrange(80, 120)))
    raw = spark.createDataFrame(rows, "league string, game_id long, day int, season_id int, home int, away int, pts_home long, pts_away long").repartition(3)
    at = lambda first: raw.withColumn("game_date", F.date_add(F.lit(first).cast("date"), F.col("day")))
    rated = lambda df: {r.game_id: (r.elo_home, r.elo_away) for r in elo.elo_ratings(df, league="league").collect()}
    near, rules = rated(at("2020-01-01")), elo.EloRules()
    assert near == rated(at("+16312-01-01"))
    want, leagues = {}, {}
    for league, i, _, s, h, a, ph, pa in rows:
        ratings, played = leagues.setdefault(league, ({}, {}))
        rh, ra = (rules.initial if t is None else elo.entering(ratings, played, t, s, rules) for t in (h, a))
        want[i] = rh, ra
        if ph is not None:
            d = elo.step(rh, ra, ph - pa, rules)
            ratings |= {t: v for t, v in ((h, rh + d), (a, ra - d)) if t is not None}
    assert near == want


def test_margin_scale(spark):
    rated = spark.createDataFrame([(float(d), 100 + int(3 * d), 100) for d in range(-5, 6)], "elo_diff double, pts_home long, pts_away long")
    assert elo.fit_margin_scale(rated) == pytest.approx(3.0)


def test_neighbours_are_earlier(spark):
    rng = random.Random(7)
    rows = [(i, i // 3, [rng.gauss(0, 1) for _ in range(4)], float(i)) for i in range(40)] + [(40, 20, [0.0] * 4, 1.0)]
    df = spark.createDataFrame(rows, "id long, at int, vec array<double>, score double")
    got = sorted((r.id, r["rank"], r.other) for r in neighbours.earlier_neighbours(df, df, 3, cell_rows=5, block_rows=2).collect())

    def cos(a, b):
        n = lambda v: math.sqrt(sum(x * x for x in v)) or 1e-9
        return sum(x * y for x, y in zip(a, b, strict=True)) / n(a) / n(b)

    want = []
    for i, t, v, _ in rows:
        best = sorted(((-cos(v, w), j) for j, u, w, _ in rows if u < t))[:3]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("floor", [None, 0.3])
def test_neighbours_tie_by_id_across_blocks(spark, floor):
    rng = random.Random(11)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [(i, rng.choice([3, 3, 3, *range(12)]), some[rng.randrange(9)], 1.0) for i in range(150)]
    rows += [(150, 5, None, 1.0), (151, 5, [1.0, None, 1.0, 1.0, 1.0], 1.0), (152, 5, [float("nan")] * 5, 1.0), (153, None, some[0], 1.0)]
    schema = "id long, at date, vec array<double>, score double"
    df = spark.createDataFrame([(i, day(a), v, s) for i, a, v, s in rows], schema)
    want = []
    for i, a, v, _ in rows[:150]:
        cos = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w))
        near = sorted((-round(cos(w), 9), j) for j, b, w, _ in rows[:150] if b < a)[:6]
        want += [(i, n + 1, j) for n, (s, j) in enumerate(near) if floor is None or -s >= floor]
    for cell_rows, block_rows in ((10, 1000), (30, 7), (1000, 1000)):
        got = neighbours.earlier_neighbours(df, df, 6, floor=floor, cell_rows=cell_rows, block_rows=block_rows).collect()
        assert sorted((r.id, r["rank"], r.other) for r in got) == want
    assert neighbours.earlier_neighbours(df, df.limit(0), 6, floor=floor).count() == 0 == neighbours.earlier_neighbours(df.limit(0), df, 6, floor=floor).count()


def test_cones_spare_pairs(spark):
    """Clustered vectors: under 30 % of the pairs are scored, results are those of all pairs, and groups stay apart."""
    rng = random.Random(12)
    spots = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(24)]
    rows = [(i % 2, i, i, [x + rng.gauss(0, 0.05) for x in spots[rng.randrange(24)]], float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "grp int, id long, at int, vec array<double>, score double")
    targets = df.where("id % 10 < 2")
    n_targets = targets.count()
    found = neighbours.search_earlier(targets, df, 5, threshold=0.95, group="grp", cell_rows=100, scored=True).collect()
    assert sum(r.n for r in found if r.sim == -2) < 0.3 * n_targets * 3000
    vectors = np.array([r[3] for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    got = neighbours.earlier_neighbours(targets, df, 5, group="grp", cell_rows=100).collect()
    near = {}
    for r in got:
        near.setdefault(r.id, []).append((r["rank"], r.other))
    votes = {}
    for r in found:
        if r.other is None and r.sim != -2:
            n, s = votes.get(r.id, (0, 0.0))
            votes[r.id] = (n + r.n, s + r.score)
    for i in range(0, 6000):
        if i % 10 >= 2:
            continue
        own = np.arange(i % 2, i, 2)
        sims = vectors[own] @ vectors[i]
        best = own[np.argsort(-sims, kind="stable")[:5]]
        assert [o for _, o in sorted(near.get(i, []))] == best.tolist()
        reached = own[sims >= 0.95]
        assert votes.get(i, (0, 0.0)) == (len(reached), float(reached.sum()))


def test_folds():
    f = lambda n, a, b, c, d, e: evaluate.Fold(n, *(f"2020-{x:02d}-01" for x in (a, b, c, d, e)))
    evaluate.check_folds([f("a", 1, 2, 3, 4, 5), f("b", 4, 5, 6, 7, 8)])
    for bad in ([], [f("a", 3, 2, 4, 5, 6)], [f("b", 4, 5, 6, 7, 8), f("a", 1, 2, 3, 4, 5)], [f("a", 1, 2, 5, 6, 7), f("b", 3, 4, 8, 9, 10)]):
        with pytest.raises(ValueError):
            evaluate.check_folds(bad)


def test_metrics_skip_missing_predictions(spark):
    rows = [(1.0, 4.0, 200.0, 200.0), (None, 9.0, None, 1.0), (5.0, 8.0, 190.0, 200.0)]
    r = evaluate.error_metrics(spark.createDataFrame(rows, "pred_diff double, diff double, pred_total double, total double")).collect()[0]
    assert (r.n, r.diff_mae, r.total_mae, r.win_accuracy) == (2, 3.0, 5.0, 1.0)
    assert _value(spark, evaluate.composite(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0))) == 1.5


def test_ablation_and_families(spark):
    assert evaluate.ablation({"a": True, "b": False}, lambda f: 2.0 * f["a"] + f["b"]) == {"a": -2.0, "b": 1.0}
    steps = [("one", lambda d: d.withColumn("x", F.lit(1))), ("two", lambda d: d.withColumns({"y": F.lit(1), "z": F.lit(2)}))]
    assert evaluate.families(spark.range(1), steps) == {"x": "one", "y": "two", "z": "two"}


def test_search_finds_the_best():
    best, score = evaluate.random_search({"x": range(10), "y": [1, 2]}, lambda s: -abs(s["x"] - 4) + s["y"], 300)
    assert best == {"x": 4, "y": 2} and score == 2
    tried = []
    best, score = evaluate.parzen_search({"x": range(30), "y": range(30)}, lambda s: tried.append(tuple(s.values())) or -abs(s["x"] - 21) - abs(s["y"] - 4), 120)
    assert score >= -1 and len(set(tried)) == len(tried) == 120
    assert evaluate.parzen_search({"x": [1, 2, 3]}, lambda s: s["x"], 50)[0] == {"x": 3}


def test_permutation_keeps_blocks_together(spark):
    df = spark.range(60).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), F.lit(1).alias("c"))
    rows = evaluate.permuted(df, ["a", "b"], "id", 3).collect()
    assert sorted(r.a for r in rows) == [2 * i for i in range(60)] and all(2 * r.b == 3 * r.a for r in rows)
    assert any(r.a != 2 * r.id for r in rows)


# --- leakage -------------------------------------------------------------------------------------------------------------


def test_later_games_change_nothing(spark):
    rng = random.Random(11)
    rows = [(d, h, a, rng.randrange(80, 120), rng.randrange(80, 120)) for d in range(40) for h, a in ((1, 2), (3, 4)) if rng.random() < 0.8]
    rows = [(d, *(rng.sample([1, 2, 3, 4], 2)), x, y) for d, _, _, x, y in rows]
    g = _games(spark, rows)
    g = g.withColumns({f"{c}_{s}": F.col("game_id") % 7 + 3 for c in STYLE for s in ("home", "away")})
    cut = g.where("game_date <= date '2020-01-25'")
    shuffled = g.orderBy(F.rand(1))

    def features(df):
        tg = perspective(df, *STYLE)
        a = form.rolling_form(tg, (5,)).select("game_id", "team", "win_pct_l5", "fg_pct_l5")
        b = form.opponent_quality(form.style_rolling(tg, (10,)), 10)
        c = form.rest(tg, ["team", "is_home"]).select("game_id", "team", "rest_days", "fourth_in_four")
        d = form.venue_delta(tg, 10).select("game_id", "team", "venue_delta")
        e = style.fingerprints(style.raw_metrics(tg), 10, 4.0, 1).select("game_id", "team", *style.METRICS)
        out = a.join(b, ["game_id", "team"]).join(c, ["game_id", "team"]).join(d, ["game_id", "team"]).join(e, ["game_id", "team"], "left")
        h = pairs.head_to_head(df).select("game_id", "margin_all", "win_rate_l5").join(elo.elo_ratings(df), "game_id")
        tidy = lambda v: round(v, 9) if isinstance(v, float) else v
        return {(r.game_id, r.team): tuple(map(tidy, r)) for r in out.collect()}, {r.game_id: tuple(map(tidy, r)) for r in h.collect()}

    whole, part, mixed = features(g), features(cut), features(shuffled)
    assert whole == mixed
    for w, p in zip(whole, part, strict=True):
        assert p and all(w[k] == v for k, v in p.items())


# --- tables and sinks ----------------------------------------------------------------------------------------------------


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, n int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "n").select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in tables.new_rows(new, old, ["k"]).collect()] == [3]
    assert sorted(r.v for r in tables.carry_forward(old, new, ["k"]).collect()) == ["a", "c", "d"]
    once = tables.migrate(old, {"v": "value"}, {"extra": F.lit(0)})
    assert tables.migrate(once, {"v": "value"}, {"extra": F.lit(0)}).columns == once.columns == ["k", "value", "n", "extra"]
    assert tables.full_on_off(old, new, "k", "n").count() == 3
    assert tables.upcoming(old.withColumn("wl", F.when(F.col("k") == 1, "W")), "wl").collect()[0].k == 2
    assert tables.feature_columns(old, ["k"]) == ["v", "n"]
    from tideline.sources import sinks

    path = f"file://{tmp_path}"
    sinks.write_series(old, f"{path}/series", ["k"])
    assert sinks.read_series(spark, f"{path}/series", ["v"], k=2).collect()[0].v == "b"
    for run in ("one", "two"):
        sinks.append_run(spark, f"{path}/runs", {"run": run, "score": 1.5})
    sinks.append_run(spark, f"{path}/runs", {"score": 2})
    assert sorted(((r.run or "", r.score) for r in sinks.read_runs(spark, f"{path}/runs").collect())) == [("", "2"), ("one", "1.5"), ("two", "1.5")]
    with pytest.raises(ValueError, match="no column"):
        sinks.append_run(spark, f"{path}/runs", {"other": 1})
    sinks.write_json(old, f"{path}/json")
    assert spark.read.schema(old.schema).json(f"{path}/json").count() == 2
    sinks.save_model({"weights": [1, 2]}, spark, f"{path}/model")
    assert sinks.load_model(spark, f"{path}/model") == {"weights": [1, 2]}


def test_missing_checkpoints_of_many_teams(spark, tmp_path, monkeypatch):
    """No cap on teams: each of 2,000 lacks the checkpoints on which it has no game at home."""
    from tideline.plans import relational

    rows = [(2 * t, dt.date(2020, 1, 1), 22000, t, t + 1) for t in range(2000)] + [(5000, dt.date(2020, 1, 9), 22000, 0, 1)]
    g = spark.createDataFrame(rows, "game_id long, game_date date, season_id int, home int, away int")
    monkeypatch.setattr(relational, "games", lambda spark, sf: g)
    got = relational.missing_checkpoints(spark, "").collect()
    assert len(got) == 2000 and {r.as_of_date for r in got} == {dt.date(2020, 1, 8)} and len({r.team for r in got}) == 2000


def test_config(tmp_path):
    from tideline.config import Config, get_value

    c = Config()
    assert get_value(c, "elo.k") == c.elo.k and get_value(c, "nothing.here", 3) == 3


def test_scope_deletes_what_was_staged(spark):
    before = sinks.staged(spark.range(3), "outside")
    with sinks.scope(spark):
        inside = sinks.staged(spark.range(5), "inside")
        ranked = ranks.global_rank(inside, ["id"]).collect()
        folders = [Path(f.removeprefix("file://")).parent for f in inside.inputFiles()]
        assert len(ranked) == 5 and all(f.exists() for f in folders)
    assert not any(f.exists() for f in folders) and before.count() == 3
