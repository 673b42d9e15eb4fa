"""As-of joins, snapshots and players' rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import asof as O
from tideline.operators import players as L
from tideline.operators.windows import r6
from tideline.plans import query
from tideline.sources.views import games, perspective, player_stats, snapshots, table, with_views

_LEFT = "l AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS d FROM orders)"


def _left(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"))


@query("J3", f"WITH {with_views('snaps')}, {_LEFT} SELECT l.id, l.entity, l.d, s.gp, s.points FROM l ASOF LEFT JOIN snaps s ON l.entity = s.entity AND l.d >= s.as_of_date")
def asof_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return O.asof_backward(_left(spark, sf), snapshots(spark, sf), ["entity"], "d", "as_of_date", ["gp", "points"])


@query("J4, S15", f"WITH {with_views('snaps')}, {_LEFT} SELECT l.id, s.gp FROM (SELECT *, d - 30 AS e FROM l) l ASOF LEFT JOIN snaps s ON l.entity = s.entity AND l.e >= s.as_of_date")
def asof_lagged(spark: SparkSession, sf: str) -> DataFrame:
    return O.asof_backward(_left(spark, sf), snapshots(spark, sf), ["entity"], "d", "as_of_date", ["gp"], lag_days=30).select("id", "gp")


@query(
    "J5, P27",
    f"WITH {with_views('snaps')}, {_LEFT}, a AS (SELECT * FROM snaps WHERE minutes >= 24), b AS (SELECT * FROM snaps WHERE minutes < 24) SELECT l.id, coalesce(a.points, b.points) AS points FROM (SELECT *, d - 1 AS e FROM l) l ASOF LEFT JOIN a ON l.entity = a.entity AND l.e >= a.as_of_date ASOF LEFT JOIN b ON l.entity = b.entity AND l.e >= b.as_of_date",
)
def asof_preferred(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf).select("entity", "as_of_date", "points", "minutes")
    return O.asof_preferring(_left(spark, sf), s.where("minutes >= 24"), s.where("minutes < 24"), ["entity"], "d", "as_of_date", "points", lag_days=1).select("id", "points")


@query(
    "J16, W29",
    f"WITH {with_views('snaps')}, {_LEFT} SELECT id, arg_max(points, as_of_date) AS points, max(as_of_date) AS as_of_date FROM l JOIN snaps s ON l.entity = s.entity AND s.as_of_date < l.d AND s.as_of_date >= make_date(CAST(year(l.d) AS INTEGER), 1, 1) GROUP BY id",
)
def snapshot_in_season(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf).withColumn("_as_of", F.col("as_of_date"))
    found = O.asof_backward(_left(spark, sf), s, ["entity"], "d", "as_of_date", ["points", "_as_of"], lag_days=1)
    return found.where(F.col("_as_of") >= F.trunc("d", "year")).select("id", "points", F.col("_as_of").alias("as_of_date"))


@query("W29", f"WITH {with_views('snaps')} SELECT entity, max(as_of_date) AS as_of_date, arg_max(gp, as_of_date) AS gp, arg_max(points, as_of_date) AS points FROM snaps GROUP BY 1")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest(snapshots(spark, sf).select("entity", "as_of_date", "gp", "points"), ["entity"], ["as_of_date"])


@query("J15", f"WITH {with_views('snaps')}, {_LEFT} SELECT id FROM l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = l.entity AND o.o_orderkey <> l.id AND o.o_orderkey % 3 = 0 AND l.id % 3 <> 0 AND abs(date_diff('day', CAST(o.o_orderdate AS DATE), l.d)) <= 60)")
def active_near(spark: SparkSession, sf: str) -> DataFrame:
    rows = _left(spark, sf)
    return O.active_near(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0").select("entity", F.col("d").alias("seen")), "entity", "d", "seen", 60).select("id")


@query(
    "J13, A12",
    f"WITH {with_views('games')} SELECT g.game_id, CAST(count(o.game_id) AS BIGINT) AS n_recent FROM (SELECT * FROM games WHERE home = 4) g LEFT JOIN games o ON o.home = g.home AND o.game_date < g.game_date AND o.game_date >= g.game_date - 365 GROUP BY 1",
)
def recency_bounded(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("home").orderBy(F.unix_date("game_date")).rangeBetween(-365, -1)
    return games(spark, sf).where("home = 4").select("game_id", F.count("game_id").over(w).alias("n_recent"))


@query("L1, A11", f"WITH {with_views('pstats')} SELECT player, stat_date, stat_name, round(coalesce(avg(stat_value) OVER (PARTITION BY player, stat_name ORDER BY stat_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS rolling FROM pstats")
def player_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return L.rolling(player_stats(spark, sf), 10).select("player", "stat_date", "stat_name", r6(F.col("rolling")).alias("rolling"))


@query(
    "L2, L3",
    f"""WITH {with_views('pstats')}, r AS (SELECT *, row_number() OVER (PARTITION BY player, stat_name ORDER BY stat_date DESC) AS rn FROM pstats WHERE stat_date < DATE '1997-06-01'),
w AS (SELECT player, stat_name, """ + " + ".join(f"coalesce(avg(stat_value) FILTER (WHERE rn <= {n}), 0)" for n in (5, 10, 20)) + " AS s FROM r GROUP BY 1, 2) SELECT player, stat_name, round(s / 3, 6) AS projection FROM w WHERE s > 0",
)
def player_projection(spark: SparkSession, sf: str) -> DataFrame:
    return L.project(player_stats(spark, sf), "1997-06-01", (5, 10, 20))


@query(
    "J6",
    f"""WITH {with_views('tg')}, c AS (SELECT team, season_id, game_date, sum(win) OVER (PARTITION BY team, season_id ORDER BY game_date) AS wins FROM tg),
s AS (SELECT t.team, d.season_id, d.game_date FROM (SELECT DISTINCT season_id, game_date FROM games) d JOIN (SELECT DISTINCT season_id, team FROM tg) t ON t.season_id = d.season_id)
SELECT s.season_id, s.game_date, s.team, CAST(coalesce(c.wins, 0) AS BIGINT) AS wins FROM (SELECT *, game_date - 1 AS e FROM s) s ASOF LEFT JOIN c ON s.team = c.team AND s.season_id = c.season_id AND s.e >= c.game_date""",
)
def date_spine(spark: SparkSession, sf: str) -> DataFrame:
    tg = perspective(games(spark, sf))
    run = tg.withColumn("wins", F.sum("win").over(W.partitionBy("team", "season_id").orderBy("game_date")))
    dates = tg.select("season_id", "game_date").distinct()
    spine = dates.join(tg.select("season_id", "team").distinct(), "season_id")
    out = O.asof_backward(spine, run, ["season_id", "team"], "game_date", "game_date", ["wins"], lag_days=1)
    return out.select("season_id", "game_date", "team", F.coalesce("wins", F.lit(0)).alias("wins"))
