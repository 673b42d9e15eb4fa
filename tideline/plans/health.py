"""Injury and availability queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import health as O
from tideline.operators.windows import r6
from tideline.plans import query
from tideline.sources.views import games, injuries, perspective, player_stats, snapshots, table, with_views


def _sev(reason: str) -> str:
    strip = lambda p: p.replace("(?i)", "")
    return f"CASE WHEN regexp_matches({reason}, '{strip(C.SEVERE)}', 'i') THEN 'severe' WHEN regexp_matches({reason}, '{strip(C.MODERATE)}', 'i') THEN 'moderate' ELSE 'minor' END"


def _weight(reason: str) -> str:
    return f"CASE {_sev(reason)} WHEN 'severe' THEN 1.0 WHEN 'moderate' THEN 0.6 ELSE 0.3 END"


_STATUS = "CASE status WHEN 'Out' THEN 1.0 WHEN 'Doubtful' THEN 0.8 ELSE 0.0 END"
_TWO_WAY = "regexp_matches(reason, '" + C.TWO_WAY.replace("(?i)", "") + "', 'i')"
_IMPORTANCE = "imp AS (SELECT DISTINCT team, player, CAST(((player * 7) % 20 + 1) / 100.0 AS DOUBLE) AS importance FROM inj)"


def _importances(spark: SparkSession, sf: str) -> DataFrame:
    return injuries(spark, sf).select("team", "player").distinct().withColumn("importance", ((F.col("player") * 7) % 20 + 1) / 100.0)


@query("P11, P12", f"WITH {with_views('inj')} SELECT reason, {_sev('reason')} AS severity, CAST({_weight('reason')} AS DOUBLE) AS weight, {_TWO_WAY} AS two_way, CAST(count(*) AS BIGINT) AS n FROM inj GROUP BY ALL")
def severity_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("reason")
    return injuries(spark, sf).groupBy("reason", C.severity(r).alias("severity"), C.severity_weight(r).alias("weight"), C.is_two_way(r).alias("two_way")).agg(F.count("*").alias("n"))


@query("A3", f"WITH {with_views('inj')} SELECT game_date, team, CAST(count(*) FILTER (WHERE status = 'Out') AS BIGINT) AS n_out, CAST(count(*) FILTER (WHERE status = 'Doubtful') AS BIGINT) AS n_doubtful, CAST(count(*) FILTER (WHERE status = 'Questionable') AS BIGINT) AS n_questionable FROM inj GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.status_counts(injuries(spark, sf), ["game_date", "team"])


@query("A8", f"WITH {with_views('inj')} SELECT game_date, team, player % 5 AS archetype, round(CAST(max({_weight('reason')} * {_STATUS}) AS DOUBLE), 6) AS severity FROM inj WHERE status IN ('Out', 'Doubtful') AND NOT {_TWO_WAY} GROUP BY 1, 2, 3")
def archetype_severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = injuries(spark, sf).withColumn("archetype", F.col("player") % 5)
    return O.max_severity(rows, ["game_date", "team", "archetype"]).withColumn("severity", r6(F.col("severity")))


@query(
    "A4",
    f"WITH {with_views('snaps')}, s AS (SELECT *, c_nationkey AS team FROM snaps JOIN customer ON entity = c_custkey WHERE as_of_date < DATE '1995-06-30') SELECT entity, as_of_date, round(greatest(0.0, least(1.0, 0.4 * minutes / sum(minutes) OVER w + 0.4 * usage / max(usage) OVER w + 0.2 * points / sum(points) OVER w)), 6) AS importance FROM s WINDOW w AS (PARTITION BY team, as_of_date)",
)
def player_importance(spark: SparkSession, sf: str) -> DataFrame:
    teams = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("team"))
    s = snapshots(spark, sf).where("as_of_date < date '1995-06-30'").join(teams, "entity")
    return O.importance(s, ["team", "as_of_date"]).select("entity", "as_of_date", r6(F.col("importance")).alias("importance"))


@query(
    "A2, P26",
    f"WITH {with_views('inj')}, {_IMPORTANCE}, t AS (SELECT team, sum(importance) AS total FROM imp GROUP BY 1), m AS (SELECT i.game_date, i.team, sum(CASE WHEN {_TWO_WAY} THEN 0 ELSE {_weight('reason')} * {_STATUS} END * importance) AS missing FROM inj i LEFT JOIN imp ON i.team = imp.team AND i.player = imp.player GROUP BY 1, 2) SELECT game_date, m.team, round(CAST(missing / greatest(total - missing, 0.01) AS DOUBLE), 3) AS deficit FROM m JOIN t ON m.team = t.team",
)
def team_deficit(spark: SparkSession, sf: str) -> DataFrame:
    d = O.team_deficit(injuries(spark, sf), _importances(spark, sf), ["game_date", "team"])
    return d.select("game_date", "team", F.round(F.col("missing") / F.greatest(F.col("total") - F.col("missing"), F.lit(0.01)), 3).alias("deficit"))


@query(
    "A1, P27, P28, J4",
    f"""WITH {with_views('inj', 'snaps')}, im AS (SELECT entity AS player, as_of_date, points - minutes / 4 AS impact FROM snaps WHERE minutes >= 15 AND as_of_date < DATE '2016-09-30'),
l AS (SELECT *, DATE '1995-01-01' + CAST(date_diff('day', DATE '2016-10-01', game_date) AS INTEGER) AS d FROM inj WHERE status IN ('Out', 'Doubtful')),
r AS (SELECT l.*, im.impact FROM (SELECT *, d - 1 AS e FROM l) l ASOF LEFT JOIN im ON l.player = im.player AND l.e >= im.as_of_date),
s AS (SELECT game_date, team, sum({_STATUS} * impact) AS missing_impact, count(impact) AS n_rated FROM r GROUP BY 1, 2)
SELECT t.game_id, t.team, round(CAST(coalesce(missing_impact, 0) AS DOUBLE), 6) AS missing_impact, CAST(coalesce(n_rated, 0) AS BIGINT) AS n_rated, CAST(t.game_date IN (SELECT game_date FROM inj WHERE game_id % 2 = 0) AS INTEGER) AS has_injury_data FROM tg t LEFT JOIN s ON t.game_date = s.game_date AND t.team = s.team""",
)
def missing_impact(spark: SparkSession, sf: str) -> DataFrame:
    back = F.datediff(F.lit("1995-01-01").cast("date"), F.lit("2016-10-01").cast("date"))
    i = injuries(spark, sf)
    shifted = i.withColumn("game_date", F.date_add("game_date", back))
    impacts = snapshots(spark, sf).where("as_of_date < date '2016-09-30'").select(F.col("entity").alias("player"), "as_of_date", (F.col("points") - F.col("minutes") / 4).alias("impact"), "minutes")
    dates = perspective(games(spark, sf)).select("game_id", "team", F.date_add("game_date", back).alias("game_date"))
    out = O.missing_impact(dates, shifted, impacts)
    out = O.with_coverage(out, shifted.where("game_id % 2 = 0"))
    return out.select("game_id", "team", r6(F.col("missing_impact")).alias("missing_impact"), "n_rated", "has_injury_data")


@query(
    "W24, Q4, J7",
    f"""WITH {with_views('inj')}, r AS (SELECT DISTINCT player, team FROM inj), s AS (SELECT r.player, t.team, t.game_id, t.game_date, EXISTS (SELECT 1 FROM inj i WHERE i.player = r.player AND i.game_id = t.game_id AND i.status = 'Out') AS out FROM tg t JOIN r ON r.team = t.team),
g AS (SELECT *, sum(CASE WHEN out THEN 0 ELSE 1 END) OVER (PARTITION BY player, team ORDER BY game_date, game_id) AS run FROM s)
SELECT player, team, game_id, CAST(CASE WHEN out THEN sum(CAST(out AS INTEGER)) OVER (PARTITION BY player, team, run ORDER BY game_date, game_id) ELSE 0 END AS BIGINT) AS streak FROM g""",
)
def absence_streaks(spark: SparkSession, sf: str) -> DataFrame:
    i, tg = injuries(spark, sf), perspective(games(spark, sf)).select("team", "game_id", "game_date")
    schedule = tg.join(i.select("player", "team").distinct(), "team")
    return O.absence_streaks(schedule, O.absence_runs(tg, i)).select("player", "team", "game_id", "streak")


@query(
    "A9, P21",
    f"""WITH {with_views('inj')}, r AS (SELECT DISTINCT player, team FROM inj), s AS (SELECT r.player, t.team, t.game_id, t.game_date, EXISTS (SELECT 1 FROM inj i WHERE i.player = r.player AND i.game_id = t.game_id AND i.status = 'Out') AS out FROM tg t JOIN r ON r.team = t.team),
g AS (SELECT *, sum(CASE WHEN out THEN 0 ELSE 1 END) OVER (PARTITION BY player, team ORDER BY game_date, game_id) AS run FROM s),
k AS (SELECT *, CASE WHEN out THEN sum(CAST(out AS INTEGER)) OVER (PARTITION BY player, team, run ORDER BY game_date, game_id) ELSE 0 END AS streak FROM g)
SELECT game_id, team, CAST(min(streak) AS BIGINT) AS freshest, round(pow(0.5, (min(streak) - 1) / 5.0), 6) AS weight FROM k WHERE streak > 0 GROUP BY 1, 2""",
)
def freshest_absence(spark: SparkSession, sf: str) -> DataFrame:
    return O.min_streak(O.absence_runs(perspective(games(spark, sf)).select("team", "game_id", "game_date"), injuries(spark, sf)), 5.0).select("game_id", "team", F.col("freshest").cast("long").alias("freshest"), r6(F.col("weight")).alias("weight"))


@query(
    "A5, P13",
    f"WITH {with_views('inj')}, {_IMPORTANCE}, t AS (SELECT team, sum(importance) AS total FROM imp GROUP BY 1), s AS (SELECT x.game_date, x.team, sum(importance) AS sat FROM (SELECT DISTINCT game_date, team, player FROM inj WHERE status = 'Out' AND lower(trim(reason)) IN ('rest', 'coach''s decision')) x JOIN imp ON imp.team = x.team AND imp.player = x.player GROUP BY 1, 2) SELECT tg.game_id, tg.team, round(coalesce(sat, 0) / total, 6) AS roster_score FROM tg LEFT JOIN s ON s.game_date = tg.game_date AND s.team = tg.team JOIN t ON t.team = tg.team",
)
def roster_behaviour(spark: SparkSession, sf: str) -> DataFrame:
    tg = perspective(games(spark, sf)).select("game_id", "team", "game_date")
    return O.roster_scores(tg, injuries(spark, sf), _importances(spark, sf)).select("game_id", "team", r6(F.col("roster_score")).alias("roster_score"))


@query(
    "A6",
    f"WITH {with_views('snaps')}, l AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT l.*, s.minutes AS now FROM (SELECT *, d - 1 AS e FROM l) l ASOF LEFT JOIN snaps s ON l.entity = s.entity AND l.e >= s.as_of_date), t AS (SELECT n.id, n.now, s.minutes AS before FROM (SELECT * EXCLUDE (e), d - 28 AS e FROM n) n ASOF LEFT JOIN snaps s ON n.entity = s.entity AND n.e >= s.as_of_date) SELECT id, round(coalesce((before - now) / before, 0), 6) AS drop FROM t",
)
def minutes_trend(spark: SparkSession, sf: str) -> DataFrame:
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"))
    return O.minutes_trend(at, snapshots(spark, sf), 4).select("id", r6(F.col("drop")).alias("drop"))


_VALUES = "v AS (SELECT team, season_id, CAST(game_id % 3 AS INTEGER) AS archetype, CASE WHEN game_id % 4 = 0 THEN pow(0.5, (game_id % 5) / 5.0) ELSE 0.0 END AS weight, CAST(pts AS DOUBLE) AS pace, CAST(ast AS DOUBLE) AS assists FROM tg)"


@query(
    "A7, M7",
    f"""WITH {with_views('tg')}, {_VALUES}, i AS (SELECT *, max(CASE WHEN weight > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team, season_id, archetype) AS inside FROM v),
u AS (SELECT archetype, weight, 'pace' AS metric, pace AS value FROM i WHERE inside = 1 UNION ALL SELECT archetype, weight, 'assists', assists FROM i WHERE inside = 1)
SELECT archetype, metric, round(sum(CASE WHEN weight > 0 THEN weight * value END) / sum(CASE WHEN weight > 0 THEN weight END) - avg(CASE WHEN weight = 0 THEN value END), 4) AS delta, CAST(count(*) FILTER (WHERE weight > 0) AS BIGINT) AS n_missing FROM u GROUP BY 1, 2""",
)
def calibration_deltas(spark: SparkSession, sf: str) -> DataFrame:
    tg = perspective(games(spark, sf), "ast")
    weight = F.when(F.col("game_id") % 4 == 0, F.pow(F.lit(0.5), (F.col("game_id") % 5) / 5.0)).otherwise(0.0)
    v = tg.select("team", "season_id", (F.col("game_id") % 3).cast("int").alias("archetype"), weight.alias("weight"), F.col("pts").cast("double").alias("pace"), F.col("ast").cast("double").alias("assists"))
    return O.calibration(v, "archetype", ["pace", "assists"])


_DELTAS = ((0, "pace", -1.5), (0, "assists", -2.0), (1, "pace", 0.8), (2, "assists", -1.1), (3, "pace", -0.4), (4, "assists", 0.6))


@query(
    "M6, P21, A8",
    f"""WITH {with_views('inj')}, d(archetype, metric, delta) AS (VALUES {', '.join(f"({a}, '{m}', {x})" for a, m, x in _DELTAS)}),
s AS (SELECT game_id, team, player % 5 AS archetype, max({_weight('reason')} * {_STATUS}) AS severity FROM inj WHERE status IN ('Out', 'Doubtful') AND NOT {_TWO_WAY} GROUP BY 1, 2, 3),
x AS (SELECT game_id, team, sum(CASE WHEN metric = 'pace' THEN delta * severity END) AS p, sum(CASE WHEN metric = 'assists' THEN delta * severity END) AS a FROM s JOIN d ON s.archetype = d.archetype GROUP BY 1, 2)
SELECT t.game_id, t.team, round(CAST(pts + coalesce(p, 0) AS DOUBLE), 6) AS pace, round(CAST(ast + coalesce(a, 0) AS DOUBLE), 6) AS assists FROM tg t LEFT JOIN x ON t.game_id = x.game_id AND t.team = x.team""",
)
def injury_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    tg = perspective(games(spark, sf), "ast").select("game_id", "team", F.col("pts").cast("double").alias("pace"), F.col("ast").cast("double").alias("assists"))
    severities = O.max_severity(injuries(spark, sf).withColumn("archetype", F.col("player") % 5), ["game_id", "team", "archetype"])
    deltas = spark.createDataFrame(list(_DELTAS), "archetype long, metric string, delta double")
    out = O.adjusted(tg, severities, deltas, ["game_id", "team"], ["pace", "assists"])
    return out.select("game_id", "team", r6(F.col("pace")).alias("pace"), r6(F.col("assists")).alias("assists"))


_NUMBER = "CASE WHEN {c} % 7 = 0 THEN 'own ' || {c} ELSE {c} % 100 + 100 * ({c} // 200) || '' END"
_PRINTED = "CASE WHEN {c} % 97 = 5 THEN repeat('.', CAST({c} // 97 + 3 AS INTEGER)) WHEN {c} % 11 = 0 THEN 'nobody ' || {c} ELSE 'name ' || " + _NUMBER + " END"


def _name(c: str, first: str, last: str) -> Column:
    """Two players share most names; some have a name of their own, some one of full stops only."""
    x = F.col(c)
    number = F.when(x % 7 == 0, F.concat(F.lit("own "), x)).otherwise((x % 100 + 100 * F.floor(x / 200)).cast("string"))
    return F.when(x % 97 == 5, F.repeat(F.lit("."), (F.floor(x / 97) + 3).cast("int"))).otherwise(F.concat(F.lit(first), number, F.lit(last)))


@query(
    "M5, P10, J7, J15, M12",
    f"""WITH i AS (SELECT c_custkey AS player, {_PRINTED.replace("WHEN {c} % 11 = 0 THEN 'nobody ' || {c} ", "").format(c='c_custkey')} AS k FROM customer),
r AS (SELECT {_PRINTED.format(c='o_custkey')} AS k, o_custkey AS player, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT k, min(d) AS first FROM r GROUP BY 1),
a AS (SELECT DISTINCT n.k, i.player, EXISTS (SELECT 1 FROM r WHERE r.player = i.player AND abs(date_diff('day', r.d, n.first)) <= 60) AS active FROM n JOIN i ON i.k = n.k),
g AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE active) AS m, min(player) AS least, min(player) FILTER (WHERE active) AS most, CASE WHEN k LIKE '.%' THEN 'exact_fallback' ELSE 'normalized' END AS method FROM a GROUP BY 1)
SELECT upper(n.k) AS printed, CASE WHEN n > 1 THEN coalesce(most, least) ELSE least END AS player, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN method WHEN m = 1 THEN method || '+disambiguated' ELSE method || '+ambiguous' END AS method,
  CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'high' WHEN m = 1 THEN 'medium' ELSE 'low' END AS confidence FROM n LEFT JOIN g ON n.k = g.k""",
)
def name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), _name("c_custkey", "Námé  ", " Jr.").alias("full_name"))
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    printed = F.when((F.col("o_custkey") % 11 == 0) & (F.col("o_custkey") % 97 != 5), F.concat(F.lit("NOBODY "), F.col("o_custkey"))).otherwise(F.upper(_name("o_custkey", "NAME ", "")))
    return O.resolve_names(o.select(printed.alias("printed"), F.col("d").alias("report_date")), index, o.select(F.col("o_custkey").alias("player"), F.col("d").alias("active_date")))


@query(
    "P22, A12",
    f"WITH {with_views('inj')}, {_IMPORTANCE}, o AS (SELECT *, coalesce(sum(CAST(status = 'Out' AS INTEGER)) OVER (PARTITION BY player ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS games_out FROM inj) SELECT o.game_id, o.team, round(sum(importance * greatest(0.1, exp(-games_out / 20.0))) / sum(importance), 6) AS absence_factor FROM o JOIN imp ON o.team = imp.team AND o.player = imp.player GROUP BY 1, 2",
)
def absence_factor(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.games_out_before(injuries(spark, sf)).join(_importances(spark, sf), ["team", "player"])
    return O.absence_factor(rows, ["game_id", "team"], 20.0)


@query(
    "W27, M4, A10",
    f"""WITH {with_views('pstats')}, s AS (SELECT player, CAST(year(stat_date) AS INTEGER) AS season, """
    + ", ".join(f"avg(stat_value) FILTER (WHERE stat_name = '{n}') AS {c}" for c, n in (("ppg", "PTS"), ("reb", "REB"), ("ast", "AST"), ("blk", "BLK"), ("stl", "STL")))
    + """ FROM pstats GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN season >= 1995 THEN 10.0 + player % 25 END AS minutes, CASE WHEN season >= 1995 THEN CAST((player * 7) % 31 AS DOUBLE) END AS usage, CASE WHEN season >= 1995 THEN ast / (10.0 + player % 25) END AS ast_rate FROM s),
r AS (SELECT player, season, """
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY season ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY season, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY season) END AS {c}" for c in ("ppg", "ast", "blk", "reb", "stl", "usage", "ast_rate"))
    + """ FROM u)
SELECT player, season, CASE WHEN CASE WHEN usage IS NOT NULL THEN usage >= 0.8 AND ast_rate >= 0.8 ELSE ppg >= 0.85 AND ast >= 0.85 END THEN 'combo' WHEN ast >= 0.65 AND ppg <= 0.35 THEN 'facilitator'
  WHEN ppg >= 0.65 AND ast <= 0.35 THEN 'scorer' WHEN blk >= 0.75 AND reb >= 0.75 THEN 'rim_protector' WHEN blk <= 0.3 AND stl >= 0.7 THEN 'perimeter_specialist' END AS archetype, round(ppg, 6) AS ppg_pct FROM r""",
)
def archetypes(spark: SparkSession, sf: str) -> DataFrame:
    s = player_stats(spark, sf).groupBy("player", F.year("stat_date").alias("season")).pivot("stat_name", ["PTS", "REB", "AST", "BLK", "STL"]).agg(F.avg("stat_value")).toDF("player", "season", "ppg", "reb", "ast", "blk", "stl")
    known = F.col("season") >= 1995  # minutes and usage are on record from then on only
    s = s.withColumns({"minutes": F.when(known, 10.0 + F.col("player") % 25), "usage": F.when(known, ((F.col("player") * 7) % 31).cast("double"))})
    return O.archetype_rules(s, "season").select("player", "season", "archetype", r6(F.col("ppg_pct")).alias("ppg_pct"))
