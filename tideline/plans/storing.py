"""What is written and read back, settings, and searches over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import Config, get_value
from tideline.operators import evaluate as O
from tideline.operators import search as S
from tideline.operators.form import rolling_form
from tideline.operators.windows import by, lagged, r6
from tideline.plans import query
from tideline.sources import sinks, stored
from tideline.sources.views import games, perspective, table, ticks, with_views


@query("S22", f"WITH {with_views('games')} SELECT game_id, home, away, CAST(pts_home AS BIGINT) AS pts_home FROM games")
def json_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.shared_path(spark, "cache")
    g = games(spark, sf).select("game_id", "home", "away", F.col("pts_home").cast("long"))
    sinks.write_json(g, path)
    return spark.read.schema(g.schema).json(path)


@query("S23", f"WITH {with_views('ticks')} SELECT market, ts, price FROM ticks WHERE side = 'BUY'")
def series_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.shared_path(spark, "series")
    sinks.write_series(ticks(spark, sf), path, ["side"])
    return sinks.read_series(spark, path, ["market", "ts", "price"], side="BUY")


@query("S25", "SELECT 'all' AS run, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean FROM orders UNION ALL SELECT 'urgent', count(*), NULL FROM orders WHERE o_orderpriority = '1-URGENT'")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.shared_path(spark, "runs")
    o = table(spark, sf, "orders")
    n, mean = o.agg(F.count("*"), F.avg("o_totalprice")).collect()[0]
    sinks.append_run(spark, path, {"run": "all", "n": n, "mean": mean})
    sinks.append_run(spark, path, {"run": "urgent", "n": o.where("o_orderpriority = '1-URGENT'").count()})
    return sinks.read_runs(spark, path).select("run", F.col("n").cast("long").alias("n"), F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query("S29", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders) SELECT o_orderkey, round((o_totalprice - m) / d, 4) AS z FROM orders, s")
def saved_scale(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.shared_path(spark, "model")
    o = table(spark, sf, "orders")
    mean, sd = o.agg(F.avg("o_totalprice"), F.stddev_samp("o_totalprice")).collect()[0]
    sinks.save_model({"mean": mean, "sd": sd}, spark, path)
    fitted = sinks.load_model(spark, path)
    return o.select("o_orderkey", F.round((F.col("o_totalprice") - fitted["mean"]) / fitted["sd"], 4).alias("z"))


_PATHS = ("elo.k", "elo.regression", "features.naive_window", "features.neighbours", "composite_weight", "features.missing", "none.at.all")


@query("P24", "SELECT * FROM (VALUES ('elo.k', 11.02), ('elo.regression', 0.522), ('features.naive_window', 10.0), ('features.neighbours', 81.0), ('composite_weight', 0.5), ('features.missing', -1.0), ('none.at.all', -1.0)) t(path, value)".replace("11.02", "CAST(11.02 AS DOUBLE)"))
def config_values(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(p, float(get_value(Config(), p, -1))) for p in _PATHS], "path string, value double")


def _with_form(df: DataFrame) -> DataFrame:
    return df.withColumn("form", F.avg("margin").over(lagged(by("home"), 10)))


def _with_place(df: DataFrame) -> DataFrame:
    return df.withColumn("edge", F.lit(3.0)).withColumn("long_form", F.avg("margin").over(lagged(by("home"))))


def _margins(spark: SparkSession, sf: str) -> DataFrame:
    return games(spark, sf).select("game_id", "game_date", "home", (F.col("pts_home") - F.col("pts_away")).cast("double").alias("margin"))


@query("E9", "SELECT * FROM (VALUES ('form', 'recent form'), ('edge', 'place'), ('long_form', 'place')) t(name, family)")
def feature_families(spark: SparkSession, sf: str) -> DataFrame:
    found = O.families(_margins(spark, sf), [("recent form", _with_form), ("place", _with_place)])
    return spark.createDataFrame(list(found.items()), "name string, family string")


_M = "m AS (SELECT game_id, game_date, home, CAST(pts_home - pts_away AS DOUBLE) AS margin FROM games)"


@query(
    "E8",
    f"""WITH {with_views('games')}, {_M}, f AS (SELECT margin, coalesce(avg(margin) OVER (PARTITION BY home ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS form FROM m),
s AS (SELECT avg(abs(margin - form - 3)) AS whole, avg(abs(margin - 3)) AS edge, avg(abs(margin - form)) AS form FROM f)
SELECT 'form' AS flag, round(edge - whole, 6) AS delta FROM s UNION ALL SELECT 'edge', round(form - whole, 6) FROM s""",
)
def flag_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_form(_margins(spark, sf))

    def error(flags) -> float:
        guess = (F.coalesce("form", F.lit(0.0)) if flags["form"] else F.lit(0.0)) + (3.0 if flags["edge"] else 0.0)
        return rows.agg(F.avg(F.abs(F.col("margin") - guess))).collect()[0][0]

    return spark.createDataFrame(list(O.ablation({"form": True, "edge": True}, error).items()), "flag string, delta double").select("flag", r6(F.col("delta")).alias("delta"))


_WINDOWS = (2, 3, 5, 8, 13, 21)


@query(
    "M10",
    f"WITH {with_views('games')}, {_M}, e AS ("
    + " UNION ALL ".join(f"SELECT {w} AS w, avg(abs(margin - p)) AS mae FROM (SELECT margin, avg(margin) OVER (PARTITION BY home ORDER BY game_date, game_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS p FROM m)" for w in _WINDOWS)
    + ") SELECT CAST(w AS INTEGER) AS best, round(mae, 6) AS mae FROM e ORDER BY mae LIMIT 1",
)
def tuned_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = _margins(spark, sf)

    def score(setting) -> float:
        return -rows.select("margin", F.avg("margin").over(lagged(by("home"), setting["window"])).alias("p")).agg(F.avg(F.abs(F.col("margin") - F.col("p")))).collect()[0][0]

    best, least = O.parzen_search({"window": _WINDOWS}, score, trials=6, first=3)
    return spark.createDataFrame([(best["window"], -least)], "best int, mae double").select("best", r6(F.col("mae")).alias("mae"))


_SPACE = {"window": S.Real(2, 82, log=True, whole=True), "shrink": S.Real(0.5, 500, log=True), "edge": S.Real(-10, 15)}


@query("M10")
def tuned_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting that the search tried on the forecast of home margins, and its error; eight settings a job."""
    rows = sinks.staged(_margins(spark, sf), "margins")
    score = S.scored_together(spark, "window double, shrink double, edge double", S.last_n_errors(rows, "home", ("game_date", "game_id"), "margin"))
    tried = S.parzen_batches(_SPACE, score, 48)
    return spark.createDataFrame([(i, s["window"], s["shrink"], s["edge"], -v) for i, (s, v) in enumerate(tried)], "trial int, window double, shrink double, edge double, mae double")


_LATEST = "count(*) AS n_games, CAST(max(game_id) AS BIGINT) AS last_game, CAST(arg_max(pts_home, game_id) AS BIGINT) AS last_pts"
_ROW = "home int, season_id int, n_games long, last_game long, last_pts long"


def _team_seasons(g: DataFrame) -> DataFrame:
    return g.groupBy("home", "season_id").agg(F.count("*").alias("n_games"), F.max("game_id").alias("last_game"), F.max_by("pts_home", "game_id").cast("long").alias("last_pts"))


@query(
    "S8, S9, S24, S27",
    f"""WITH {with_views('games')}, early AS (SELECT home, season_id, {_LATEST} FROM games WHERE game_id % 4 < 2 GROUP BY 1, 2), late AS (SELECT home, season_id, {_LATEST} FROM games WHERE game_id % 3 > 0 AND home % 5 > 0 GROUP BY 1, 2)
SELECT coalesce(l.home, e.home) AS home, coalesce(l.season_id, e.season_id) AS season_id, CASE WHEN coalesce(l.home, e.home) % 3 = 0 AND coalesce(l.season_id, e.season_id) % 2 = 0 THEN -1 ELSE coalesce(l.n_games, e.n_games) END AS n_games, coalesce(l.last_game, e.last_game) AS last_game, coalesce(l.last_pts, e.last_pts) AS last_pts
FROM early e FULL JOIN late l ON l.home = e.home AND l.season_id = e.season_id""",
)
def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, the second one twice, a batch that adds nothing new, and a keyed update of one column, in a stored table."""
    g = games(spark, sf)
    held = stored.Stored(sinks.shared_path(spark, "upserts"), _ROW, ("home", "season_id"), buckets=16)
    early, late = _team_seasons(g.where("game_id % 4 < 2")), _team_seasons(g.where("game_id % 3 > 0 AND home % 5 > 0"))
    held.replace(early)
    held.replace(late)
    held.replace(late)
    held.ignore(early.where("home < 4"))
    held.update(early.unionByName(late).where("home % 3 = 0 AND season_id % 2 = 0").select("home", "season_id").distinct().selectExpr("*", "-1L AS n_games", "0L AS last_game", "0L AS last_pts"), "n_games")
    return held.read(spark)


_FORM = ("game_id", "team", "is_home", "game_date", "pts", "opp_pts", "win", "fgm", "fga", "ftm", "fta")


@query(
    "S10, S16, S15, W2, W3",
    f"WITH {with_views('tg')} SELECT game_id, team, "
    + ", ".join(f"round(avg(win) OVER ({w}), 6) AS win_pct_l{n}, round(avg(pts - opp_pts) OVER ({w}), 6) AS avg_diff_l{n}" for n in (5, 10) for w in [f"PARTITION BY team, is_home ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"])
    + " FROM tg",
)
def incremental_form(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling form made in three runs, each from its new games and the last ten rows a side and role that the run before left."""
    tg = perspective(games(spark, sf), "fgm", "fga", "ftm", "fta").select(*_FORM)
    out, tail = None, tg.limit(0)
    for i, rows in enumerate(("game_id < 405", "game_id BETWEEN 405 AND 899", "game_id >= 900")):  # whole play days
        made, tail = stored.extend(tail, tg.where(rows), ["team", "is_home"], ["game_date", "game_id"], 10, lambda df: rolling_form(df, (5, 10)))
        tail = sinks.staged(tail, f"tail{i}")
        made = made.select("game_id", "team", *[f"{c}_l{n}" for n in (5, 10) for c in ("win_pct", "avg_diff")])
        out = made if out is None else out.unionByName(made)
    return out
