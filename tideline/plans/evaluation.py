"""Metrics, baselines, folds, profiles and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import normal_cdf, normal_cdf_sql
from tideline.operators import evaluate as O
from tideline.operators.windows import by, r6
from tideline.plans import query
from tideline.sources.views import games, table, with_views

_NAIVE = """n AS (SELECT game_id, season_id, game_date, CAST(pts_home - pts_away AS DOUBLE) AS diff, CAST(pts_home + pts_away AS DOUBLE) AS total,
  avg(pts_home - pts_away) OVER w AS pred_diff, avg(pts_home + pts_away) OVER w AS pred_total FROM games WINDOW w AS (PARTITION BY home ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def _naive(spark: SparkSession, sf: str) -> DataFrame:
    w = by("home").rowsBetween(-10, -1)
    d, t = F.col("pts_home") - F.col("pts_away"), F.col("pts_home") + F.col("pts_away")
    return games(spark, sf).select("game_id", "season_id", "game_date", d.cast("double").alias("diff"), t.cast("double").alias("total"), F.avg(d).over(w).alias("pred_diff"), F.avg(t).over(w).alias("pred_total"))


def _metrics_sql(key: str) -> str:
    return f"""s AS (SELECT *, stddev_pop(diff - pred_diff) OVER (PARTITION BY {key}) AS sd FROM n WHERE pred_diff IS NOT NULL),
q AS (SELECT *, CASE WHEN sd > 0 THEN {normal_cdf_sql('(pred_diff / nullif(sd, 0))')} ELSE CAST(pred_diff > 0 AS INTEGER) END AS p FROM s),
met AS (SELECT {key}, CAST(count(*) AS BIGINT) AS n, round(avg(abs(pred_diff - diff)), 6) AS diff_mae, round(sqrt(avg((pred_diff - diff) * (pred_diff - diff))), 6) AS diff_rmse, round(avg(abs(pred_total - total)), 6) AS total_mae,
  round(avg(CAST(abs(pred_diff - diff) <= 10 AS INTEGER)), 6) AS within, round(avg(CAST((pred_diff > 0) = (diff > 0) AS INTEGER)), 6) AS win_accuracy,
  round(avg((p - CAST(diff > 0 AS INTEGER)) * (p - CAST(diff > 0 AS INTEGER))), 6) AS brier, round(coalesce(corr(pred_diff, diff), 0), 6) AS corr FROM q GROUP BY 1)"""


@query("A17, A18, M8, P23, E2", f"WITH {with_views('games')}, {_NAIVE}, {_metrics_sql('season_id')} SELECT * FROM met")
def naive_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return O.error_metrics(_naive(spark, sf), ["season_id"])


@query("E3, E6, A22", f"WITH {with_views('games')}, {_NAIVE}, {_metrics_sql('season_id')} SELECT round(avg(diff_mae / 15.0 + 0.5 * total_mae / 20.0), 6) AS mean, round(stddev_samp(diff_mae / 15.0 + 0.5 * total_mae / 20.0), 6) AS sd, round(min(diff_mae / 15.0 + 0.5 * total_mae / 20.0), 6) AS lowest, round(max(diff_mae / 15.0 + 0.5 * total_mae / 20.0), 6) AS highest FROM met")
def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = O.error_metrics(_naive(spark, sf), ["season_id"])
    c = O.composite(F.col("diff_mae"), F.col("total_mae"), F.lit(15.0), F.lit(20.0))
    return m.select(c.alias("c")).agg(r6(F.avg("c")).alias("mean"), r6(F.stddev_samp("c")).alias("sd"), r6(F.min("c")).alias("lowest"), r6(F.max("c")).alias("highest"))


@query("P23", f"SELECT o_orderkey, round({normal_cdf_sql('((o_orderkey % 61 - 30) / 10.0)')}, 6) AS p FROM orders")
def win_probability(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", r6(normal_cdf((F.col("o_orderkey") % 61 - 30) / 10.0)).alias("p"))


_FOLDS = (O.Fold("f1", "2017-03-31", "2017-04-01", "2017-06-30", "2017-07-01", "2017-09-30"), O.Fold("f2", "2017-12-31", "2018-01-01", "2018-03-31", "2018-04-01", "2018-06-30"))


def _fold_sql(f: O.Fold) -> str:
    """A fold's rows with predictions: least squares of two features by their covariances, fitted up to train_end."""
    fit = ", ".join(
        f"(covar_pop(x1, {y}) * var_pop(x2) - covar_pop(x2, {y}) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2) AS {y}1, "
        f"(covar_pop(x2, {y}) * var_pop(x1) - covar_pop(x1, {y}) * covar_pop(x1, x2)) / (var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) ** 2) AS {y}2, avg({y}) AS {y}0"
        for y in ("diff", "total")
    )
    part = f"CASE WHEN game_date <= DATE '{f.val_end}' THEN '{f.name} val' WHEN game_date >= DATE '{f.test_start}' THEN '{f.name} test' END"
    return f"""{f.name}m AS (SELECT avg(pred_diff) AS m1, avg(pred_total) AS m2 FROM n0 WHERE game_date <= DATE '{f.train_end}'),
{f.name}x AS (SELECT *, coalesce(pred_diff, m1) AS x1, coalesce(pred_total, m2) AS x2 FROM n0, {f.name}m),
{f.name}f AS (SELECT {fit}, avg(x1) AS a1, avg(x2) AS a2 FROM {f.name}x WHERE game_date <= DATE '{f.train_end}'),
{f.name} AS (SELECT {part} AS k, diff, total, diff0 + diff1 * (x1 - a1) + diff2 * (x2 - a2) AS pred_diff, total0 + total1 * (x1 - a1) + total2 * (x2 - a2) AS pred_total FROM {f.name}x, {f.name}f WHERE game_date BETWEEN DATE '{f.val_start}' AND DATE '{f.test_end}')"""


@query(
    "E1, E4, E5, E6, M9",
    f"WITH {with_views('games')}, {_NAIVE.replace('n AS (', 'n0 AS (', 1)}, {', '.join(map(_fold_sql, _FOLDS))}, n AS ({' UNION ALL '.join(f'SELECT * FROM {f.name} WHERE k IS NOT NULL' for f in _FOLDS)}), {_metrics_sql('k')} SELECT string_split(k, ' ')[2] AS part, met.* EXCLUDE (k), string_split(k, ' ')[1] AS fold FROM met",
)
def rolling_origin_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _naive(spark, sf).withColumnsRenamed({"pred_diff": "form", "pred_total": "pace"})
    model = O.linear_model(["form", "pace"], {"diff": "pred_diff", "total": "pred_total"})
    return O.rolling_origin(rows, "game_date", _FOLDS, model)


_COLS = ("fga_home", "fgm_home", "pts_home", "pts_away")


@query(
    "A30",
    f"WITH {with_views('games')} " + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(count({c}) AS BIGINT) AS n, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS null_rate, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest, round(skewness({c}), 6) AS skew FROM games" for c in _COLS),
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return O.profile(games(spark, sf), _COLS)


@query("A30, O4", f"WITH {with_views('games')} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM games" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") WHERE abs(corr) >= 0.0001")
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.correlations(games(spark, sf), _COLS, 0.0001)


@query("A31", f"WITH {with_views('games')} SELECT 'high' AS rule, CAST(count(*) FILTER (WHERE pts_home > 130) AS BIGINT) AS n_bad FROM games UNION ALL SELECT 'makes', CAST(count(*) FILTER (WHERE fgm_home > fga_home) AS BIGINT) FROM games UNION ALL SELECT 'margin', CAST(count(*) FILTER (WHERE abs(pts_home - pts_away) > 45) AS BIGINT) FROM games")
def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    return O.quality_checks(games(spark, sf), {"high": F.col("pts_home") > 130, "makes": F.col("fgm_home") > F.col("fga_home"), "margin": F.abs(F.col("pts_home") - F.col("pts_away")) > 45})


@query("A31, O4", f"WITH {with_views('games')} SELECT game_id, abs(pts_home - pts_away) AS margin FROM games WHERE abs(pts_home - pts_away) > 20 ORDER BY margin DESC, game_id LIMIT 10")
def worst_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = F.abs(F.col("pts_home") - F.col("pts_away"))
    return games(spark, sf).select("game_id", m.alias("margin")).where("margin > 20").orderBy(F.desc("margin"), "game_id").limit(10)
