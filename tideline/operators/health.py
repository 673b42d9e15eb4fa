"""Injuries: severity, deficits, streaks, roster scores, name resolution, calibration and adjusted fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators.asof import active_near, asof_backward
from tideline.operators.windows import by, lagged, r6

DOUBTFUL = 0.8


def status_weight(doubtful: float = DOUBTFUL) -> Column:
    return F.when(F.col("status") == "Out", 1.0).when(F.col("status") == "Doubtful", doubtful).otherwise(0.0)


def status_counts(injuries: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = {"n_out": ("Out",), "n_doubtful": ("Doubtful",), "n_questionable": ("Questionable", "Day-To-Day")}
    return injuries.groupBy(*keys).agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in named.items()])


def max_severity(injuries: DataFrame, keys: Sequence[str], statuses: Sequence[str] = ("Out", "Doubtful")) -> DataFrame:
    """Per key the heaviest severity among listed players, two-way players left out; Doubtful counts in part."""
    rows = injuries.where(F.col("status").isin(*statuses) & ~C.is_two_way(F.col("reason")))
    return rows.groupBy(*keys).agg(F.max(C.severity_weight(F.col("reason")) * status_weight()).alias("severity"))


def importance(snaps: DataFrame, keys: Sequence[str], weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """A player's weight in a team: share of minutes, usage against the highest, share of points, mixed and kept between 0 and 1."""
    w = W.partitionBy(*keys)
    share = lambda c: F.coalesce(C.safe_div(F.col(c), F.sum(c).over(w)), F.lit(0.0))
    usage = F.coalesce(C.safe_div(F.col("usage"), F.max("usage").over(w)), F.lit(0.0))
    return snaps.withColumn("importance", C.clip(weights[0] * share("minutes") + weights[1] * usage + weights[2] * share("points"), 0, 1))


def team_deficit(injuries: DataFrame, importances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is missing against what is left: missing / max(total - missing, 0.01), half-even to 4 digits; 0 for a team without any
    importance. importances: team, player, importance."""
    weight = F.when(C.is_two_way(F.col("reason")), 0.0).otherwise(C.severity_weight(F.col("reason")) * status_weight())
    total = importances.groupBy("team").agg(F.sum("importance").alias("total"))
    rows = injuries.join(importances, ["team", "player"], "left").withColumn("_w", weight * F.coalesce("importance", F.lit(0.0)))
    missing = rows.groupBy(*keys).agg(F.sum("_w").alias("missing"))
    return missing.join(total, "team", "left").withColumn("deficit", F.when(F.coalesce("total", F.lit(0.0)) <= 0, 0.0).otherwise(C.half_even(F.col("missing") / F.greatest(F.col("total") - F.col("missing"), F.lit(0.01)), 4)))


def missing_impact(team_dates: DataFrame, injuries: DataFrame, impacts: DataFrame, gate: float = 15.0) -> DataFrame:
    """Weighted sum and number of the Out and Doubtful players' impacts per team-date; 0 where nobody is out.

    A player's impact is that of the latest row before the date (the same day is not used) with enough minutes.
    impacts: player, as_of_date, impact, minutes.
    """
    listed = injuries.where(F.col("status").isin("Out", "Doubtful"))
    rated = asof_backward(listed, impacts.where(F.col("minutes") >= gate), ["player"], "game_date", "as_of_date", ["impact"], lag_days=1)
    sums = rated.groupBy("game_date", "team").agg(F.sum(status_weight() * F.col("impact")).alias("missing_impact"), F.count("impact").alias("n_rated"))
    out = team_dates.join(sums, ["game_date", "team"], "left")
    return out.withColumns({"missing_impact": F.coalesce("missing_impact", F.lit(0.0)), "n_rated": F.coalesce("n_rated", F.lit(0))})


def with_coverage(team_dates: DataFrame, injuries: DataFrame) -> DataFrame:
    """has_injury_data: whether the date occurs in the report at all."""
    days = injuries.select("game_date").distinct().withColumn("_seen", F.lit(True))
    return team_dates.join(days, "game_date", "left").withColumn("has_injury_data", F.col("_seen").isNotNull().cast("int")).drop("_seen")


def absence_runs(team_games: DataFrame, injuries: DataFrame) -> DataFrame:
    """player, team, game_id, streak: the place of every game out in its run of the team's games.

    A team's games are numbered once; the number less the rank among a player's absences is the same throughout a run. So only
    absences are sorted by player, and no row is made for a game played. team_games: team, game_id, game_date.
    """
    numbered = team_games.withColumn("_i", F.row_number().over(by("team")))
    out = injuries.where("status = 'Out'").select("player", "team", "game_id").distinct().join(numbered.select("team", "game_id", "_i"), ["team", "game_id"])
    ranked = out.withColumn("_run", F.col("_i") - F.row_number().over(W.partitionBy("player", "team").orderBy("_i")))
    place = F.col("_i") - F.min("_i").over(W.partitionBy("player", "team", "_run")) + 1
    return ranked.select("player", "team", "game_id", place.cast("long").alias("streak"))


def absence_streaks(schedule: DataFrame, runs: DataFrame) -> DataFrame:
    """schedule (player, team, game_id, ...) with the place in the run of games out, 0 on a game played. runs: absence_runs()."""
    return schedule.join(runs, ["player", "team", "game_id"], "left").withColumn("streak", F.coalesce("streak", F.lit(0)).cast("long"))


def min_streak(streaks: DataFrame, halflife: float) -> DataFrame:
    """Per team-game the freshest absence and its weight."""
    rows = streaks.where("streak > 0").groupBy("game_id", "team").agg(F.min("streak").alias("freshest"))
    return rows.withColumn("weight", C.decay(F.col("freshest") - 1, halflife))


def roster_scores(team_dates: DataFrame, injuries: DataFrame, importances: DataFrame) -> DataFrame:
    """Share of importance that sits although not injured: listed out for a reason that is none."""
    total = importances.groupBy("team").agg(F.sum("importance").alias("total"))
    sat = injuries.where((F.col("status") == "Out") & ~C.is_injury(F.col("reason"))).select("game_date", "team", "player").distinct()
    sat = sat.join(importances, ["team", "player"]).groupBy("game_date", "team").agg(F.sum("importance").alias("sat"))
    out = team_dates.join(sat, ["game_date", "team"], "left").join(total, "team", "left")
    return out.withColumn("roster_score", F.coalesce(C.safe_div(F.coalesce("sat", F.lit(0.0)), F.col("total")), F.lit(0.0))).drop("sat", "total")


def minutes_trend(at: DataFrame, snaps: DataFrame, weeks: int) -> DataFrame:
    """Relative drop of minutes from the snapshot at least `weeks` weeks back to the latest before the date; 0 without both.
    at: entity, d."""
    now = asof_backward(at, snaps.select("entity", "as_of_date", F.col("minutes").alias("_now"), F.col("points").alias("_weight")), ["entity"], "d", "as_of_date", ["_now", "_weight"], lag_days=1)
    then = asof_backward(now, snaps.select("entity", "as_of_date", F.col("minutes").alias("_then")), ["entity"], "d", "as_of_date", ["_then"], lag_days=7 * weeks)
    drop = C.safe_div(F.col("_then") - F.col("_now"), F.col("_then"))
    return then.select(*at.columns, F.coalesce(drop, F.lit(0.0)).alias("drop"), F.coalesce("_weight", F.lit(0.0)).alias("weight"))


def calibration(values: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: weighted mean of the rows with a weight above 0 less the mean of the others in the same team-seasons
    that have any such row, half-even to 4 digits. values: team, season_id, weight, group and the metrics."""
    inside = F.max(F.when(F.col("weight") > 0, 1).otherwise(0)).over(W.partitionBy("team", "season_id", group)) == 1
    rows = values.withColumn("_in", inside).where("_in").unpivot([group, "weight"], list(metrics), "metric", "value")
    w = F.col("weight")
    hurt = C.safe_div(F.sum(F.when(w > 0, w * F.col("value"))), F.sum(F.when((w > 0) & F.col("value").isNotNull(), w)))
    base = F.avg(F.when(w == 0, F.col("value")))
    return rows.groupBy(group, "metric").agg(C.half_even(hurt - base, 4).alias("delta"), F.count_if(w > 0).alias("n_missing"))


def adjusted(fingerprints: DataFrame, severities: DataFrame, deltas: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Fingerprints plus, per metric, the sum of delta x severity over the archetypes missing. severities: keys, archetype,
    severity; deltas: archetype, metric, delta; Spark broadcasts these where their size allows."""
    shift = severities.join(deltas, "archetype").groupBy(*keys).agg(*[F.sum(F.when(F.col("metric") == m, F.col("delta") * F.col("severity"))).alias(f"_{m}") for m in metrics])
    out = fingerprints.join(shift, list(keys), "left")
    return out.withColumns({m: F.col(m) + F.coalesce(f"_{m}", F.lit(0.0)) for m in metrics}).drop(*[f"_{m}" for m in metrics])


def resolve_names(reports: DataFrame, index: DataFrame, activity: DataFrame, days: int = 60) -> DataFrame:
    """printed, player, method, confidence: the id of every printed name.

    reports: printed, report_date; index: player, full_name; activity: player, active_date. Candidates share the normalised name;
    where that is empty or unknown, those of exactly this spelling (exact_fallback). One candidate: high. Of several the only one
    active within `days` days of the name's first report: medium (+disambiguated). None or more than one active: the smallest id
    of those active, or of all, at low (+ambiguous). No candidate: none (unmatched). A null name is unmatched.
    """
    key = lambda c: F.nullif(C.normal_name(F.col(c)), F.lit(""))
    names = reports.groupBy("printed").agg(F.min("report_date").alias("_first")).withColumn("_k", key("printed"))
    ids = index.select("player", "full_name", key("full_name").alias("_k")).distinct()
    plain = names.join(ids.select("player", "_k"), "_k").select("printed", "_first", "player", F.lit("normalized").alias("method"))
    unknown = names.join(ids.select("_k").distinct(), "_k", "left_anti")
    exact = unknown.join(ids.select("player", F.col("full_name").alias("printed")), "printed").select("printed", "_first", "player", F.lit("exact_fallback").alias("method"))
    found = plain.unionAll(exact).withColumn("_n", F.count("*").over(W.partitionBy("printed")))
    near = active_near(found.where("_n > 1"), activity, "player", "_first", "active_date", days).select("printed", "player", F.lit(True).alias("_active"))
    per = found.join(near, ["printed", "player"], "left").groupBy("printed", "method").agg(F.count("*").alias("_n"), F.count("_active").alias("_active"), F.min("player").alias("_least"), F.min(F.when(F.col("_active"), F.col("player"))).alias("_most"))
    out = names.select("printed").join(per, "printed", "left")
    one, only = F.col("_n") == 1, F.col("_active") == 1
    method = F.when(F.col("_n").isNull(), "unmatched").when(one, F.col("method")).when(only, F.concat("method", F.lit("+disambiguated"))).otherwise(F.concat("method", F.lit("+ambiguous")))
    confidence = F.when(F.col("_n").isNull(), "none").when(one, "high").when(only, "medium").otherwise("low")
    return out.select("printed", F.coalesce("_most", "_least").alias("player"), method.alias("method"), confidence.alias("confidence"))


def absence_factor(rows: DataFrame, keys: Sequence[str], window: float) -> DataFrame:
    """Importance-weighted mean of the decay by games missed. rows: keys, importance, games_out."""
    f = C.absence_decay(F.col("games_out"), window)
    return rows.groupBy(*keys).agg(r6(C.safe_div(F.sum(F.col("importance") * f), F.sum("importance"))).alias("absence_factor"))


# Rank shares that bound the archetypes, and the least minutes for usage to count.
ARCHETYPES = {
    "combo": {"ppg": 0.85, "ast": 0.85, "usage": 0.80, "ast_rate": 0.80},
    "facilitator": {"ast": 0.65, "ppg": 0.35},
    "scorer": {"ppg": 0.65, "ast": 0.35},
    "rim_protector": {"blk": 0.75, "reb": 0.75},
    "perimeter_specialist": {"blk": 0.30, "stl": 0.70},
}
LEAST_MINUTES = 5.0


def archetype_rules(df: DataFrame, season: str, bounds: Mapping[str, Mapping[str, float]] = ARCHETYPES) -> DataFrame:
    """The first archetype whose bounds a player-season's rank shares meet, else NULL.

    df: season, ppg, ast, blk, reb, stl, and minutes and usage, which may be NULL: then, or with too few minutes, combo goes by points
    and assists instead of usage and assists a minute. Shares are within the season, of rows that have the value.
    """
    has_usage = F.col("minutes").isNotNull() & F.col("usage").isNotNull() & (F.col("minutes") >= LEAST_MINUTES)
    ranked = df.withColumns({"_usage": F.when(has_usage, F.col("usage")), "_ast_rate": F.when(has_usage, C.safe_div(F.col("ast"), F.col("minutes")))})
    ranked = ranked.withColumns({f"{c}_pct": C.rank_pct(F.col(c), season) for c in ("ppg", "ast", "blk", "reb", "stl")})
    ranked = ranked.withColumns({f"{c}_pct": C.rank_pct(F.col(f"_{c}"), season) for c in ("usage", "ast_rate")})
    p = lambda c: F.col(f"{c}_pct")
    combo, fac, sco, rim, per = (bounds[k] for k in ("combo", "facilitator", "scorer", "rim_protector", "perimeter_specialist"))
    by_usage = (p("usage") >= combo["usage"]) & (p("ast_rate") >= combo["ast_rate"])
    is_combo = F.when(p("usage").isNotNull() & p("ast_rate").isNotNull(), by_usage).otherwise((p("ppg") >= combo["ppg"]) & (p("ast") >= combo["ast"]))
    kind = (
        F.when(is_combo, "combo")
        .when((p("ast") >= fac["ast"]) & (p("ppg") <= fac["ppg"]), "facilitator")
        .when((p("ppg") >= sco["ppg"]) & (p("ast") <= sco["ast"]), "scorer")
        .when((p("blk") >= rim["blk"]) & (p("reb") >= rim["reb"]), "rim_protector")
        .when((p("blk") <= per["blk"]) & (p("stl") >= per["stl"]), "perimeter_specialist")
    )
    return ranked.withColumn("archetype", kind).drop("_usage", "_ast_rate")


def games_out_before(injuries: DataFrame) -> DataFrame:
    """Number of earlier reports that list the player as out."""
    w = lagged(by("player"))
    return injuries.withColumn("games_out", F.coalesce(F.sum((F.col("status") == "Out").cast("int")).over(w), F.lit(0)))
