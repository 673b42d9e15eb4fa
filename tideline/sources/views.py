"""Adapter views over the given tables, each as a DataFrame and as DuckDB SQL.

All formulas are whole-number arithmetic on table columns, so both engines see the same rows. Games follow the circle method:
30 teams, 15 games a play day, every team once a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = 30
PER_DAY = 15
DAYS_PER_SEASON = 58


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a, b: int) -> Column:
    """Whole-number division of non-negative longs."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(b)).cast("long")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a game, from orders."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("k"), "o_totalprice")
    o = o.withColumns({"d": _div("k", PER_DAY), "s": F.col("k") % PER_DAY})
    last = TEAMS - 1
    a = F.when(F.col("s") == 0, F.lit(last)).otherwise((F.col("d") + F.col("s")) % last)
    b = F.when(F.col("s") == 0, F.col("d") % last).otherwise((F.col("d") - F.col("s") + last * 1_000_000) % last)
    swap = (_div("d", last) + F.col("s")) % 2 == 1
    ph = F.lit(85) + F.floor("o_totalprice").cast("long") % 50
    pa = F.lit(85) + _div(F.floor(F.col("o_totalprice") * 100).cast("long"), 7) % 50
    o = o.withColumns({"a": a, "b": b, "ph": ph, "pa": pa})

    def shots(offset: int) -> dict[str, Column]:
        x = F.col("k") + offset
        return {"fga": 78 + x % 17, "fgm": 30 + (x * 7) % 19, "fg3a": 22 + x % 13, "fg3m": 6 + (x * 5) % 11, "fta": 16 + x % 11, "ftm": 9 + (x * 3) % 8, "ast": 17 + (x * 11) % 14, "oreb": 6 + x % 7, "tov": 9 + (x * 2) % 9}

    sides = {f"{n}_{side}": c.cast("long").alias(f"{n}_{side}") for side, off in (("home", 0), ("away", 5)) for n, c in shots(off).items()}
    return o.select(
        F.col("k").alias("game_id"),
        F.date_add(F.to_date(F.lit("2016-10-01")), (F.col("d") + _div("d", 2) + 3 * _div("d", 10)).cast("int")).alias("game_date"),
        (22000 + _div("d", DAYS_PER_SEASON)).cast("int").alias("season_id"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).cast("int").alias("home"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).cast("int").alias("away"),
        (F.col("ph") + (F.col("ph") == F.col("pa")).cast("long")).alias("pts_home"),
        F.col("pa").alias("pts_away"),
        *sides.values(),
    )


def _sql_shots() -> str:
    out = []
    for side, off in (("home", 0), ("away", 5)):
        x = f"(k + {off})"
        for n, e in {"fga": f"78 + {x} % 17", "fgm": f"30 + ({x} * 7) % 19", "fg3a": f"22 + {x} % 13", "fg3m": f"6 + ({x} * 5) % 11", "fta": f"16 + {x} % 11", "ftm": f"9 + ({x} * 3) % 8", "ast": f"17 + ({x} * 11) % 14", "oreb": f"6 + {x} % 7", "tov": f"9 + ({x} * 2) % 9"}.items():
            out.append(f"CAST({e} AS BIGINT) AS {n}_{side}")
    return ", ".join(out)


def perspective(g: DataFrame, *extra: str) -> DataFrame:
    """Two rows a game, one for each side, from a single scan. extra: names that exist with _home and _away."""

    def side(own: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(own).alias("team"),
            F.col(other).alias("opponent"),
            F.lit(home).alias("is_home"),
            F.col(f"pts_{own}").alias("pts"),
            F.col(f"pts_{other}").alias("opp_pts"),
            *[F.col(f"{n}_{own}").alias(n) for n in extra],
        )

    rows = F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("r")
    return g.select("game_id", "game_date", "season_id", rows).select("game_id", "game_date", "season_id", "r.*").withColumn("win", (F.col("pts") > F.col("opp_pts")).cast("int"))


STYLE = ("fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "ast", "oreb", "tov")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, ts, price, size, side, is_ref, from events; prices lie between 0 and 1."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("market"),
        "ts",
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.floor(F.col("value") / 600.0 * 10000) / 10000.0)).alias("price"),
        (F.col("event_id") % 20 + 1).alias("size"),
        F.when(F.col("event_type").isin("purchase", "click"), "BUY").otherwise("SELL").alias("side"),
        (F.col("event_id") % 2 == 0).alias("is_ref"),
        "event_id",
    )


def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, stat_date, stat_name, stat_value: one value a player, day and statistic, from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(F.col("l_suppkey").alias("player"), F.to_date("l_shipdate").alias("stat_date")).agg(F.sum("l_quantity").alias("PTS"), F.count("*").cast("double").alias("REB"), F.max("l_linenumber").cast("double").alias("AST"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("BLK"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double").alias("STL"))
    return daily.unpivot(["player", "stat_date"], ["PTS", "REB", "AST", "BLK", "STL"], "stat_name", "stat_value")


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_date, team, player, status, reason: three listed players for some team-games, from games."""
    g = perspective(games(spark, sf_dir)).select("game_id", "game_date", "team")
    rows = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    x = F.col("game_id") * 3 + F.col("team") + F.col("slot")
    status = F.element_at(F.array(*[F.lit(s) for s in ("Out", "Doubtful", "Questionable", "Available")]), (x % 4 + 1).cast("int"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (x % len(REASONS) + 1).cast("int"))
    out = rows.withColumns({"x": x, "player": (F.col("team") * 15 + F.col("slot") * 5 + (_div("game_id", 15) + F.col("slot")) % 5).cast("long")})
    return out.where(F.col("x") % 5 != 0).select("game_id", "game_date", "team", "player", status.alias("status"), reason.alias("reason"))


REASONS = ("Torn left ACL", "Right ankle sprain", "Illness", "Rest", "Sore knee", "G League - Two-Way", "Coach's Decision", "Fracture, hand")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, as_of_date, gp, minutes, points, usage: a customer's cumulative state at the end of each 7-day bucket, from orders."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")) / 7).alias("week"), F.floor("o_totalprice").cast("long").alias("v"))
    weekly = o.groupBy("entity", "week").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    run = W.partitionBy("entity").orderBy("week").rowsBetween(W.unboundedPreceding, 0)
    return weekly.select(
        "entity",
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("week") * 7 + 7).cast("int")).alias("as_of_date"),
        F.sum("n").over(run).alias("gp"),
        (12 + F.col("v") % 25).cast("double").alias("minutes"),
        (4 + F.col("v") % 23).cast("double").alias("points"),
        ((5 + F.col("v") % 27) / 100.0).alias("usage"),
    )


#: The views' SQL by name, and what each is built on.
_SQL = {
    "games": (
        (),
        f"""SELECT k AS game_id, DATE '2016-10-01' + CAST(d + d // 2 + 3 * (d // 10) AS INTEGER) AS game_date, CAST(22000 + d // {DAYS_PER_SEASON} AS INTEGER) AS season_id,
       CAST(CASE WHEN (d // 29 + s) % 2 = 1 THEN b ELSE a END AS INTEGER) AS home, CAST(CASE WHEN (d // 29 + s) % 2 = 1 THEN a ELSE b END AS INTEGER) AS away,
       CAST(ph + CASE WHEN ph = pa THEN 1 ELSE 0 END AS BIGINT) AS pts_home, CAST(pa AS BIGINT) AS pts_away, {_sql_shots()}
  FROM (SELECT *, CASE WHEN s = 0 THEN 29 ELSE (d + s) % 29 END AS a, CASE WHEN s = 0 THEN d % 29 ELSE (d - s + 29000000) % 29 END AS b,
               85 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS ph, 85 + (CAST(floor(o_totalprice * 100) AS BIGINT) // 7) % 50 AS pa
          FROM (SELECT o_orderkey AS k, o_orderkey // 15 AS d, o_orderkey % 15 AS s, o_totalprice FROM orders))""",
    ),
    "tg": (
        ("games",),
        "SELECT *, CASE WHEN pts > opp_pts THEN 1 ELSE 0 END AS win FROM ("
        + " UNION ALL ".join(
            f"SELECT game_id, game_date, season_id, {own} AS team, {other} AS opponent, {home} AS is_home, pts_{own} AS pts, pts_{other} AS opp_pts, " + ", ".join(f"{n}_{own} AS {n}" for n in STYLE) + " FROM games"
            for own, other, home in (("home", "away", "true"), ("away", "home", "false"))
        )
        + ")",
    ),
    "ticks": (
        (),
        """SELECT user_id AS market, ts, least(0.99, greatest(0.01, floor(value / 600.0 * 10000) / 10000.0)) AS price, event_id % 20 + 1 AS size,
       CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' ELSE 'SELL' END AS side, event_id % 2 = 0 AS is_ref, event_id FROM events""",
    ),
    "pdaily": ((), "SELECT l_suppkey AS player, CAST(l_shipdate AS DATE) AS stat_date, sum(l_quantity) AS PTS, CAST(count(*) AS DOUBLE) AS REB, CAST(max(l_linenumber) AS DOUBLE) AS AST, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS BLK, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS STL FROM lineitem GROUP BY 1, 2"),
    "pstats": (("pdaily",), "SELECT player, stat_date, 'PTS' AS stat_name, PTS AS stat_value FROM pdaily UNION ALL SELECT player, stat_date, 'REB', REB FROM pdaily UNION ALL SELECT player, stat_date, 'AST', AST FROM pdaily UNION ALL SELECT player, stat_date, 'BLK', BLK FROM pdaily UNION ALL SELECT player, stat_date, 'STL', STL FROM pdaily"),
    "inj": (
        ("tg",),
        "SELECT game_id, game_date, team, CAST(team * 15 + slot * 5 + (game_id // 15 + slot) % 5 AS BIGINT) AS player, "
        "(['Out', 'Doubtful', 'Questionable', 'Available'])[x % 4 + 1] AS status, (["
        + ", ".join("'" + r.replace("'", "''") + "'" for r in REASONS)
        + f"])[x % {len(REASONS)} + 1] AS reason FROM (SELECT game_id, game_date, team, slot, game_id * 3 + team + slot AS x FROM tg, range(3) t(slot)) WHERE x % 5 <> 0",
    ),
    "snaps": (
        (),
        """SELECT entity, DATE '1990-01-01' + CAST(week * 7 + 7 AS INTEGER) AS as_of_date, CAST(sum(n) OVER (PARTITION BY entity ORDER BY week) AS BIGINT) AS gp,
       CAST(12 + v % 25 AS DOUBLE) AS minutes, CAST(4 + v % 23 AS DOUBLE) AS points, (5 + v % 27) / 100.0 AS usage
  FROM (SELECT o_custkey AS entity, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) // 7 AS week, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1, 2)""",
    ),
}


def with_views(*names: str) -> str:
    """'WITH RECURSIVE'-ready list of CTEs for the named views and all they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for base in _SQL[name][0]:
            add(base)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in order)
