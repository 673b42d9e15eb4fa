"""Scans, projections, upserts, key checks, unpivots and other plain relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import tables as T
from tideline.operators.windows import r6
from tideline.plans import query
from tideline.sources.views import games, injuries, perspective, player_stats, snapshots, table, with_views


@query(
    "S1, S3, P4, O1",
    f"WITH {with_views('games')} SELECT game_id, game_date, season_id, home, away, pts_home - pts_away AS point_diff, pts_home + pts_away AS total_points, CAST(pts_home > pts_away AS INTEGER) AS home_wins FROM games WHERE game_date BETWEEN DATE '2016-11-01' AND DATE '2018-03-31' AND season_id IN (22000, 22002)",
)
def scan_games(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).where(F.col("game_date").between("2016-11-01", "2018-03-31") & F.col("season_id").isin(22000, 22002))
    return g.select("game_id", "game_date", "season_id", "home", "away", (F.col("pts_home") - F.col("pts_away")).alias("point_diff"), (F.col("pts_home") + F.col("pts_away")).alias("total_points"), (F.col("pts_home") > F.col("pts_away")).cast("int").alias("home_wins"))


@query("S2, P13", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rush' ELSE 'normal' END AS pace, round(o_totalprice * 1.1, 6) AS gross FROM orders WHERE o_totalprice > 1000")
def project_case(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_totalprice > 1000")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "rush").otherwise("normal").alias("pace"), r6(F.col("o_totalprice") * 1.1).alias("gross"))


@query("S4, O2, O5, O6", f"WITH {with_views('tg')} SELECT team, game_id, game_date, pts, opp_pts FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_id DESC) AS rn FROM tg) WHERE rn <= 5")
def last_games(spark: SparkSession, sf: str) -> DataFrame:
    return T.last_n(perspective(games(spark, sf)), ["team"], ["game_date", "game_id"], 5).select("team", "game_id", "game_date", "pts", "opp_pts")


@query("S5, A12", f"WITH {with_views('games')} SELECT CAST(count(*) AS BIGINT) AS n_games, min(game_date) AS first_date, max(game_date) AS last_date, CAST(count(DISTINCT season_id) AS BIGINT) AS n_seasons, CAST(count(DISTINCT home) AS BIGINT) AS n_teams FROM games")
def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    return games(spark, sf).agg(F.count("*").alias("n_games"), F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"), F.countDistinct("season_id").alias("n_seasons"), F.countDistinct("home").alias("n_teams"))


@query(
    "S6, E5",
    f"WITH {with_views('games')}, s(split, until) AS (VALUES ('train', DATE '2018-06-30'), ('validate', DATE '2019-06-30'), ('test', DATE '2020-06-30')) SELECT split, CAST(count(*) AS BIGINT) AS n_context, CAST(count(*) FILTER (WHERE game_date > until - 365) AS BIGINT) AS n_scored, max(game_date) AS last_seen FROM games JOIN s ON game_date <= until GROUP BY split",
)
def warm_start_splits(spark: SparkSession, sf: str) -> DataFrame:
    return T.warm_start(games(spark, sf), "game_date", {"train": "2018-06-30", "validate": "2019-06-30", "test": "2020-06-30"}, scored_days=365)


@query("S7, J8", f"WITH {with_views('tg')} SELECT h.game_id, h.team AS home, a.team AS away, h.pts AS pts_home, a.pts AS pts_away FROM tg h JOIN tg a ON h.game_id = a.game_id WHERE h.is_home AND NOT a.is_home")
def wide_from_long(spark: SparkSession, sf: str) -> DataFrame:
    return T.wide_from_long(perspective(games(spark, sf))).select("game_id", "home", "away", "pts_home", "pts_away")


@query("S8, J14", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def insert_ignore_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    return T.new_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(
    "S9, W29, O5",
    f"WITH {with_views('games')} SELECT home, away, game_id, pts_home FROM (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY game_id DESC) AS rn FROM games) WHERE rn = 1",
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).select("home", "away", "game_id", "pts_home")
    old, new = g.where("game_id % 2 = 0"), g.where("game_id % 2 = 1")
    return T.upsert(old, new, ["home", "away"], version="game_id")


@query("S10", f"WITH {with_views('games')} SELECT season_id, CAST(count(*) AS BIGINT) AS n_games FROM games WHERE season_id >= (SELECT season_id FROM games WHERE game_id % 7 <> 0 ORDER BY game_date DESC, game_id DESC LIMIT 1) GROUP BY season_id")
def high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    mark = T.high_water(g.where("game_id % 7 <> 0"), F.struct("game_date", "game_id"), "season_id")
    return g.join(F.broadcast(mark), F.col("season_id") >= F.col("mark")).groupBy("season_id").agg(F.count("*").alias("n_games"))  # one row


@query(
    "S12, O8, S16",
    "WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT CAST((SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS BIGINT) AS n_both, CAST((SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS BIGINT) AS n_only_left, CAST((SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS BIGINT) AS n_only_right",
)
def cache_parity(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).where("k % 3 <> 0")
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).where("k % 5 <> 0")
    return T.key_parity(a, b, ["k"])


@query("S13", f"WITH {with_views('pstats')} SELECT player, stat_date, stat_name, round(stat_value, 6) AS stat_value FROM pstats WHERE stat_value IS NOT NULL")
def unpivot_stats(spark: SparkSession, sf: str) -> DataFrame:
    return player_stats(spark, sf).where("stat_value IS NOT NULL").withColumn("stat_value", r6(F.col("stat_value")))


@query(
    "S14",
    "WITH e AS (SELECT user_id, event_type, value FROM events), a AS (SELECT user_id, count(*) AS n, sum(value) / count(*) AS m FROM e WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, sum(value) / count(*) AS m FROM e WHERE event_type = 'click' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS entity, CAST(a.n AS BIGINT) AS n_on, CAST(b.n AS BIGINT) AS n_off, round(a.m - b.m, 6) AS on_off FROM a FULL JOIN b ON a.user_id = b.user_id",
)
def on_off_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return T.on_off(e, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "click", "value")


@query("S15", f"WITH {with_views('games')}, s AS (SELECT season_id, min(game_date) AS a, max(game_date) AS b FROM games GROUP BY 1) SELECT season_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS as_of_date FROM s")
def season_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return T.checkpoints(games(spark, sf), "season_id", "game_date", 7)


@query(
    "S16, S34",
    f"WITH {with_views('games')}, s AS (SELECT season_id, min(game_date) AS a, max(game_date) AS b FROM games GROUP BY 1), c AS (SELECT season_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS as_of_date FROM s), t AS (SELECT c.season_id, c.as_of_date, t.team FROM c JOIN (SELECT DISTINCT season_id, home AS team FROM games) t ON t.season_id = c.season_id) SELECT season_id, as_of_date, team FROM t WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.game_date = t.as_of_date AND g.home = t.team)",
)
def missing_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    spine = T.checkpoints(g, "season_id", "game_date", 7).join(g.select("season_id", F.col("home").alias("team")).distinct(), "season_id")
    return spine.join(g.select(F.col("game_date").alias("as_of_date"), F.col("home").alias("team")), ["as_of_date", "team"], "left_anti").select("season_id", "as_of_date", "team")


@query(
    "S17, J10",
    f"WITH {with_views('inj')} SELECT game_date, team, player, status, coalesce(nullif(reason, 'Rest'), 'unspecified') AS reason FROM inj WHERE status IN ('Out', 'Doubtful') AND game_date < DATE '2018-01-01'",
)
def injury_json(spark: SparkSession, sf: str) -> DataFrame:
    i = injuries(spark, sf).where("game_date < date '2018-01-01'")
    docs = i.groupBy("game_date", "team").agg(F.to_json(F.struct(F.collect_list(F.struct("player", "status", F.nullif("reason", F.lit("Rest")).alias("comment"))).alias("injuries"))).alias("doc"))
    return T.parse_injuries(docs, "doc", ("Out", "Doubtful"))


@query(
    "S18",
    f"WITH {with_views('inj')}, l AS (SELECT game_date, row_number() OVER (PARTITION BY game_date ORDER BY team, player, game_id) AS line, team, player FROM inj), f AS (SELECT *, CASE WHEN line = 1 OR team <> lag(team) OVER (PARTITION BY game_date ORDER BY line) THEN team END AS printed FROM l) SELECT game_date, line, player, last_value(printed IGNORE NULLS) OVER (PARTITION BY game_date ORDER BY line) AS team FROM f",
)
def fill_forward_team(spark: SparkSession, sf: str) -> DataFrame:
    page = W.partitionBy("game_date").orderBy("line")
    lines = injuries(spark, sf).withColumn("line", F.row_number().over(W.partitionBy("game_date").orderBy("team", "player", "game_id")))
    printed = lines.select("game_date", F.col("line").cast("long").alias("line"), "player", F.when((F.col("line") == 1) | (F.col("team") != F.lag("team").over(page)), F.col("team")).alias("printed"))
    return T.fill_forward(printed, ["game_date"], "line", "printed", "team").select("game_date", "line", "player", "team")


@query(
    "S19, O6",
    "SELECT user_id AS market, CAST(count(*) AS BIGINT) AS n_ticks, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_buy, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'click') >= 20 OR count(*) FILTER (WHERE event_type = 'view') >= 20 AS capped FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)
def two_sided_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("market"), "ts", "event_type")
    return T.merge_sides(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "market", cap=20)


@query("S20, A15", "SELECT user_id AS market, max(ts) AS ts, arg_max(value, ts) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def last_before_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("market")).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


@query(
    "S21, P15, O7",
    "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/', 2) AS lang FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]{2}/')) SELECT host, lang, min(page_id) AS first_seen, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2",
)
def slug_discovery(spark: SparkSession, sf: str) -> DataFrame:
    pattern = "^https?://([^/]+)/([a-z]{2})/"
    p = table(spark, sf, "pages").where(F.col("url").rlike(pattern)).select("page_id", F.regexp_extract("url", pattern, 1).alias("host"), F.regexp_extract("url", pattern, 2).alias("lang"))
    return p.groupBy("host", "lang").agg(F.min("page_id").alias("first_seen"), F.count("*").alias("n"))


@query(
    "S24",
    f"WITH {with_views('games')}, o AS (SELECT home, CAST(count(*) AS BIGINT) AS n, CAST(sum(pts_home) AS BIGINT) AS pts FROM games WHERE season_id = 22000 GROUP BY 1), b AS (SELECT home, CAST(count(*) AS BIGINT) AS n, CAST(sum(pts_home) AS BIGINT) AS pts FROM games WHERE season_id = 22001 AND home < 12 GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM o WHERE home NOT IN (SELECT home FROM b)",
)
def summary_upsert(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    total = lambda d: d.groupBy("home").agg(F.count("*").alias("n"), F.sum("pts_home").alias("pts"))
    return T.carry_forward(total(g.where("season_id = 22000")), total(g.where("season_id = 22001 AND home < 12")), ["home"])


@query("S26", "SELECT c_custkey AS customer, c_name AS name, CAST(NULL AS VARCHAR) AS notes, 0 AS version FROM customer")
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    return T.migrate(table(spark, sf, "customer").select("c_custkey", "c_name"), rename={"c_custkey": "customer", "c_name": "name"}, add={"notes": F.lit(None).cast("string"), "version": F.lit(0)})


@query("S27", "SELECT p.p_partkey, coalesce(CASE WHEN p.p_partkey % 4 = 0 THEN 99 END, p.p_size) AS p_size FROM part p")
def keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return T.keyed_update(p, p.where("p_partkey % 4 = 0").select("p_partkey", F.lit(99).alias("p_size")), ["p_partkey"], ["p_size"])


@query("S28", "SELECT DISTINCT CAST(regexp_extract(line, 'game (\\d+) failed', 1) AS BIGINT) AS game_id FROM (SELECT 'run ' || event_id || ': game ' || user_id || CASE WHEN event_id % 3 = 0 THEN ' failed' ELSE ' ok' END AS line FROM events) WHERE regexp_matches(line, 'game (\\d+) failed')")
def log_scrape(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    lines = e.select(F.concat(F.lit("run "), F.col("event_id"), F.lit(": game "), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, " failed").otherwise(" ok")).alias("line"))
    return T.scrape_ids(lines, "line", r"game (\d+) failed", "game_id")


@query(
    "S30, S35",
    f"WITH {with_views('inj')} SELECT game_date, team, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) AS players FROM inj WHERE status IN ('Available', 'Questionable') GROUP BY 1, 2",
)
def available_roster(spark: SparkSession, sf: str) -> DataFrame:
    return T.roster(injuries(spark, sf), ["game_date", "team"], "player", F.col("status").isin("Available", "Questionable"))


@query(
    "S31",
    f"WITH {with_views('snaps')} SELECT entity, as_of_date, gp, points, c_mktsegment AS segment FROM snaps JOIN customer ON entity = c_custkey WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = entity AND CAST(o.o_orderdate AS DATE) = as_of_date)",
)
def snapshot_fetch(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf).select("entity", "as_of_date", "gp", "points")
    named = s.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")), "entity")
    stored = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("as_of_date"))
    return T.new_rows(named, stored, ["entity", "as_of_date"])


@query("S32", f"WITH {with_views('games')} SELECT DISTINCT game_date, CASE WHEN game_date < DATE '2018-01-01' THEN 'pdf' ELSE 'api' END AS era FROM games WHERE season_id IN (22000, 22001, 22002)")
def game_dates_by_era(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).where(F.col("season_id").isin(22000, 22001, 22002))
    return g.select("game_date", F.when(F.col("game_date") < "2018-01-01", "pdf").otherwise("api").alias("era")).distinct()


@query(
    "P8, P9, P14, P16, P26",
    f"""WITH {with_views('games')}, s AS (SELECT game_id, game_date, season_id, 20000 + (season_id - 22000) + 1990 AS sid FROM games)
SELECT game_id, CASE WHEN month(game_date) >= 10 THEN printf('%04d-%02d', year(game_date), (year(game_date) + 1) % 100) ELSE printf('%04d-%02d', year(game_date) - 1, year(game_date) % 100) END AS season,
  CASE WHEN sid - 20000 BETWEEN 1946 AND 2028 THEN printf('%04d-%02d', sid - 20000, (sid - 20000 + 1) % 100) END AS season_text,
  CASE WHEN sid - 20000 BETWEEN 1946 AND 2028 THEN sid END AS back,
  CAST(-4.5 - game_id % 3 AS DOUBLE) AS line, CAST(200.0 + game_id % 30 AS DOUBLE) AS total, CAST(game_date AS TIMESTAMP) AS starts FROM s""",
)
def season_and_line_parsing(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).withColumn("sid", F.col("season_id") - 22000 + 21990)
    text = C.season_id_to_text(F.col("sid"), 2028)
    spread = F.concat(F.lit("Spread: Home ("), F.format_string("%.1f", F.lit(-4.5) - F.col("game_id") % 3), F.lit(")"))
    total = F.concat(F.lit("A vs. B: O/U "), F.format_string("%.1f", F.lit(200.0) + F.col("game_id") % 30))
    starts = C.first_timestamp(F.lit("soon"), F.col("game_date").cast("string"))
    return g.select("game_id", C.season_of(F.col("game_date")).alias("season"), text.alias("season_text"), C.season_text_to_id(text, 2028).cast("int").alias("back"), C.spread_line(spread).alias("line"), C.totals_line(total).alias("total"), starts.alias("starts"))


@query(
    "P10, M12, O7",
    "WITH n AS (SELECT c_custkey, lower(trim(regexp_replace(replace(c_name, '#', ' '), '\\s+', ' ', 'g'))) AS name FROM customer) SELECT name, CAST(count(*) AS BIGINT) AS n_ids, min(c_custkey) AS first_id FROM (SELECT c_custkey % 700 AS c_custkey, regexp_replace(name, '\\d+$', CAST(c_custkey % 700 AS VARCHAR)) AS name FROM n) GROUP BY name",
)
def name_index(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("c_name", "#", "  "), r"\d+$", "")
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 700).alias("id"), F.concat(name, (F.col("c_custkey") % 700).cast("string"), F.lit(" Jr.")).alias("name"))
    return T.name_index(c, "name", "id")


@query("P25", "SELECT o_orderkey, greatest(-o_totalprice / 10000, -least(12.0 + o_orderkey % 9, 20.0)) AS impact FROM orders")
def impact_clipping(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", C.clip_impact(-F.col("o_totalprice") / 10000, F.lit(12.0) + F.col("o_orderkey") % 9, F.lit(20.0)).alias("impact"))


@query("A10, A11", f"WITH {with_views('pstats')} SELECT player, CAST(year(stat_date) AS INTEGER) AS season, CAST(count(DISTINCT stat_date) AS BIGINT) AS days, round(avg(stat_value) FILTER (WHERE stat_name = 'PTS'), 6) AS PTS, round(avg(stat_value) FILTER (WHERE stat_name = 'REB'), 6) AS REB, round(avg(stat_value) FILTER (WHERE stat_name = 'AST'), 6) AS AST FROM pstats GROUP BY 1, 2")
def stats_pivot(spark: SparkSession, sf: str) -> DataFrame:
    s = player_stats(spark, sf).withColumn("season", F.year("stat_date"))
    wide = s.groupBy("player", "season").pivot("stat_name", ["PTS", "REB", "AST"]).agg(F.avg("stat_value"))
    days = s.groupBy("player", "season").agg(F.countDistinct("stat_date").alias("days"))
    return wide.join(days, ["player", "season"]).select("player", "season", "days", *[r6(F.col(c)).alias(c) for c in ("PTS", "REB", "AST")])


@query("O4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("O7, O8", "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a, b = (li.where(c).select(F.col("l_partkey").alias("part")) for c in ("l_quantity > 45", "l_discount > 0.05"))
    return a.join(b, "part", "left_semi").distinct()


@query("O9", f"WITH {with_views('games')} SELECT game_id, home, away, CAST(pts_home AS BIGINT) AS pts_home FROM games WHERE home = 3 AND away = 7 UNION ALL SELECT -1, 3, 7, 0")
def synthetic_row(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).where("home = 3 AND away = 7").select("game_id", "home", "away", "pts_home")
    return T.with_upcoming(g, {"game_id": -1, "home": 3, "away": 7, "pts_home": 0})


@query("S11", f"WITH {with_views('games')} SELECT game_id, game_date, home, away FROM games WHERE game_id % 97 = 5")
def upcoming_games(spark: SparkSession, sf: str) -> DataFrame:
    played = games(spark, sf).withColumn("outcome", F.when(F.col("game_id") % 97 != 5, F.when(F.col("pts_home") > F.col("pts_away"), "W").otherwise("L")))
    return T.upcoming(played, "outcome").select("game_id", "game_date", "home", "away")


@query("S33", f"WITH {with_views('tg')} SELECT team, game_id, round(avg(pts) OVER (PARTITION BY team ORDER BY game_date, game_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 6) AS team_avg, min(game_date) OVER (PARTITION BY season_id) AS season_start FROM tg")
def team_average(spark: SparkSession, sf: str) -> DataFrame:
    tg = perspective(games(spark, sf))
    starts = tg.groupBy("season_id").agg(F.min("game_date").alias("season_start"))
    w = W.partitionBy("team").orderBy("game_date", "game_id").rowsBetween(-15, -1)
    return tg.withColumn("team_avg", r6(F.avg("pts").over(w))).join(starts, "season_id").select("team", "game_id", "team_avg", "season_start")
