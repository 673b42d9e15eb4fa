"""Bars, dips, recoveries and event markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.operators import market as O
from tideline.operators.ranks import global_rank, group_quantiles
from tideline.operators.windows import r6
from tideline.plans import query
from tideline.sources.views import table, ticks, with_views

BAR = "6 hours"
P = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
START = "TIMESTAMP '2024-01-05'"
_T = f"{with_views('ticks')}, t AS (SELECT *, CASE WHEN is_ref THEN price ELSE 1 - price END AS r FROM ticks)"
_B = """b AS (SELECT market, time_bucket(INTERVAL 6 HOUR, ts) AS bar_start, arg_min(r, (ts, event_id)) AS open, max(r) AS high, min(r) AS low, arg_max(r, (ts, event_id)) AS close,
  CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_trades, CAST(sum(CAST(r AS DECIMAL(12, 6)) * CAST(size AS DECIMAL(12, 0))) AS DOUBLE) / sum(size) AS vwap, bool_or(is_ref) AS any_ref FROM t GROUP BY 1, 2)"""
_S = "s AS (SELECT market, 'ref' AS side, bar_start, open, high, low, close FROM b UNION ALL SELECT market, 'other', bar_start, 1 - open, 1 - low, 1 - high, 1 - close FROM b)"
_D = f"""c AS (SELECT s.*, p, max(CAST(low < p AS INTEGER)) OVER (PARTITION BY market, side, p ORDER BY bar_start) AS crossed FROM s CROSS JOIN (SELECT unnest([{', '.join(map(str, P))}])::DOUBLE AS p)),
k AS (SELECT *, min((low, bar_start)) OVER (PARTITION BY market, side, p) AS tr FROM c WHERE crossed = 1),
dip AS (SELECT market, side, p, min(bar_start) AS cross_ts, min(low) AS trough, any_value(tr[2]) AS trough_ts, max(high) AS max_high, max(CASE WHEN bar_start > tr[2] THEN high END) AS after_trough FROM k GROUP BY 1, 2, 3)"""
_D = _D.replace("tr[2]", "struct_extract_at(tr, 2)")


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    return O.normalise(ticks(spark, sf))


def _dips(spark: SparkSession, sf: str) -> DataFrame:
    return O.dips(O.both_perspectives(O.bars(_ticks(spark, sf), BAR)), P)


def _start():
    return F.lit("2024-01-05").cast("timestamp_ntz")


@query("A13, T1, T2, P19", f"WITH {_T}, {_B} SELECT market, bar_start, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, CAST(n_trades AS BIGINT) AS n_trades, vwap, any_ref FROM b")
def tick_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = O.bars(_ticks(spark, sf), BAR)
    return b.select("market", "bar_start", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", "n_trades", "vwap", "any_ref")


@query("A15, S20", f"WITH {_T} SELECT market, max(ts) AS pregame_ts, round(arg_max(r, (ts, event_id)), 6) AS pregame_price FROM t WHERE ts < {START} GROUP BY 1")
def last_pregame_trade(spark: SparkSession, sf: str) -> DataFrame:
    return O.last_before(_ticks(spark, sf), _start()).select("market", "pregame_ts", r6(F.col("pregame_price")).alias("pregame_price"))


_MED = "md AS (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY market ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med FROM t {where})"


@query("W25, A14", f"WITH {_T}, {_MED.format(where='')} SELECT market, round(min(r), 6) AS raw_min, arg_min(ts, (r, ts)) AS raw_min_ts, round(min(med), 6) AS robust_min, arg_min(ts, (med, ts)) AS robust_min_ts FROM md GROUP BY 1")
def robust_minimum(spark: SparkSession, sf: str) -> DataFrame:
    return O.robust_minimum(_ticks(spark, sf)).select("market", r6(F.col("raw_min")).alias("raw_min"), "raw_min_ts", r6(F.col("robust_min")).alias("robust_min"), "robust_min_ts")


@query(
    "T3, T5",
    f"""WITH {_T}, {_MED.format(where='WHERE ts >= ' + START)}, live AS (SELECT market, min(r) AS raw_min, min(med) AS robust_min, max(r) AS max_price, count(*) AS n_trades FROM md GROUP BY 1),
pre AS (SELECT market, arg_max(r, (ts, event_id)) AS pregame_price FROM t WHERE ts < {START} GROUP BY 1),
vb AS (SELECT market, min(v) AS min_vwap, count(*) AS n_bars FROM (SELECT market, time_bucket(INTERVAL 6 HOUR, ts) AS x, sum(r * size) / sum(size) AS v FROM t WHERE ts >= {START} GROUP BY 1, 2) GROUP BY 1)
SELECT m.market, round(pregame_price, 6) AS pregame_price, round(raw_min, 6) AS raw_min, round(robust_min, 6) AS robust_min, round(min_vwap, 6) AS min_vwap, CAST(coalesce(n_trades, 0) AS BIGINT) AS n_trades, CAST(n_bars AS BIGINT) AS n_bars,
  CASE WHEN coalesce(n_trades, 0) < 20 THEN 'sparse_trades' ELSE 'ok' END AS quality
FROM (SELECT DISTINCT market FROM t) m LEFT JOIN pre USING (market) LEFT JOIN live USING (market) LEFT JOIN vb USING (market)""",
)
def tick_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = O.summary(_ticks(spark, sf), _start(), BAR)
    return s.select("market", *[r6(F.col(c)).alias(c) for c in ("pregame_price", "raw_min", "robust_min", "min_vwap")], "n_trades", "n_bars", "quality")


@query(
    "T6, W26, J17, P20",
    f"WITH {_T}, {_B}, {_S}, {_D} SELECT market, side, p, cross_ts, round(trough, 6) AS trough, trough_ts, round(max_high, 6) AS max_high, round(after_trough, 6) AS max_high_after_trough, round(max_high / p, 6) AS ratio FROM dip",
)
def dip_events(spark: SparkSession, sf: str) -> DataFrame:
    d = _dips(spark, sf)
    return d.select("market", "side", "p", "cross_ts", r6(F.col("trough")).alias("trough"), "trough_ts", *[r6(F.col(c)).alias(c) for c in ("max_high", "max_high_after_trough", "ratio")])


@query(
    "T7",
    f"""WITH {_T}, {_B}, {_S}, {_D}, o AS (SELECT market, side, arg_min(open, bar_start) AS open FROM s GROUP BY 1, 2)
SELECT dip.market, dip.side, p, date_diff('second', cross_ts, trough_ts) / 60.0::DOUBLE AS minutes, open < p AS started_below, round(max_high / p, 9) >= 2 AS x2, CASE WHEN p >= 0.3 THEN NULL ELSE max_high >= 0.3 END AS to30 FROM dip JOIN o ON o.market = dip.market AND o.side = dip.side""",
)
def dip_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = O.both_perspectives(O.bars(_ticks(spark, sf), BAR))
    first = s.groupBy("market", "side").agg(F.min_by("open", "bar_start").alias("open"))
    d = O.dips(s, P).withColumn("ratio", F.round("ratio", 9))
    return O.dip_flags(d, first, (2.0,), (0.3,)).select("market", "side", "p", "minutes", "started_below", "x2", "to30")


@query("A24, T8", f"WITH {_T}, {_B}, {_S}, {_D} SELECT p, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg(CAST(round(max_high / p, 9) >= {m} AS INTEGER)), 6) AS x{str(m).replace('.', '_')}" for m in (1.5, 2, 3)) + " FROM dip GROUP BY p")
def recovery_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return O.recovery_matrix(_dips(spark, sf).withColumn("ratio", F.round("ratio", 9)), (1.5, 2, 3))


@query("A25, T8", f"WITH {_T}, {_B}, {_S}, {_D} SELECT p, " + ", ".join(f"round(avg(CASE WHEN p < {v} THEN CAST(max_high >= {v} AS INTEGER) END), 6) AS to{int(v * 100)}" for v in (0.2, 0.5, 0.8)) + " FROM dip GROUP BY p")
def level_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return O.level_matrix(_dips(spark, sf), (0.2, 0.5, 0.8))


@query("A26", f"WITH {_T}, {_B}, {_S}, {_D} SELECT p, CAST(count(DISTINCT market) AS BIGINT) AS n_markets, CAST(count(DISTINCT CASE WHEN side = 'ref' THEN market END) AS BIGINT) AS n_ref, round(100.0 * count(DISTINCT CASE WHEN side = 'ref' THEN market END) / count(DISTINCT market), 6) AS ref_pct FROM dip GROUP BY p")
def dip_frequency(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.countDistinct(F.when(F.col("side") == "ref", F.col("market")))
    return _dips(spark, sf).groupBy("p").agg(F.countDistinct("market").alias("n_markets"), ref.alias("n_ref"), r6(100.0 * ref / F.countDistinct("market")).alias("ref_pct"))


@query("A23, A29", f"WITH {_T}, m AS (SELECT market, min(r) AS raw_min FROM t GROUP BY 1) SELECT p, CAST(count(*) FILTER (WHERE raw_min < p) AS BIGINT) AS n, round(100.0 * avg(CAST(raw_min < p AS INTEGER)), 6) AS pct FROM m CROSS JOIN (SELECT unnest([{', '.join(map(str, P))}])::DOUBLE AS p) GROUP BY p")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return O.sweep(_ticks(spark, sf).groupBy("market").agg(F.min("ref_price").alias("raw_min")), P)


@query("A27", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def group_medians(spark: SparkSession, sf: str) -> DataFrame:
    q = group_quantiles(table(spark, sf, "events"), "event_type", "value", {"median_value": 0.5, "p90": 0.9})
    return q.select("event_type", r6(F.col("median_value")).alias("median_value"), r6(F.col("p90")).alias("p90"))


@query("A28", f"WITH {_T} SELECT CAST(CASE WHEN r > 0 AND r <= 0.05 THEN 0 WHEN r > 0.05 AND r <= 0.2 THEN 1 WHEN r > 0.2 AND r <= 0.5 THEN 2 WHEN r > 0.5 AND r <= 1 THEN 3 END AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def right_closed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _ticks(spark, sf).groupBy(O.right_closed(F.col("ref_price"), (0.0, 0.05, 0.2, 0.5, 1.0)).alias("bucket")).agg(F.count("*").alias("n"))


@query("W28", "WITH r AS (SELECT user_id AS market, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) SELECT market, CAST(least(3, greatest(0, ceil((r - 1) * 4 / CAST(n - 1 AS DOUBLE)) - 1)) AS INTEGER) AS quartile FROM r")
def volume_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("market")).agg(F.count("*").alias("v"))
    ranked = global_rank(n, ["v", "market"])
    return ranked.select("market", C.quartile(F.col("rank"), F.col("n_rows")).alias("quartile"))


@query("W30", f"WITH {_T}, {_B}, f AS (SELECT *, last_value(close) OVER (PARTITION BY market ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM b) SELECT market, max(bar_start) AS live_until FROM f WHERE abs(close - final) > 0.02 GROUP BY 1")
def live_span(spark: SparkSession, sf: str) -> DataFrame:
    return O.live_span(O.bars(_ticks(spark, sf), BAR))


@query("A14, O5", "SELECT user_id AS market, arg_min(event_id, (value, ts)) AS cheapest, arg_max(event_type, ts) AS last_type FROM events GROUP BY 1")
def argmin_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("market")).agg(F.min_by("event_id", F.struct("value", "ts")).alias("cheapest"), F.max_by("event_type", "ts").alias("last_type"))


@query(
    "T4, A16, P18, P17, S17",
    """WITH m AS (SELECT event_id, event_id // 4 AS event, ['moneyline', 'spread', 'total'][event_id % 3 + 1] AS type, 'slug-' || event_id AS slug, CAST(floor(value) AS DOUBLE) AS volume FROM events),
g AS (SELECT event, type, count(*) AS n, arg_min(slug, (-volume, slug)) AS slug FROM m GROUP BY 1, 2)
SELECT event, max(CASE WHEN type = 'moneyline' THEN slug END) AS moneyline, max(CASE WHEN type = 'spread' THEN slug END) AS spread, max(CASE WHEN type = 'total' THEN slug END) AS total,
  concat_ws(';', CASE WHEN max(CASE WHEN type = 'moneyline' THEN n END) > 1 THEN 'several_moneyline' END, CASE WHEN max(CASE WHEN type = 'spread' THEN n END) > 1 THEN 'several_spread' END, CASE WHEN max(CASE WHEN type = 'total' THEN n END) > 1 THEN 'several_total' END,
    CASE WHEN max(CASE WHEN type = 'moneyline' THEN n END) IS NULL THEN 'no_moneyline' END, CASE WHEN max(CASE WHEN type = 'spread' THEN n END) IS NULL THEN 'no_spread' END, CASE WHEN max(CASE WHEN type = 'total' THEN n END) IS NULL THEN 'no_total' END) AS flags FROM g GROUP BY event""",
)
def event_markets(spark: SparkSession, sf: str) -> DataFrame:
    return O.classify(O.parse_event(_events(spark, sf), "doc"), "event", ("moneyline", "spread", "total"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*map(F.lit, ("moneyline", "spread", "total"))), (F.col("event_id") % 3 + 1).cast("int"))
    market = F.struct(F.concat(F.lit("slug-"), F.col("event_id")).alias("slug"), F.lit("Spread: Home (-4.5)").alias("question"), kind.alias("type"), F.to_json(F.array(F.lit("Home Team"), F.lit("Away Team"))).alias("outcomes"), F.to_json(F.array(F.format_string("%.2f", F.col("value") / 600.0), F.format_string("%.2f", 1 - F.col("value") / 600.0))).alias("prices"), F.floor("value").cast("double").alias("volume"))
    return e.groupBy(F.floor(F.col("event_id") / 4).alias("event")).agg(F.to_json(F.struct(F.collect_list(market).alias("markets"))).alias("doc"))


@query("P17, P18, P14", "SELECT event_id // 4 AS event, 'slug-' || event_id AS slug, CAST(CASE WHEN CAST(printf('%.2f', value / 600.0) AS DOUBLE) >= CAST(printf('%.2f', 1 - value / 600.0) AS DOUBLE) THEN 0 ELSE 1 END AS INTEGER) AS winner, 1 AS away_index, -4.5::DOUBLE AS line FROM events")
def market_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    m = O.parse_event(_events(spark, sf), "doc")
    return m.select("event", "slug", C.first_argmax(F.col("prices")).alias("winner"), C.matching_outcome(F.col("outcomes"), F.lit("away")).cast("int").alias("away_index"), C.spread_line(F.col("question")).alias("line"))


@query("A32", f"WITH {_T}, {_B}, x AS (SELECT market, arg_min(bar_start, (low, bar_start)) AS tr, min(low) AS low, min(bar_start) AS a, max(bar_start) AS z FROM b GROUP BY 1), f AS (SELECT *, date_diff('second', a, tr) / nullif(CAST(date_diff('second', a, z) AS DOUBLE), 0) AS frac FROM x) SELECT CAST(CASE WHEN frac <= 0.5 THEN 1 ELSE 2 END AS INTEGER) AS half, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(low <= 0.011 AS INTEGER)), 6) AS floor_share FROM f WHERE frac IS NOT NULL GROUP BY 1")
def floor_share(spark: SparkSession, sf: str) -> DataFrame:
    b = O.bars(_ticks(spark, sf), BAR)
    x = b.groupBy("market").agg(F.min_by("bar_start", F.struct("low", "bar_start")).alias("tr"), F.min("low").alias("low"), F.min("bar_start").alias("a"), F.max("bar_start").alias("z"))
    x = x.withColumn("frac", C.safe_div(F.unix_timestamp("tr") - F.unix_timestamp("a"), F.unix_timestamp("z") - F.unix_timestamp("a"))).where("frac IS NOT NULL")
    return x.groupBy(F.when(F.col("frac") <= 0.5, 1).otherwise(2).alias("half")).agg(F.count("*").alias("n"), r6(F.avg((F.col("low") <= 0.011).cast("double"))).alias("floor_share"))
