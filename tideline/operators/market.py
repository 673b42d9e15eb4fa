"""Ticks and bars of prediction markets: bars, summaries, dips and what followed them.

Ticks: market, ts, price, size, side, is_ref (whether the price is that of the reference outcome), and seq, which orders equal times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.columns import safe_div
from tideline.operators.windows import centred, r6


def normalise(ticks: DataFrame) -> DataFrame:
    """Prices of the reference outcome: p, or 1 - p where the tick is for the other one."""
    return ticks.withColumn("ref_price", F.when(F.col("is_ref"), F.col("price")).otherwise(1 - F.col("price")))


def bars(ticks: DataFrame, size: str, seq: str = "event_id") -> DataFrame:
    """Open, high, low, close, volume, count, VWAP and whether the reference outcome traded, per market and tumbling bar. Empty bars
    are not emitted. One aggregation: first and last are by (ts, seq), so the result doesn't depend on row order."""
    at = F.struct("ts", seq)
    p, q = F.col("ref_price"), F.col("size")
    # paid is exact, whatever the order of addition: millionths of the price (a probability) times the high and low part of the
    # millionths of the size, so that both sums stay far below 2**63; they meet once a bar
    price, lot = F.round(p * 1_000_000).cast("long"), F.round(q * 1_000_000).cast("long")
    high, low = F.sum(price * F.shiftright(lot, 20)), F.sum(price * lot.bitwiseAND(F.lit((1 << 20) - 1)))
    paid = (high.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(8,0)") + low.cast("decimal(20,0)")).cast("double") / 1e12
    out = ticks.groupBy("market", F.window("ts", size)["start"].alias("bar_start")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum(q).alias("volume"), F.count("*").alias("n_trades"), safe_div(paid, F.sum(q)).alias("vwap"), F.bool_or("is_ref").alias("any_ref")
    )
    return out


def last_before(ticks: DataFrame, start: Column, seq: str = "event_id") -> DataFrame:
    """The last trade strictly before the start."""
    return ticks.where(F.col("ts") < start).groupBy("market").agg(F.max("ts").alias("pregame_ts"), F.max_by("ref_price", F.struct("ts", seq)).alias("pregame_price"))


def robust_minimum(ticks: DataFrame, window: int = 7, seq: str = "event_id") -> DataFrame:
    """Lowest centred rolling median and when it is first reached, beside the raw lowest price and its first time.

    A market of fewer trades than the window takes as many as it has; an even window reaches one row further back than ahead.
    """
    spec = W.partitionBy("market").orderBy("ts", seq)
    n = F.least(F.count("*").over(W.partitionBy("market")), F.lit(window))
    numbered = ticks.withColumns({"_i": F.row_number().over(spec), "_n": n})
    around = F.collect_list(F.struct("_i", "ref_price")).over(centred(spec, window))
    back, ahead = F.floor(F.col("_n") / 2), F.floor((F.col("_n") - 1) / 2)
    prices = F.sort_array(F.transform(F.filter(around, lambda t: t["_i"].between(F.col("_i") - back, F.col("_i") + ahead)), lambda t: t["ref_price"]))
    smooth = numbered.withColumn("_p", prices)
    half = F.size("_p")
    smooth = smooth.withColumn("_med", (F.get("_p", F.floor((half - 1) / 2).cast("int")) + F.get("_p", F.floor(half / 2).cast("int"))) / 2)
    return smooth.groupBy("market").agg(
        F.min("ref_price").alias("raw_min"), F.min_by("ts", F.struct("ref_price", "ts")).alias("raw_min_ts"), F.min("_med").alias("robust_min"), F.min_by("ts", F.struct("_med", "ts")).alias("robust_min_ts"), F.max("ref_price").alias("max_price"), F.count("*").alias("n_trades")
    )


def summary(ticks: DataFrame, start: Column, bar: str, sparse: int = 20, capped: Column | None = None) -> DataFrame:
    """One row a market: price before the start, minima after it, lowest bar VWAP and a quality grade: trades_capped where the source
    gave no more rows (capped) and none lie before the start, else sparse_trades under `sparse` live trades, else ok."""
    live = ticks.where(F.col("ts") >= start)
    vwap = bars(live, bar).groupBy("market").agg(F.min("vwap").alias("min_vwap"), F.count("*").alias("n_bars"))
    out = ticks.select("market").distinct().join(last_before(ticks, start), "market", "left").join(robust_minimum(live), "market", "left").join(vwap, "market", "left")
    n = F.coalesce("n_trades", F.lit(0))
    cut = F.lit(False) if capped is None else F.coalesce(capped, F.lit(False))
    grade = F.when(cut & F.col("pregame_price").isNull() & (n > 0), "trades_capped").when(n < sparse, "sparse_trades").otherwise("ok")
    return out.withColumn("n_trades", n).withColumn("quality", grade)


def both_perspectives(b: DataFrame) -> DataFrame:
    """Each bar for either side; the other side's low is 1 - high."""
    flip = lambda c: 1 - F.col(c)
    own = F.struct(F.lit("ref").alias("side"), *[F.col(c) for c in ("open", "high", "low", "close")])
    other = F.struct(F.lit("other").alias("side"), flip("open").alias("open"), flip("low").alias("high"), flip("high").alias("low"), flip("close").alias("close"))
    return b.select("market", "bar_start", F.explode(F.array(own, other)).alias("s")).select("market", "bar_start", "s.*")


def dips(b: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("market", "side")) -> DataFrame:
    """Per series and threshold that its low fell under: first crossing, lowest point at or after it (earliest on ties), highest
    high from the crossing on and after the lowest point, and their ratios to it.

    Thresholds are exploded per bar (a fixed number of copies); one window marks what lies at or after the crossing, a second what
    lies after the trough, and one aggregation closes.
    """
    rows = b.select(*keys, "bar_start", "high", "low", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("p"))
    series = W.partitionBy(*keys, "p")
    sofar = series.orderBy("bar_start").rowsBetween(W.unboundedPreceding, 0)
    after = rows.withColumn("_c", F.max((F.col("low") < F.col("p")).cast("int")).over(sofar)).where("_c = 1")
    trough = after.withColumn("_t", F.min(F.struct("low", "bar_start")).over(series))
    late = F.col("bar_start") > F.col("_t.bar_start")
    out = trough.groupBy(*keys, "p").agg(F.min("bar_start").alias("cross_ts"), F.first("_t.low").alias("trough"), F.first("_t.bar_start").alias("trough_ts"), F.max("high").alias("max_high"), F.max(F.when(late, F.col("high"))).alias("max_high_after_trough"))
    return out.withColumns({"ratio": safe_div(F.col("max_high"), F.col("p")), "ratio_after_trough": safe_div(F.col("max_high_after_trough"), F.col("trough"))})


def dip_flags(d: DataFrame, first: DataFrame, multiples: Sequence[float], levels: Sequence[float]) -> DataFrame:
    """Minutes to the trough, whether the series opened under the threshold, and which multiples and levels were reached again.
    first: keys, open."""
    out = d.join(first, ["market", "side"])
    made = {"minutes": (F.unix_timestamp("trough_ts") - F.unix_timestamp("cross_ts")) / 60.0, "started_below": F.col("open") < F.col("p")}
    made |= {f"x{m:g}".replace(".", "_"): F.col("ratio") >= m for m in multiples}
    made |= {f"to{int(100 * v)}": F.when(F.col("p") >= v, None).otherwise(F.col("max_high") >= v) for v in levels}
    return out.withColumns(made)


def recovery_matrix(d: DataFrame, multiples: Sequence[float]) -> DataFrame:
    """Per threshold: events and the share whose highest high reached each multiple of the threshold."""
    shares = [r6(F.avg((F.col("ratio") >= m).cast("double"))).alias(f"x{m:g}".replace(".", "_")) for m in multiples]
    return d.groupBy("p").agg(F.count("*").alias("n"), *shares)


def level_matrix(d: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Per threshold the share that reached an absolute level; NULL where the level is not above the threshold."""
    shares = [r6(F.avg(F.when(F.col("p") < v, (F.col("max_high") >= v).cast("double")))).alias(f"to{int(100 * v)}") for v in levels]
    return d.groupBy("p").agg(*shares)


def sweep(summary: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Number and percentage of markets whose lowest price fell under each threshold."""
    rows = summary.select("raw_min", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("p"))
    return rows.groupBy("p").agg(F.count_if(F.col("raw_min") < F.col("p")).alias("n"), r6(100 * F.avg((F.col("raw_min") < F.col("p")).cast("double"))).alias("pct"))


def live_span(b: DataFrame, still: float = 0.02) -> DataFrame:
    """Per market the last bar whose close is more than `still` off the final close: where live trading ended."""
    series = W.partitionBy("market").orderBy("bar_start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    moved = b.withColumn("_final", F.last("close").over(series)).where(F.abs(F.col("close") - F.col("_final")) > still)
    return moved.groupBy("market").agg(F.max("bar_start").alias("live_until"))


def right_closed(x: Column, edges: Sequence[float]) -> Column:
    """Bucket number of (e0, e1], (e1, e2], ...; NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


# --- markets of an event -----------------------------------------------------------------------------------------------

MARKET = "slug string, question string, type string, outcomes string, prices string, volume double"


def parse_event(events: DataFrame, column: str) -> DataFrame:
    """One row a market of a JSON event; outcomes and prices are themselves JSON texts."""
    rows = events.select(*[c for c in events.columns if c != column], F.explode(F.from_json(column, f"markets array<struct<{_struct(MARKET)}>>")["markets"]).alias("m"))
    rows = rows.select(*[c for c in events.columns if c != column], "m.*")
    return rows.withColumns({"outcomes": F.from_json("outcomes", "array<string>"), "prices": F.transform(F.from_json("prices", "array<string>"), lambda x: x.try_cast("double"))})


def _struct(ddl: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in ddl.split(", "))


def classify(markets: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Per event the market of the highest volume of each type (first slug on ties), how many there are, and flags."""
    rows = markets.groupBy(key, "type").agg(F.count("*").alias("n"), F.max_by("slug", F.struct("volume", F.lit(0))).alias("_any"), F.min_by("slug", F.struct(-F.col("volume"), F.col("slug"))).alias("slug"))
    picked = [F.max(F.when(F.col("type") == t, F.col("slug"))).alias(t) for t in types]
    several = [F.when(F.max(F.when(F.col("type") == t, F.col("n"))) > 1, F.lit(f"several_{t}")) for t in types]
    missing = [F.when(F.max(F.when(F.col("type") == t, F.col("n"))).isNull(), F.lit(f"no_{t}")) for t in types]
    return rows.groupBy(key).agg(*picked, F.concat_ws(";", F.array_compact(F.array(*several, *missing))).alias("flags"))
