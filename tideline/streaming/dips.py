"""Dips of live markets: crossings, lowest points and recoveries as bars close.

Ticks gather in bars per market, in any order, until the watermark passes a bar's end; an event-time timer then folds closed bars in
order of time into a few numbers a side and threshold. So the result doesn't depend on the order of ticks within the allowed
lateness, and what a market holds is its open bars and thresholds, whatever its age.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.session import ship_package

SCHEMA = "market long, side string, p double, cross_ts timestamp, trough double, trough_ts timestamp, max_high double, max_high_after_trough double"


class Dips(StatefulProcessor):
    """Per market: open bars (start -> high, low) and per side and threshold the dip so far."""

    def __init__(self, size: int, thresholds: Sequence[float]):
        self.size, self.thresholds = size, [float(p) for p in thresholds]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "start long", "high double, low double")
        self.dips = handle.getMapState("dips", "side string, p double", "cross long, trough double, trough_at long, top double, after double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        closed = timerValues.getCurrentWatermarkInMs() * 1000
        ticks = pd.concat(list(rows))
        for start, prices in ticks.groupby("bar").ref_price:
            start, high, low = int(start), float(prices.max()), float(prices.min())
            if start + self.size <= closed:  # too late: the bar has been folded
                continue
            if self.bars.containsKey((start,)):
                h, lo = self.bars.getValue((start,))
                high, low = max(high, h), min(low, lo)
            else:
                self.handle.registerTimer((start + self.size) // 1000)
            self.bars.updateValue((start,), (high, low))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        changed: dict[tuple, tuple] = {}
        for start in sorted(k[0] for k in self.bars.keys() if k[0] + self.size <= now):
            high, low = self.bars.getValue((start,))
            self.bars.removeKey((start,))
            for side, top, bottom in (("ref", high, low), ("other", 1 - low, 1 - high)):
                for p in self.thresholds:
                    dip = changed.get((side, p)) or (self.dips.getValue((side, p)) if self.dips.containsKey((side, p)) else None)
                    if dip is None:
                        dip = (start, bottom, start, top, None) if bottom < p else None
                    elif bottom < dip[1]:
                        dip = (dip[0], bottom, start, max(dip[3], top), None)
                    else:
                        dip = (dip[0], dip[1], dip[2], max(dip[3], top), top if dip[4] is None else max(dip[4], top))
                    if dip is not None:
                        changed[side, p] = tuple(dip)
        at = lambda micros: pd.Timestamp(micros, unit="us")
        for k, dip in changed.items():
            self.dips.updateValue(k, dip)
        if changed:
            yield pd.DataFrame([(key[0], side, p, at(c), t, at(w), top, after) for (side, p), (c, t, w, top, after) in changed.items()], columns=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def streaming_dips(ticks: DataFrame, seconds: int, late: str, thresholds: Sequence[float]) -> DataFrame:
    """dips() of both_perspectives() for a stream, in update mode: a row a market, side and threshold whenever a closed bar changes it.

    ticks: market, ts, ref_price. Bars are of `seconds`, from the epoch on. A tick counts if its bar is still open, that is, if the
    watermark (`late` behind the latest tick) has not passed the bar's end; later ones don't count. Needs the RocksDB state store.
    """
    ship_package(ticks.sparkSession)
    size = seconds * 1_000_000
    lean = ticks.withWatermark("ts", late).select(F.col("market").cast("long").alias("market"), "ts", (F.floor(F.unix_micros("ts") / size) * size).cast("long").alias("bar"), F.col("ref_price").cast("double").alias("ref_price"))
    return lean.groupBy("market").transformWithStateInPandas(Dips(size, thresholds), SCHEMA, "Update", "EventTime")
