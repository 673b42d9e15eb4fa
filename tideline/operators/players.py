"""Players' statistics as of a date, from rows (player, stat_date, stat_name, stat_value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.windows import by, lagged, r6


def rolling(stats: DataFrame, n: int) -> DataFrame:
    """Mean of the last n values strictly before each date; 0 without any."""
    w = lagged(by("player", "stat_name", order=("stat_date",)), n)
    return stats.withColumn("rolling", F.coalesce(F.avg("stat_value").over(w), F.lit(0.0)))


def project(stats: DataFrame, date: str, windows: Sequence[int]) -> DataFrame:
    """Per player and statistic the mean over windows of the mean of the last values before date; only those above 0."""
    past = stats.where(F.col("stat_date") < F.lit(date).cast("date"))
    rank = F.row_number().over(W.partitionBy("player", "stat_name").orderBy(F.desc("stat_date")))
    kept = past.withColumn("_n", rank).where(F.col("_n") <= max(windows))
    total = sum((F.coalesce(F.avg(F.when(F.col("_n") <= n, F.col("stat_value"))), F.lit(0.0)) for n in windows), F.lit(0.0))
    return kept.groupBy("player", "stat_name").agg(total.alias("_s")).where("_s > 0").select("player", "stat_name", r6(F.col("_s") / len(windows)).alias("projection"))
