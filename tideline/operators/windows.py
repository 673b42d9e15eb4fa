"""Lagged windows: a row sees only rows before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(*keys: str, order: tuple[str, ...] = ("game_date", "game_id")) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def lagged(spec: WindowSpec, n: int | None = None) -> WindowSpec:
    """The last n rows before the current one; all of them without n."""
    return spec.rowsBetween(W.unboundedPreceding if n is None else -n, -1)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(W.unboundedPreceding, 0)


def days_back(*keys: str, date: str = "game_date", days: int) -> WindowSpec:
    """The current row's date and the `days` days before it."""
    return W.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-days, 0)


def centred(spec: WindowSpec, n: int) -> WindowSpec:
    """n rows around the current one; with an even n one more before it than after."""
    return spec.rowsBetween(-(n // 2), n // 2 if n % 2 else n // 2 - 1)


def with_streak(df: DataFrame, flag: Column, keys: list[str], order: tuple[str, ...], name: str) -> DataFrame:
    """df with the row's place in its run of true flags, 0 where the flag is false; a false row ends the run."""
    spec = by(*keys, order=order)
    marked = df.withColumn("_run", F.sum(F.when(flag, 0).otherwise(1)).over(running(spec)))
    return marked.withColumn(name, F.when(flag, F.sum(F.when(flag, 1).otherwise(0)).over(running(by(*keys, "_run", order=order)))).otherwise(0)).drop("_run")


def r6(x: Column) -> Column:
    """Six digits, for outputs that are compared across engines."""
    return F.round(x.cast("double"), 6)
