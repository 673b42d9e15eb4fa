"""Ranks over whole tables, by ranges of the full order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.sources.sinks import staged

#: monotonically_increasing_id() holds a partition's number above so many bits and the row's place in it below.
_PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """df with rank (1 to n_rows, in order) and n_rows, without gathering all rows in one task.

    A range exchange on all order columns deals the rows, each range is sorted and numbered where it lies, and the ranges' counts
    (one row a range: `ranges`, or else the session's shuffle partitions) give every range its first rank. So a constant first
    column is split by the later ones; rows that no order column tells apart stay in one range and get ranks in any order among
    themselves. The numbered rows are a table in the shared folder, so a lost executor can't number a range anew.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    numbered = staged(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _PLACE_BITS)
    before, at = [], 0
    for p, n in sorted(tuple(r) for r in numbered.groupBy(part.alias("p")).count().collect()):
        before.append((p, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # one row a range
    placed = numbered.withColumn("_part", part).join(starts, "_part")
    rank = F.col("_before") + F.col("_at") - F.shiftleft("_part", _PLACE_BITS) + 1
    return placed.withColumns({"rank": rank, "n_rows": F.lit(at).cast("long")}).drop("_at", "_part", "_before")


def group_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], ranges: int | None = None) -> DataFrame:
    """key and, per name, the interpolated quantile of the key's values; nulls don't count, a key without values has no row.

    Rows are ranked by (key, value) over ranges of that order, so a key of any number of rows is spread over ranges; a group's first
    rank and size name the two rows that a quantile lies between, and only these are looked at.
    """
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")), ["_k", "_v"], ranges)
    groups = ranked.groupBy("_k").agg(F.min("rank").alias("_first"), F.count("*").alias("_n"))
    at = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in shares.items()}
    wanted = [F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col("_first") + f(p)).cast("long").alias("rank"), (p - F.floor(p)).alias("part"), F.lit(up).alias("up")) for n, p in at.items() for up, f in ((False, F.floor), (True, F.ceil))])).alias("w")]
    asked = groups.select("_k", *wanted).select("_k", "w.*")
    met = asked.join(ranked.select("rank", "_v"), "rank")
    ends = {n: (F.max(F.when((F.col("name") == n) & ~F.col("up"), F.col("_v"))), F.max(F.when((F.col("name") == n) & F.col("up"), F.col("_v"))), F.max(F.when(F.col("name") == n, F.col("part")))) for n in shares}
    return met.groupBy(F.col("_k").alias(key)).agg(*[(low + (high - low) * part).alias(n) for n, (low, high, part) in ends.items()])
