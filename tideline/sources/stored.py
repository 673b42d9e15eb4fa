"""Stored tables that take batches: upserts that rewrite only the buckets they touch, and windows extended by new rows only.

A table is Parquet under one path, in folders bucket=N by a hash of its keys. A batch is merged with the buckets that hold its keys;
the merged buckets are written aside (_pending, which readers don't see) and then take the place of the old ones by dynamic
partition overwrite. Whoever opens the table next finishes a change that was cut short: a complete _pending is applied again, an
incomplete one is dropped. So a batch that failed may be repeated, and a batch applied twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PENDING = "_pending"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


@dataclass(frozen=True)
class Stored:
    """keys name a row; schema is the table's DDL; buckets is fixed for the table's life."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _columns(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def finish(self, spark: SparkSession) -> None:
        """Applies a change that was written whole but not put in place, or drops one that was not written whole."""
        aside = f"{self.path}/{PENDING}"
        if not _exists(spark, aside):
            return
        if _exists(spark, f"{aside}/_SUCCESS"):
            rows = spark.read.schema(f"{self.schema}, bucket int").parquet(aside)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.path)
        _delete(spark, aside)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).drop("bucket")

    def _rows(self, spark: SparkSession) -> DataFrame:
        self.finish(spark)
        schema = f"{self.schema}, bucket int"
        if not _exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)

    def merge(self, batch: DataFrame, combine: Callable[[Column, Column], Column]) -> list[int]:
        """Merges a batch of one row a key; returns the buckets that it touched.

        combine gets the old and the new row of a key as structs (null where there is none) and gives the row to keep. Keys that the
        batch does not name keep their rows; buckets without any of its keys keep their files. A batch of repeated keys is an error
        of the caller: reduce it first (latest()).
        """
        spark = batch.sparkSession
        columns = self._columns(spark)
        old = self._rows(spark)
        new = batch.select(*columns).withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # `buckets` rows at most
        if not touched:
            return []
        side = lambda df, name: df.select("bucket", *[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)], F.struct(*columns).alias(name))
        a, b = side(old.where(F.col("bucket").isin(touched)), "a"), side(new, "b")
        held = a.select("*", F.lit(None).cast(b.schema["b"].dataType).alias("b")).unionAll(b.select("bucket", *[f"_{i}" for i in range(len(self.keys))], F.lit(None).cast(a.schema["a"].dataType).alias("a"), "b"))
        merged = held.groupBy("bucket", *[f"_{i}" for i in range(len(self.keys))]).agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
        kept = merged.select(combine(F.col("a"), F.col("b")).alias("r"), "bucket").select("r.*", "bucket")
        # a bucket's rows meet in one task, which writes its one file
        kept.select(*columns, "bucket").repartition(len(touched), "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{PENDING}")
        self.finish(spark)
        return touched

    def replace(self, batch: DataFrame) -> list[int]:
        """Insert or replace."""
        return self.merge(batch, lambda old, new: F.coalesce(new, old))

    def ignore(self, batch: DataFrame) -> list[int]:
        """Insert or ignore."""
        return self.merge(batch, lambda old, new: F.coalesce(old, new))

    def update(self, batch: DataFrame, *names: str) -> list[int]:
        """Keyed update: rows that are there take the batch's values of the named columns; other rows of the batch are left out of account."""
        columns = self._columns(batch.sparkSession)
        taken = lambda old, new: F.struct(*[F.when(new.isNotNull(), new[c]).otherwise(old[c]).alias(c) if c in names else old[c].alias(c) for c in columns])
        known = batch.join(self.read(batch.sparkSession).select(*self.keys), list(self.keys), "left_semi")
        return self.merge(known, taken)


def extend(tail: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, features: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(features of the new rows, the next tail): rolling features made for new rows only.

    tail holds each key's last `window` rows (as an earlier call gave them; empty at first), with the columns of new. features adds
    columns over frames of at most `window` rows before a row, by the same keys and order. As the tail is all that such a frame can reach, the
    result is that of a rebuild over all rows, provided that new rows follow the old ones in order; see late_rows().
    """
    both = tail.select(*new.columns).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    made = features(both).where("_new").drop("_new")
    back = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    last = both.withColumn("_back", back).where(F.col("_back") <= window)
    return made, last.drop("_back", "_new")


def late_rows(tail: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows that do not follow their key's last row: their features, and those of rows after them, need a rebuild of the key."""
    last = tail.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return new.join(last, list(keys)).where(F.struct(*order) <= F.col("_last")).drop("_last")
