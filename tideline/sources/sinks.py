"""Writers and their readers: partitioned series, run logs, JSON, fitted parameters."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths handed out and not yet deleted by a scope.
_MADE: list[str] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it. Results that read staged tables must be written or collected before."""
    first = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[first:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _MADE[first:]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. A single machine may do without the setting; on a cluster that is an error.

    It stays until a scope() that it was made in ends, or as long as the folder does.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
    _MADE.append(f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_series(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """zstd Parquet, a folder per key value; rows are dealt by key first, so a key's rows don't end in a file per task."""
    df.repartition(*keys).write.mode(mode).option("compression", "zstd").partitionBy(*keys).parquet(path)


def read_series(spark: SparkSession, path: str, columns: Sequence[str], **keys) -> DataFrame:
    """The columns of the given keys only: other folders and columns are never read."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df.select(*columns)


def append_run(spark: SparkSession, path: str, row: Mapping) -> None:
    """One more row of an experiment log in CSV. The first row fixes the columns: later ones may lack some, but bring none of their own."""
    from pyspark.errors import AnalysisException

    try:
        columns = read_runs(spark, path).columns
    except AnalysisException:
        columns = list(row)
    if unknown := [c for c in row if c not in columns]:
        raise ValueError(f"the log has no column {unknown}")
    values = [None if row.get(c) is None else str(row[c]) for c in columns]
    spark.createDataFrame([values], ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """gzip JSON lines; Spark reads them back without being told of the compression."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def save_model(parameters: Mapping, spark: SparkSession, path: str) -> None:
    """Fitted parameters as one JSON document in any store that Spark can write."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "document string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).collect()[0][0])
