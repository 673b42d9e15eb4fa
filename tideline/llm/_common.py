"""Helpers that the corpus operators share: exact column picking, staged tables, tokenizer files."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import ship_package

#: Above so many bytes of keys a side is never broadcast; the sort-merge join takes over.
BROADCAST_BYTES = 16 << 20
#: A table that few() deals out has so many partitions, or one a core where there are more cores, or one for FILE_ROWS rows.
FILES = 16
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact spelling; other columns, even ones that differ in case only, are left out.

    Every operator starts here, so here its code is sent to the executors.
    """
    ship_package(df.sparkSession)
    where = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in where]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{where[n]}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Runs on a single machine may leave it unset and get one of
    their own; on a cluster that is an error, as executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Staged tables that nobody has deleted yet.
_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 0) -> DataFrame:
    """df in few partitions, for stage(): where shuffle partitions aren't coalesced, each would become a file. rows: a bound on
    what a large df holds.

    Hadoop's local file system starts processes for every file, each of which for a moment counts as large as the executor. Rows stay
    with their partition, so tasks that run again lose none. With dynamic allocation the cores to come aren't known: nothing changes.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return df
    return df.coalesce(max(FILES, context.defaultParallelism, -(-rows // FILE_ROWS)))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result as a staged table; what it staged on the way is deleted once that is written, or if it fails."""
    first = len(_STAGED)
    kept: list[str] = []
    spark = None
    try:
        result = make()
        spark = result.sparkSession
        out = stage(result, name)
        kept = [_STAGED[-1]]
        return out
    finally:
        for folder in _STAGED[first:]:
            if folder not in kept:
                _delete(spark or SparkSession.active(), folder)
        _STAGED[first:] = kept


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only for a counted table under BROADCAST_BYTES; beyond it Spark's own shuffle join stays."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _about_distinct(hashed: DataFrame) -> int:
    return hashed.agg(F.approx_count_distinct("h")).collect()[0][0]


def bounded_sample(rows: DataFrame, columns: list[str], most: int, most_bytes: int, text_col: str | None = None) -> list:
    """Distinct rows of the named columns for the driver: the first by a hash of them, at most `most` and most_bytes of text.

    A threshold leaves about twice as many before they are ordered, so no task and no driver sees more; where it leaves none,
    all rows are ordered. So the sample is empty only if the rows are. Rows that repeat count once.
    """
    volume = F.octet_length(text_col) if text_col else F.lit(0)
    hashed = rows.select(*columns).withColumn("h", F.shiftrightunsigned(F.xxhash64(*columns), 2))
    n = _about_distinct(hashed)
    drawn = hashed.where(F.col("h") < int(min(1.0, 2 * most / max(1, n)) * (1 << 62)))

    def first(of: DataFrame) -> list:
        return of.groupBy("h").agg(F.max(volume).alias("bytes")).orderBy("h").limit(most).collect()

    keys = first(drawn) or first(hashed)
    last, held = -1, 0
    for r in keys:
        held += r.bytes or 0
        if held > most_bytes and last >= 0:
            break
        last = r.h
    return hashed.where(F.col("h") <= last).groupBy("h").agg(*[F.min_by(c, F.struct(*columns)).alias(c) for c in columns]).orderBy("h").select(*columns).collect()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """The tokenizers library keeps to the cores that Spark gave the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
