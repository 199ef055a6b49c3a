"""The session's shared folder, tables written there to cut the lineage, and sizes before a broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Data of more bytes than this isn't broadcast or brought to the driver.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset a local session, whose executors are this process, gets a
    temporary one that goes with the process; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="polyglint-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        folder = "file://" + place
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: survives lost executors. discard() deletes it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(*tables: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more."""
    for table in tables:
        files, target = _file_system(table.sparkSession, table._saved_at)
        files.delete(target, True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file on whatever file system the path names."""
    files, target = _file_system(spark, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def row_bytes(df: DataFrame):
    """A column: about how many bytes a row of df takes."""
    size = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.lit(16) + F.lit(8) * F.greatest(F.size(c), F.lit(0))
        else:
            size = size + F.lit(8)
    return size


def fits(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df takes at most so many bytes; df should be cheap to read, a table of saved() say."""
    found = df.agg(F.sum(row_bytes(df).cast("long")).alias("bytes")).first().bytes
    return (found or 0) <= most_bytes


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it fits, else as it is, for the planner to shuffle."""
    return F.broadcast(df) if fits(df, most_bytes) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions that hold about bytes_each of df as it is stored; the session's number at least."""
    least = shuffle_partitions(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan whose size isn't known counts as the largest number there is
    return least if size >= 1 << 60 else max(least, min(-(-size // bytes_each), 1_000_000))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it lies in fewer partitions: only a small table does, and text work is long per byte."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
