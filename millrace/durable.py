"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, or a temporary one on a
    local master (tests).  On a cluster without the setting this is an error,
    since a machine-local folder would be lost with its machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, store it in the shared folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that
    costs far more than moving the rows.  Only a table so small that its scan
    gives fewer partitions than cores is moved; a large one stays as it is."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df.repartition(cores)
    return df


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark names it."""
    fs, where = _path(spark, path)
    return fs.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists."""
    fs, where = _path(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder of any file system; none if it doesn't exist."""
    fs, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A text file, written beside its place and renamed into it; an error if it
    is there already, unless it is to be replaced."""
    fs, where = _path(spark, path)
    if fs.exists(where) and not replace:
        raise FileExistsError(path)
    part = where.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    if replace:
        fs.delete(where, False)
    if not fs.rename(part, where):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A text file of any file system; FileNotFoundError if it doesn't exist."""
    fs, where = _path(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a path within its file system; an error if the target exists."""
    fs, where = _path(spark, source)
    to = _path(spark, target)[1]
    if fs.exists(to) or not fs.rename(where, to):
        raise FileExistsError(target)
