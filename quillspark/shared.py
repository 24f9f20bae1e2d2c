"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no ``spark.checkpoint.dir`` (tests on one machine).
LOCAL_DEFAULT = "file:/tmp/checkpoints"
SMALL = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Unset, it is LOCAL_DEFAULT on a session of one machine, and an error elsewhere:
    a machine-local folder is another folder on every executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_DEFAULT


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; for when its results are elsewhere."""
    delete(spark, _own_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over files, dealt to all cores if the files are too small for their reader to do so.

    A reader can't part a row group, so a table of a few megabytes is one task's
    work.  What is dealt is less than SMALL bytes for each core; a larger table is
    left as its reader splits it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 0 < size < cores * SMALL else df


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The written table cuts the lineage, and it outlives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`save` that nothing will read again."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return to the system what this process holds unused: Arrow's pool, and the C library's (glibc alone).

    A Python worker lives on through later stages, and both keep what a batch took.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
