"""Send this package to Python workers that lack it, and keep tables that executors share."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_KEPT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application once; its UDFs are pickled by module name."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='driftledger-')}/driftledger", "zip", root, "driftledger"))
        _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a session on one machine gets a local folder; on a
    cluster it is an error, as executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="driftledger-"))
    root = f"{sc.getCheckpointDir()}/driftledger-{sc.applicationId}"
    if root not in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KEPT.add(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the application's shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage with files that outlive any executor, and prunes
    columns for later readers, unlike a checkpoint of whole rows.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with each of ``keys`` in one of ``spark.sql.shuffle.partitions`` partitions, none put together with others.

    Adaptive execution sizes tasks by shuffled bytes, and sorted keys and offsets pack to a few bytes a row: what
    sorts them would hold tens of millions in a task.  A stated number of partitions stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(spark: SparkSession) -> None:
    """Remove all that the application has stored so far; what still reads it must be done.

    For long sessions: without a call stored tables stay until the driver ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, True)
    files.mkdirs(path)
