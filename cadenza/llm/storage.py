"""Results that later jobs read: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one (local master) or one in the warehouse."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if known:
        return known
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        wanted = tempfile.mkdtemp(prefix="cadenza-") if sc.master.startswith("local[") or sc.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    sc.setCheckpointDir(wanted)
    return wanted


def saved(df: DataFrame) -> DataFrame:
    """df from the shared folder: computed once, whatever reads it, and found again if an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later job reads, by the file system that it is on."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def compact(df: DataFrame, rows: int = 50_000) -> tuple[DataFrame, int]:
    """A saved df in as many partitions as its rows need, without a shuffle, and its number of rows.

    Small results of many-partitioned joins otherwise stay in as many tiny pieces, and
    every later shuffle writes files for each of them.
    """
    n = df.count()
    return df.coalesce(max(1, -(-n // rows))), n
