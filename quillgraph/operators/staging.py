"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        where = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: plans do not repeat themselves, and lost executors cost tasks only."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows that a task sorts or hashes at once, and the tasks of small tables.
ROWS, TASKS = 1_000_000, 12


def dealt(df: DataFrame, *keys: Column | str, rows: int = ROWS, n: int | None = None) -> DataFrame:
    """``df`` with equal ``keys`` in one task and about ``rows`` rows a task, however its files are cut and whatever the session's partitions: what a task holds stays the same, the tasks grow with the input.

    ``n`` is the number of rows, or a bound of it; without it they are counted first."""
    return df.repartition(max(TASKS, -(-(df.count() if n is None else n) // rows)), *keys)
