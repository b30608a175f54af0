"""Sessions, reliable cuts of lineage, and small-side checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side of a join is broadcast on purpose.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a folder of our own only where it is unset in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(sc, "_graphloom_folder", None)
        if folder is None:
            folder = sc._graphloom_folder = tempfile.mkdtemp(prefix="graphloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read from there: later steps survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimiser's size estimate is under limit, else as it is: Spark then picks a shuffled join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def small_rows(df: DataFrame, column: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a cut one of this text column, with a broadcast hint if its rows, counted, are under limit: estimates of what joins give are far too high."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return F.broadcast(df) if 64 * rows + (size or 0) <= limit else df
