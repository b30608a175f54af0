"""Session and input helpers of the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; one of our own only where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(sc, "_graphloom_folder", None)
        if folder is None:
            folder = sc._graphloom_folder = tempfile.mkdtemp(prefix="graphloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from reliable storage afterwards."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, computed once, in ranges of the order; each row has the number of its range (part), that rises with the order."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch that a session gets unless it names its own: texts are long, and both the JVM and
#: the worker hold several copies of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds for the batches of texts; a session or a submit that names its own keeps them."""
    given = spark.sparkContext.getConf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not given.contains(key) and not spark._jsparkSession.sessionState().conf().contains(key):
            spark.conf.set(key, value)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names: other columns, whatever they are called, cannot clash.

    id must be an integer of any width (it becomes a long), other names are taken as they are.
    """
    bounded_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    out = []
    for new, old in columns.items():
        if new == "id":
            if kinds.get(old) not in ("tinyint", "smallint", "int", "bigint", "void"):
                raise TypeError(f"column {old} must hold integers, not {kinds.get(old)}")
            out.append(df[old].cast("long").alias(new))
        else:
            out.append(df[old].alias(new))
    return df.select(*out)


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def body_of(text: str = "text") -> Column:
    """Tells the texts of one id apart."""
    return F.hash(text)


def has_words(text: Column) -> Column:
    return F.length(F.trim(text)) > 0
