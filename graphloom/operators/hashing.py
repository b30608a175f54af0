"""Incremental ingest: content hashes against the last snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.md5(content)


def with_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, md5) of each file."""
    return files.select(F.col(path).alias("path"), file_hash(F.col(content)).alias("md5"))


def valid_snapshot(snapshot: DataFrame, version: str) -> DataFrame:
    """The snapshot's rows of this generator version; another version's rows do not count, so that everything is rebuilt."""
    return snapshot.where(F.col("generator_version") == version).select("path", "md5")


def classify(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, md5, status): new, changed, same or gone, from (path, md5) on either side."""
    old = snapshot.select("path", F.col("md5").alias("old"))
    both = current.select("path", "md5").join(old, "path", "full")
    status = F.when(F.col("md5").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("md5").eqNullSafe(F.col("old")), "same").otherwise("changed")
    return both.select("path", F.coalesce("md5", "old").alias("md5"), status.alias("status"))


def to_update(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, md5) of the files that are new or changed."""
    return current.join(snapshot.select("path", F.col("md5").alias("old")), "path", "left").where(~F.col("md5").eqNullSafe(F.col("old"))).select("path", "md5")


def upsert(snapshot: DataFrame, processed: DataFrame) -> DataFrame:
    """The snapshot with the rows of successfully processed files put in their place; failed files keep their old row and are tried again."""
    return snapshot.join(processed.select("path"), "path", "left_anti").unionByName(processed)


def prune(snapshot: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows of vanished files)."""
    paths = current.select("path").distinct()
    return snapshot.join(paths, "path", "left_semi"), snapshot.join(paths, "path", "left_anti")


def needs_rebuild(changed: DataFrame, gone: DataFrame, index_exists: bool) -> bool:
    """Whether anything changed or vanished, or there is no saved index."""
    return not index_exists or not changed.isEmpty() or not gone.isEmpty()
