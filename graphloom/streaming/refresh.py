"""Streaming refresh: new source files flow into the index, one atomic snapshot a batch.

Rows lie in buckets by the hash of their file's path. A batch writes the buckets of its files
alone; the snapshot's manifest says in which version's folder each bucket of each table is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.extract import imports_of, scan_files, skeletons_of, symbols_of
from graphloom.operators.hashing import to_update, valid_snapshot
from graphloom.operators.index_build import edges_of
from graphloom.plans.session import cut
from graphloom.sources.files import with_file_order

VERSION = "1"
#: Tables of a snapshot and the column that names the file a row belongs to.
OWNED = {"file_hash": "path", "files": "path", "symbols": "file", "edges": "file", "imports": "importer", "skeletons": "path"}


BUCKETS = 32
#: Newest snapshots that stay readable after a streamed batch.
KEPT = 5


def _bucket(owner: str) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, folder: str):  # type: ignore[no-untyped-def]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, folder: str) -> int:
    """Number of the newest complete snapshot, 0 if there is none."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{folder}/{n}/_READY"))]
    return max(done, default=0)


def _manifest(spark: SparkSession, folder: str, version: int) -> dict:
    """schemas: of each table; places: of each table, the version whose folder holds each bucket."""
    path, fs = _fs(spark, folder)
    at = fs.open(path(f"{folder}/v{version}/_READY"))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
    at.close()
    return json.loads(text)


def _read(spark: SparkSession, folder: str, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schemas"][name])
    places = [f"{folder}/v{v}/{name}/bucket={b}" for b, v in manifest["places"][name].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest by default: readers see a whole one or the one before."""
    version = latest(spark, folder) if version is None else version
    if not version:
        return {}
    manifest = _manifest(spark, folder, version)
    return {name: _read(spark, folder, manifest, name) for name in OWNED}


def vacuum(spark: SparkSession, folder: str, keep: int = KEPT) -> list[int]:
    """Removes the folders of versions that none of the newest `keep` snapshots reads; their numbers."""
    path, fs = _fs(spark, folder)
    now = latest(spark, folder)
    used = {v for n in range(max(1, now - keep + 1), now + 1) for t in _manifest(spark, folder, n)["places"].values() for v in t.values()} | set(range(now - keep + 1, now + 1))
    gone = [v for v in range(1, now) if v not in used and fs.exists(path(f"{folder}/v{v}"))]
    for v in gone:
        fs.delete(path(f"{folder}/v{v}"), True)
    return gone


def ordered(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A snapshot's tables with the order of files in symbols (file_ord) and edges (ord): it follows from all paths, so it is added on reading."""
    order = with_file_order(tables["files"].select("path")).select(F.col("path").alias("file"), "file_ord")
    symbols = tables["symbols"].join(order, "file")
    edges = tables["edges"].join(order, "file").withColumn("ord", F.col("ord") + F.col("file_ord").cast("long") * (1 << 34)).drop("file_ord")
    return tables | {"symbols": symbols, "edges": edges}


def refresh(files: DataFrame, folder: str, gone: DataFrame | None = None) -> int:
    """Puts files (path, content) into the index and takes vanished ones (gone: path) out; the number of the new snapshot.

    Files whose hash is unchanged cost a hash. All rows of a changed or vanished file are
    replaced; if nothing changed there is no new snapshot. Of a path that comes twice the
    larger content counts, so that a repeated batch gives the same index.
    """
    spark = files.sparkSession
    now = latest(spark, folder)
    old = read_snapshot(spark, folder, now)
    files = cut(files.groupBy("path").agg(F.max("content").alias("content")).withColumn("md5", F.md5("content")))
    known = valid_snapshot(old["file_hash"], VERSION) if old else spark.createDataFrame([], "path string, md5 string")
    changed = cut(to_update(files, known))
    lost = gone.select("path").join(known, "path", "left_semi") if gone is not None else spark.createDataFrame([], "path string")
    if now and changed.isEmpty() and lost.isEmpty():
        return now
    stale = cut(changed.select("path").unionByName(lost.select("path")).distinct())
    fresh = files.join(changed.select("path"), "path", "left_semi")
    # the order of files depends on all of them: ordered() adds it
    scanned = cut(scan_files(fresh))
    ordered = fresh.select("path").withColumn("file_ord", F.lit(0))
    symbols = symbols_of(scanned, ordered)
    all_paths = (old["files"].select("path").join(lost, "path", "left_anti").unionByName(fresh.select("path")) if old else fresh.select("path")).distinct()
    tables = {
        "file_hash": changed.withColumn("generator_version", F.lit(VERSION)),
        "files": fresh.select("path", "content", "md5"),
        "symbols": symbols.drop("file_ord"),
        "edges": edges_of(symbols),
        "imports": imports_of(scanned, all_paths),
        "skeletons": skeletons_of(scanned),
    }
    touched = {r["b"] for r in stale.select(_bucket("path").alias("b")).distinct().collect()}
    before = _manifest(spark, folder, now) if now else {"places": {name: {} for name in OWNED}}
    path, fs = _fs(spark, folder)
    places, schemas = {}, {}
    for name, owner in OWNED.items():
        rows = tables[name]
        if now:
            rows = _read(spark, folder, before, name, touched).join(stale.select(F.col("path").alias(owner)), owner, "left_anti").unionByName(rows)
        schemas[name] = rows.schema.jsonValue()
        at = f"{folder}/v{now + 1}/{name}"
        rows.withColumn("bucket", _bucket(owner)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = [x.getPath().getName() for x in fs.listStatus(path(at))]
        places[name] = {b: v for b, v in before["places"][name].items() if int(b) not in touched} | {n.removeprefix("bucket="): now + 1 for n in written if n.startswith("bucket=")}
    ready = fs.create(path(f"{folder}/v{now + 1}/_READY"), True)
    ready.write(bytearray(json.dumps({"schemas": schemas, "places": places}).encode()))
    ready.close()
    return now + 1


def vanished(spark: SparkSession, folder: str, present: DataFrame) -> DataFrame:
    """(path): files of the newest snapshot that are not among those present (path)."""
    old = read_snapshot(spark, folder)
    known = old["files"].select("path") if old else spark.createDataFrame([], "path string")
    return known.join(present.select("path"), "path", "left_anti")


def watch(files: DataFrame, folder: str, checkpoint: str, present: Callable[[], DataFrame] | None = None, keep: int = KEPT, **trigger: object) -> StreamingQuery:
    """Starts refreshing from a stream of files (path, content); by default what is there now, then stops.

    present lists the files there are at the time of a batch (path): those that have vanished
    leave the index with it. A stream has no batch where nothing new arrives; refresh with
    vanished() takes deletions alone.
    """
    trigger = trigger or {"availableNow": True}

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        refresh(batch, folder, vanished(spark, folder, present()) if present else None)
        vacuum(spark, folder, keep)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()
