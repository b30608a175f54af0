"""Sources and sinks: source trees, mapping documents, and the saved index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.index_build import coerce_calls
from graphloom.plans.schema import RAW_MAPPING
from graphloom.plans.session import cut

TABLES = ("symbols", "edges", "imports", "files", "file_hash", "vectors")


def scan_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md5, content, file_ord): every .ts and .tsx below the folder, paths relative to it, without modules, declarations, tests and built files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx}").load(folder)
    root = F.regexp_replace(F.lit(folder), "/+$", "")
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    at = F.instr(path, folder.rstrip("/")) + F.length(root) + 1
    files = raw.select(F.substring(path, at, F.length(path)).alias("path"), F.md5("content").alias("md5"), F.decode("content", "UTF-8").alias("content"))
    kept = files.where(~F.col("path").rlike(r"(^|/)(node_modules|dist)/|\.d\.ts$|\.(test|spec)\.tsx?$"))
    return with_file_order(kept)


def with_file_order(files: DataFrame) -> DataFrame:
    """files with file_ord, the rank of the path: ranks within ranges of paths, raised by the sizes of the ranges before."""
    ranges = cut(files.select("path").distinct().repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in ranges.groupBy("part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = files.sparkSession.createDataFrame(before, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    ranked = ranges.withColumn("within", within).join(F.broadcast(offsets), "part").select("path", (F.col("within") + F.col("before")).cast("int").alias("file_ord"))
    return files.join(ranked, "path")


def scan_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """(file, symbol struct fields, calls): symbols of all mapping documents below the folder but for analysis output; a broken file gives no rows.

    Calls of either generation are accepted.
    """
    raw = spark.read.schema(RAW_MAPPING + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mapping.json").json(folder)
    good = raw.where(~F.contains(F.input_file_name(), F.lit("/_analysis/"))).where("sourcePath is not null")
    flat = good.select(F.col("sourcePath").alias("file"), F.posexplode("symbols").alias("sym_ord", "s")).select(
        F.col("s.name").alias("name"), "file", F.col("s.type").alias("type"), F.col("s.qualifiedName").alias("qualified_name"), F.col("s.exported").alias("exported"), F.col("s.line").alias("line"), "sym_ord", F.col("s.calls").alias("calls")
    )
    return coerce_calls(flat)


def scan_mapping_imports(spark: SparkSession, folder: str) -> DataFrame:
    """(importer, module, resolved) of all mapping documents."""
    raw = spark.read.schema(RAW_MAPPING).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mapping.json").json(folder)
    return raw.where("sourcePath is not null").select(F.col("sourcePath").alias("importer"), F.explode("imports").alias("i")).select("importer", "i.module", "i.resolved")


def output_path(path: Column, kind: str) -> Column:
    """Sibling of a source path: its name without extension, then .kind; our tables are keyed by the whole path, so foo.ts and foo.tsx stay apart there."""
    return F.concat(F.regexp_replace(path, r"\.tsx?$", ""), F.lit(f".{kind}"))


def save_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table; vectors only if there are any."""
    for name, df in tables.items():
        if name == "vectors" and df.isEmpty():
            continue
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The saved tables, or None if there is no index; vectors may be missing."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {n: f"{folder}/{n}" for n in TABLES if fs_path(f"{folder}/{n}").getFileSystem(conf).exists(fs_path(f"{folder}/{n}/_SUCCESS"))}
    return {n: spark.read.parquet(p) for n, p in found.items()} if "symbols" in found else None


def clear_index(spark: SparkSession, folder: str) -> None:
    """Removes the saved index."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def full_text(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a tree's sources, for text matches."""
    return scan_directory(spark, folder).select("path", "content")
