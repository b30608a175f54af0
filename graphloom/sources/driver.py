"""The driver's tables as the engine's tables: files, symbols, typed edges, vectors and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: table, source column, its letter, target column, its letter, edge type
LINKS = [
    ("orders", "o_custkey", "c", "o_orderkey", "o", "call"),
    ("lineitem", "l_orderkey", "o", "l_partkey", "p", "new"),
    ("lineitem", "l_partkey", "p", "l_suppkey", "s", "type"),
    ("customer", "c_custkey", "c", "c_nationkey", "n", "jsx"),
    ("supplier", "s_suppkey", "s", "s_nationkey", "n", "event_emit"),
    ("nation", "n_nationkey", "n", "n_regionkey", "r", "event_listen"),
]


def link_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """(src, dst, edge_type): one typed edge for each foreign key pair, or one for each row that has it."""

    def one(name: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
        edges = table(spark, sf_dir, name).select(key(x, a).alias("src"), key(y, b).alias("dst"), F.lit(kind).alias("edge_type"))
        return edges.distinct() if distinct else edges

    return reduce(DataFrame.unionByName, (one(*link) for link in LINKS))


LINK_EDGES_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{x}' || {a}::VARCHAR AS src, '{y}' || {b}::VARCHAR AS dst, '{kind}' AS edge_type FROM {name}" for name, a, x, b, y, kind in LINKS)


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as symbols, part keys as their files: names collide as symbols' names do."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_name").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"), F.lit("function").alias("type"), F.lit(None).cast("string").alias("qualified_name"),
        F.lit(True).alias("exported"), F.lit(1).alias("line"), F.col("p_partkey").cast("int").alias("file_ord"), F.lit(0).alias("sym_ord"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under their language as a folder."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, href) of every link in a page."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("ord", "href"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, tag) of every opening tag in a page."""
    tags = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("ord", "tag"))
