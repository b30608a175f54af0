"""Source lookup: a symbol's body and the skeletons of what it calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import without_extension

#: Kinds whose source can be shown, in the order they are tried.
SOURCE_KINDS = ("function", "variable_function", "class", "interface", "type")
CONTEXT = 5


def same_file(path: Column, wanted: str) -> Column:
    """Whether the path ends like the wanted one; case and extension do not matter."""
    stem = without_extension(F.lit(wanted.lower()))
    return F.endswith(without_extension(F.lower(path)), stem)


def source_of(bodies: DataFrame, symbol: str, filename: str) -> DataFrame:
    """(name, file, type, body): the source of the first kind that bodies (name, file, type, body, sym_ord) has of the symbol in the file."""
    kind = F.array_position(F.array(*(F.lit(k) for k in SOURCE_KINDS)), F.col("type"))
    rows = bodies.where((F.col("name") == symbol) & F.col("type").isin(list(SOURCE_KINDS)) & same_file(F.col("file"), filename))
    return rows.orderBy(kind, "file", "sym_ord").limit(1).select("name", "file", "type", "body")


def file_hint(symbols: DataFrame, symbol: str) -> DataFrame:
    """(file) where the symbol is defined, for an answer to a wrong file."""
    return symbols.where(F.col("name") == symbol).select("file").distinct().orderBy("file")


def ranked_files(symbols: DataFrame, imports: DataFrame, symbol: str, caller_file: str | None) -> DataFrame:
    """(file, rank): the symbol's files, those that the caller's file imports first, else in order."""
    files = symbols.where(F.col("name") == symbol).groupBy("file").agg(F.min("file_ord").alias("ord"))
    taken = imports.where(same_file(F.col("importer"), caller_file) if caller_file else F.lit(False)).select(F.col("resolved").alias("file")).distinct().withColumn("taken", F.lit(True))
    return files.join(taken, "file", "left").select("file", F.when(F.col("taken"), 0).otherwise(1).alias("rank"), "ord").orderBy("rank", "ord")


def callee_context(edges: DataFrame, symbols: DataFrame, skeletons: DataFrame, symbol: str, limit: int = CONTEXT) -> DataFrame:
    """(dst, file, skeleton): the first definition of what the symbol calls, in call order, at most five different skeletons."""
    callees = edges.where(F.col("src") == symbol).groupBy("dst").agg(F.min("ord").alias("ord"))
    homes = symbols.groupBy(F.col("name").alias("dst")).agg(F.min_by("file", F.struct("file_ord", "sym_ord")).alias("file"))
    found = callees.join(homes, "dst").join(skeletons.select(F.col("path").alias("file"), "skeleton"), "file")
    once = found.groupBy("file", "skeleton").agg(F.min_by("dst", "ord").alias("dst"), F.min("ord").alias("ord"))
    return once.orderBy("ord").limit(limit).select("dst", "file", "skeleton")


def implement(bodies: DataFrame, edges: DataFrame, symbols: DataFrame, skeletons: DataFrame, symbol: str, filename: str) -> DataFrame:
    """(part, ord, name, file, text): the source, then its callees' skeletons; or, from another file, the files that have it."""
    if not symbol or not filename:
        raise ValueError("symbol and file name are both required")
    main = source_of(bodies, symbol, filename)
    if main.isEmpty():
        return file_hint(symbols, symbol).select(F.lit("hint").alias("part"), F.lit(0).alias("ord"), F.lit(symbol).alias("name"), "file", F.lit(None).cast("string").alias("text"))
    callees = callee_context(edges, symbols, skeletons, symbol)
    head = main.select(F.lit("source").alias("part"), F.lit(0).alias("ord"), "name", "file", F.col("body").alias("text"))
    return head.unionByName(callees.select(F.lit("callee").alias("part"), F.lit(1).alias("ord"), F.col("dst").alias("name"), "file", F.col("skeleton").alias("text")))
