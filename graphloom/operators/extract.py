"""Extraction: source texts to symbols, calls, imports and skeletons, one Python pass over the files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tsscan import import_candidates, scan_source

_CALLS = "array<struct<name:string,edge_type:string,event:string>>"
SCANNED = (
    f"path string, symbols array<struct<type:string,name:string,exported:boolean,qualified_name:string,line:int,calls:{_CALLS},body:string>>,"
    " imports array<struct<module:string,candidates:array<string>>>, skeleton string, error string"
)


def scan_files(files: DataFrame) -> DataFrame:
    """(path, symbols, imports, skeleton, error) of files (path, content). A file that cannot be read has an error and nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = scan_source(content or "", path)
                    symbols = [{"type": s.type, "name": s.name, "exported": s.exported, "qualified_name": s.qualified_name, "line": s.line, "calls": [vars(c) for c in s.calls], "body": s.body} for s in found.symbols]
                    imports = [{"module": m, "candidates": import_candidates(path, m)} for m in found.imports]
                    rows.append((path, symbols, imports, found.skeleton, None))
                except (RecursionError, IndexError) as e:
                    rows.append((path, [], [], None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "symbols", "imports", "skeleton", "error"])

    return files.select("path", "content").mapInPandas(run, SCANNED)


def symbols_of(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, type, qualified_name, exported, line, file_ord, sym_ord, calls, body)."""
    flat = scanned.select(F.col("path").alias("file"), F.posexplode("symbols").alias("sym_ord", "s"))
    order = files.select(F.col("path").alias("file"), "file_ord")
    return flat.join(order, "file").select("s.name", "file", "s.type", "s.qualified_name", "s.exported", "s.line", "file_ord", "sym_ord", "s.calls", "s.body")


def imports_of(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, module, resolved): the first candidate that exists, else the module with .ts; other modules are external."""
    flat = scanned.select(F.col("path").alias("importer"), F.posexplode("imports").alias("n", "i")).select("importer", "n", F.col("i.module").alias("module"), F.col("i.candidates").alias("candidates"))
    tried = flat.select("importer", "n", "module", "candidates", F.posexplode_outer("candidates").alias("try", "path"))
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    hit = F.when(F.col("known"), F.col("path"))
    found = tried.join(known, "path", "left").groupBy("importer", "n", "module").agg(F.min_by(hit, F.when(F.col("known"), F.col("try"))).alias("hit"), F.first("candidates").alias("c"))
    resolved = F.when(F.size("c") == 0, "external").otherwise(F.coalesce("hit", F.element_at("c", 1)))
    return found.select("importer", "module", resolved.alias("resolved"))


def skeletons_of(scanned: DataFrame) -> DataFrame:
    """(path, skeleton)."""
    return scanned.where("skeleton is not null").select("path", "skeleton")
