"""Search: exact, prefix and fuzzy tiers, hybrid rerank, path and text matches, hints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import in_layer, length_penalty, raw_score, subsequence_pattern
from graphloom.operators.vectors import best_similarity
from graphloom.plans.session import cut, small

PREFIX_NAMES, FUZZY_CANDIDATES, FUZZY_KEPT, FUZZY_SHOWN, PATHS_SHOWN = 5, 50, 20, 5, 15
MIN_CONFIDENCE = 0.3
#: Words of a query that point to a part of the tree, when no layer is named.
PATH_WORDS = [
    (("client", "ui", "component", "react"), "client"),
    (("server", "backend", "method"), "server"),
    (("api", "rest", "endpoint", "route"), "api/server"),
    (("package", "shared", "model"), "packages"),
    (("enterprise", "ee", "premium"), "ee/"),
]
RESULT = "tier string, rank int, name string, path string, score double, n bigint, example string"


def layer_or_all(rows: DataFrame, layer: str | None, *by: str, path: str = "path", strict: bool = False) -> DataFrame:
    """Rows in the layer; of a group (by) without any, all rows, or none if strict."""
    if not layer:
        return rows
    hit = in_layer(F.col(path), layer)
    if strict:
        return rows.where(hit)
    marked = rows.withColumn("__hit", hit)
    some = F.max(F.col("__hit").cast("int"))
    if by:
        marked = marked.withColumn("__any", some.over(Window.partitionBy(*by)))
    else:
        # one row, not a window: a window over everything would bring all rows to one task
        marked = marked.crossJoin(F.broadcast(marked.agg(F.coalesce(some, F.lit(0)).alias("__any"))))
    return marked.where(F.col("__hit") | (F.col("__any") == 0)).drop("__hit", "__any")


def exact(symbols: DataFrame, query: str, layer: str | None = None) -> DataFrame:
    """(name, path) of the symbols of exactly this name."""
    return layer_or_all(symbols.where(F.col("name") == query).select("name", F.col("file").alias("path")).distinct(), layer, "name")


def _numbered(found: DataFrame) -> DataFrame:
    """found with n_, the place of each row by path: sorted by ranges, with no window over all rows."""
    ordered = cut(found.repartitionByRange("path").sortWithinPartitions("path").withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes, before, at = sorted((r["part_"], r["count"]) for r in ordered.groupBy("part_").count().collect()), [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    # one row a partition of the range shuffle
    offsets = found.sparkSession.createDataFrame(before, "part_ int, before_ long")
    return ordered.join(F.broadcast(offsets), "part_").withColumn("n_", F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def first_names(symbols: DataFrame) -> DataFrame:
    """(name, ord): distinct names in order of first appearance."""
    return symbols.groupBy("name").agg(F.min(F.struct("file_ord", "sym_ord")).alias("ord"))


def prefix_names(symbols: DataFrame, query: str, limit: int = PREFIX_NAMES) -> DataFrame:
    """(name, ord): the first names that begin with the query, whatever the case."""
    return first_names(symbols).where(F.startswith(F.lower("name"), F.lit(query.lower()))).orderBy("ord", "name").limit(limit)


def fuzzy_scores(names: DataFrame, query: str, layer: str | None = None) -> DataFrame:
    """(name, paths, base, score) of names (name, paths) that hold the query's letters in order: the candidates, scored and cut to 20."""
    q = F.lit(query.lower())
    candidates = names.where(F.lower("name").rlike(subsequence_pattern(query))).withColumn("raw", raw_score(q, F.lower("name")))
    candidates = candidates.where("raw > 0").orderBy(F.desc(F.round("raw", 9)), "name").limit(FUZZY_CANDIDATES)
    base = F.greatest(F.lit(0.0), F.col("raw")) * length_penalty(F.lit(query), F.col("name"))
    segments = [seg for words, seg in PATH_WORDS if any(w in query.lower() for w in words)]
    inferred = F.exists("paths", lambda p: F.contains(p, F.lit(segments[0])) if len(segments) == 1 else F.lit(False))
    if len(segments) > 1:
        inferred = F.exists("paths", lambda p: p.rlike("|".join(re.escape(s) for s in segments)))
    bonus = F.when(inferred, 0.3).otherwise(0.0)
    if layer:
        bonus = F.when(F.exists("paths", lambda p: F.contains(p, F.lit(f"/{layer}/"))), 0.5).otherwise(bonus)
    scored = candidates.withColumn("base", base).withColumn("score", F.col("base") + bonus)
    return scored.select("name", "paths", "base", "score").orderBy(F.desc(F.round("score", 9)), "name").limit(FUZZY_KEPT)


def rerank(scored: DataFrame, vectors: DataFrame, query_vector: DataFrame) -> DataFrame:
    """scored with final: 0.4 score + 0.6 similarity where a symbol has a similarity over 0, else its score as it was."""
    near = vectors.join(small(scored.select("name")), "name", "left_semi")
    sims = best_similarity(near, query_vector)
    final = F.when(F.coalesce("max_sim", F.lit(0.0)) > 0, 0.4 * F.col("score") + 0.6 * F.col("max_sim")).otherwise(F.col("score"))
    return scored.join(sims, "name", "left").withColumn("final", final)


def confident(ranked: DataFrame, score: str = "final") -> DataFrame:
    """The best five of at least 0.3."""
    return ranked.where(F.round(score, 9) >= MIN_CONFIDENCE).orderBy(F.desc(F.round(score, 9)), "name").limit(FUZZY_SHOWN)


def path_matches(files: DataFrame, query: str, seen: DataFrame | None = None, layer: str | None = None, limit: int = PATHS_SHOWN) -> DataFrame:
    """(path): files whose path holds the query, whatever the case, without those seen already."""
    hits = files.select("path").where(F.contains(F.lower("path"), F.lit(query.lower())))
    if seen is not None:
        hits = hits.join(seen.select("path").distinct(), "path", "left_anti")
    return layer_or_all(hits, layer).orderBy("path").limit(limit)


def wants_text(query: str) -> bool:
    return bool(re.search(r"[.'\"\s(]", query))


def text_matches(files: DataFrame, query: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n, line_no, example): files with lines that hold the query literally, their number, and the first, trimmed."""
    hits = files.where(F.contains(F.col(content), F.lit(query))).select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    hits = hits.where(F.contains("line", F.lit(query)))
    first = F.min(F.struct("line_no", "line"))
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select("path", "n", F.col("f.line_no").alias("line_no"), F.trim("f.line").alias("example"))


def hints(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, hint): the first rule (rule_ord, keyword, hint) one of whose keywords holds the query or is held by it, whatever the case."""
    q, k = F.lower("query"), F.lower("keyword")
    hit = queries.join(small(rules), F.contains(q, k) | F.contains(k, q))
    return hit.groupBy("query").agg(F.min_by("hint", "rule_ord").alias("hint"))


def search(
    spark: SparkSession, symbols: DataFrame, files: DataFrame, query: str, layer: str | None = None, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """All tiers as one table (tier, rank, name, path, score, n, example).

    exact shuts out prefix, and either shuts out fuzzy; paths are always matched, without those
    of the tiers above; text is matched if the query has a dot, quote, blank or bracket; a hint
    comes first. A table without rows means that nothing was found. Text matches are not limited
    and have no rank.
    """
    if not query:
        raise ValueError("query is required")
    empty = spark.createDataFrame([], RESULT)
    out, seen = empty, None

    def rows(df: DataFrame, tier: str, order: list | Column, **columns) -> DataFrame:  # type: ignore[no-untyped-def]
        # tiers that are cut to a few rows; the files of one name, which may be many, are numbered by _numbered()
        rank = order if isinstance(order, Column) else F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) if order else F.lit(None)
        given = {"name": "string", "path": "string", "score": "double", "n": "bigint", "example": "string"}
        return df.select(F.lit(tier).alias("tier"), rank.cast("int").alias("rank"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in given.items()))

    if rules is not None:
        asked = spark.createDataFrame([(query,)], "query string")
        out = out.unionByName(rows(hints(rules, asked), "hint", ["hint"], example=F.col("hint")))
    found = exact(symbols, query, layer)
    if not found.isEmpty():
        out, seen = out.unionByName(rows(_numbered(found), "exact", F.col("n_"), name=F.col("name"), path=F.col("path"))), found
    else:
        names = prefix_names(symbols, query).collect()
        if len(names) == 1:
            found = exact(symbols, names[0]["name"], layer)
            out, seen = out.unionByName(rows(_numbered(found), "prefix", F.col("n_"), name=F.col("name"), path=F.col("path"))), found
        elif names:
            listed = spark.createDataFrame([(r["name"], k) for k, r in enumerate(names)], "name string, k int")
            out = out.unionByName(rows(listed, "prefix", ["k"], name=F.col("name")))
        else:
            paths = symbols.groupBy("name").agg(F.transform(F.sort_array(F.collect_set(F.struct("file_ord", "file"))), lambda f: f["file"]).alias("paths"))
            scored = fuzzy_scores(paths, query, layer)
            ranked = rerank(scored, vectors, query_vector) if vectors is not None and query_vector is not None else scored.withColumn("final", F.col("score"))
            best = confident(ranked)
            out = out.unionByName(rows(best, "fuzzy", [F.desc("final"), "name"], name=F.col("name"), path=F.element_at("paths", 1), score=F.col("final")))
            seen = best.select(F.explode("paths").alias("path"))
    out = out.unionByName(rows(path_matches(files, query, seen, layer), "path", ["path"], path=F.col("path")))
    if wants_text(query):
        hits = layer_or_all(text_matches(files, query), layer)
        out = out.unionByName(rows(hits, "text", [], path=F.col("path"), n=F.col("n"), example=F.col("example")))
    return out
