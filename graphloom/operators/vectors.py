"""Vector index: context texts, what is still to be embedded, providers and similarity."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.plans.session import cut, small

CONTEXT_LINES, CONTEXT_CHARS, BATCH, DIMS = 8, 1500, 100, 768
#: Seconds between two calls of a provider, and after its first failure; rows after which a task's work is saved.
PAUSE, FIRST_WAIT, SAVE_EVERY = 1.2, 5.0, 500
CACHED = "name string, file string, md5 string, vec array<double>, version string"


def context_text(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, md5, context): the symbol, its file and eight true source lines from its own on, in 1500 characters."""
    joined = symbols.join(files.select(F.col("path").alias("file"), "content", "md5"), "file")
    lines = F.slice(F.split("content", "\n"), F.greatest(F.col("line"), F.lit(1)), F.lit(CONTEXT_LINES))
    text = F.concat_ws("\n", F.concat(F.lit("symbol: "), F.col("name")), F.concat(F.lit("file: "), F.col("file")), F.array_join(lines, "\n"))
    return joined.select("name", "file", "md5", F.substring(text, 1, CONTEXT_CHARS).alias("context"))


def cached_of(cache: DataFrame, version: str) -> DataFrame:
    """The cache's rows of this version; others count as missing."""
    return cache.where(F.col("version") == version)


def to_embed(contexts: DataFrame, cache: DataFrame) -> DataFrame:
    """Contexts whose (name, file, md5) the cache does not hold: a changed file is embedded again."""
    return contexts.join(cache.select("name", "file", "md5").distinct(), ["name", "file", "md5"], "left_anti")


def suggested_wait(error: Exception) -> float | None:
    """Seconds after which a provider says it may be asked again: its retry_after, or 'retry in N s' in its message."""
    given = getattr(error, "retry_after", None)
    if given is None:
        told = re.search(r"(?i)retry (?:in|after)\D{0,3}(\d+(?:\.\d+)?)\s*s?", str(error))
        given = told.group(1) if told else None
    return None if given is None else float(given)


def embed(
    contexts: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = BATCH, dims: int = DIMS, attempts: int = 5, pause: float = PAUSE, first_wait: float = FIRST_WAIT
) -> DataFrame:
    """(name, file, md5, vec): provider(texts) is called on executors, batch texts at a time, and tried again when it fails.

    Between calls a task pauses; after a failure it waits as long as the provider says, else
    first_wait, and twice as long each time. embed_into keeps work that was done.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        called = False
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                if called and pause:
                    time.sleep(pause)
                for attempt in range(attempts):
                    try:
                        vectors, called = provider(part["context"].tolist()), True
                        break
                    except Exception as error:
                        if attempt == attempts - 1:
                            raise
                        told = suggested_wait(error)
                        time.sleep(first_wait * 2**attempt if told is None else told)
                yield pd.DataFrame({"name": part["name"], "file": part["file"], "md5": part["md5"], "vec": [list(map(float, v))[:dims] for v in vectors]})

    return contexts.select("name", "file", "md5", "context").mapInPandas(run, "name string, file string, md5 string, vec array<double>")


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The cached vectors of a version (name, file, md5, vec, version); no rows where nothing was written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHED)
    return cached_of(spark.read.schema(CACHED).parquet(path), version)


def embed_into(contexts: DataFrame, path: str, version: str, provider: Callable[[list[str]], list[list[float]]], every: int = SAVE_EVERY, **options: object) -> DataFrame:
    """Embeds what the cache at path lacks and adds it there, about `every` rows of a task at a time: what fails later costs no more than that. Returns the cache."""
    spark = contexts.sparkSession
    todo = cut(to_embed(contexts, read_cache(spark, path, version)))
    slices = max(1, -(-todo.count() // (every * spark.sparkContext.defaultParallelism)))
    for k in range(slices):
        part = todo.where(F.pmod(F.xxhash64("name", "file"), F.lit(slices)) == k)
        embed(part, provider, **options).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return read_cache(spark, path, version)


def embed_query(spark: SparkSession, provider: Callable[[list[str]], list[list[float]]], text: str, dims: int = DIMS) -> DataFrame | None:
    """(query_vec), one row; None where the provider fails, so that a search goes on without similarities."""
    try:
        vector = list(map(float, provider([text])[0]))[:dims]
    except Exception:
        return None
    return spark.createDataFrame([(vector,)], "query_vec array<double>")


def with_similarity(vectors: DataFrame, query: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with sim, their cosine with the one row (query_vec) of query."""
    return vectors.crossJoin(F.broadcast(query.select("query_vec").limit(1))).withColumn("sim", cosine(F.col("query_vec"), F.col(vec))).drop("query_vec")


def best_similarity(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(name, max_sim): the best over a symbol's files, 0 at least."""
    return with_similarity(vectors, query).groupBy("name").agg(F.greatest(F.lit(0.0), F.max("sim")).alias("max_sim"))


def cosine_topk(vectors: DataFrame, key: str, vec: str, query_key: Column | int, k: int) -> DataFrame:
    """(key, sim) of the k nearest to the vector of query_key; ties by key."""
    query = vectors.where(F.col(key) == query_key).select(F.col(vec).alias("query_vec"))
    return with_similarity(vectors.where(F.col(key) != query_key), small(query), vec).select(key, "sim").orderBy(F.desc(F.round("sim", 9)), key).limit(k)
