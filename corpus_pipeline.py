"""Corpus preparation in five stages: toxicity, line dedup, near duplicates, benchmark leaks, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import bpe_encode
from graphloom.llm.common import shared_folder, table
from graphloom.llm.decontamination import drop_leaks
from graphloom.llm.line_dedup import remove_repeated_lines
from graphloom.llm.ngram_join import drop_near_copies
from graphloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects. Null and empty texts stay; see drop_toxic for all cases."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line at its first occurrence only; documents of which nothing is left go, n_chars (where it is there) follows the
    text. Null and empty texts and null ids stay; see remove_repeated_lines for all cases."""
    return remove_repeated_lines(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar n-gram sets. Null and wordless texts and null ids
    stay, repeated rows stay or go together; see drop_near_copies for all cases."""
    return drop_near_copies(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark. Null and empty texts and null ids stay; see drop_leaks for all cases."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: (doc_id, tokens, n_tokens, round_trip). A null text has null tokens, an empty one none;
    null and repeated ids are encoded row by row; see bpe_encode for all cases."""
    return bpe_encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", repeated_lines_out),
    ("ngram_jaccard_join", remove_near_copies),
    ("decontamination", remove_leaks),
    ("bpe", encode),
]

#: Models and latent vectors are no matter of SQL; tests hold each stage against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage but the last is written to the shared folder and read again, so that
    what a stage reads several times is computed once and a lost executor costs no more than its own stage. The folder
    of the last stage but one stays, for the result reads it."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
