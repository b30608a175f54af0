"""Session telemetry over a log of calls (tool, symbol, tokens, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import token_estimate

HOT = 5


def log_calls(answers: DataFrame, tool: str = "tool", symbol: str = "symbol", text: str = "text", ts: str = "ts") -> DataFrame:
    """(tool, symbol, tokens, ts) of answers; append it to the log."""
    return answers.select(F.col(tool).alias("tool"), F.col(symbol).alias("symbol"), token_estimate(F.col(text)).cast("bigint").alias("tokens"), F.col(ts).alias("ts"))


def totals(calls: DataFrame) -> DataFrame:
    """(calls, tokens, seconds)."""
    seconds = F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), (seconds / 1e6).alias("seconds"))


def repeat_rate(calls: DataFrame) -> DataFrame:
    """(symbols, repeated, rate): distinct symbols, those hit more than once, and their share."""
    hits = calls.where("symbol is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("hits"))
    repeated = F.count(F.when(F.col("hits") > 1, 1))
    n = F.count(F.lit(1))
    return hits.agg(n.alias("symbols"), repeated.alias("repeated"), F.when(n > 0, repeated / n).otherwise(0.0).alias("rate"))


def hot_symbols(calls: DataFrame, k: int = HOT) -> DataFrame:
    """(symbol, hits) of the most hit."""
    return calls.where("symbol is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "symbol").limit(k)
