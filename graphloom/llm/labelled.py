"""Bounded samples of labelled rows, for the models that are fitted on the driver, and limits of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ranges


def quotas(counts: dict, bound: int) -> dict:
    """Rows of each class in a sample of at most bound: an equal share of half the bound for every class (all of a rarer one), the rest in proportion."""
    fixed = {c: min(n, bound // (2 * len(counts))) for c, n in counts.items()}
    over, rest = sum(n - fixed[c] for c, n in counts.items()), bound - sum(fixed.values())
    return {c: fixed[c] + (min(n - fixed[c], rest * (n - fixed[c]) // over) if over else 0) for c, n in counts.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, label: str) -> pa.Table:
    """At most bound labelled documents as (id, text, label, weight), of each class those with the smallest hashes of the id.

    docs is (id, text), labels (id, <label>). Null ids, texts and labels are left out; of an id
    that is labelled twice the larger label counts, of an id with several texts the smallest. A
    rare class is not lost among many labels (see quotas); weight is the number of labelled ids
    a row stands for. The choice is made on the labels alone, so only its at most `bound` ids are
    broadcast and only their texts reach the driver.
    """
    named = labels.where(F.col("id").isNotNull() & F.col(label).isNotNull()).groupBy("id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    if not counts:
        return pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([]), "weight": pa.array([], pa.float64())})
    wanted = {c: q for c, q in quotas(counts, bound).items() if q}
    # thinned by the hash to little over the quota, so that the ranking sorts a bounded number of rows
    limit = [(c, q, counts[c] / q, int(min(1.0, q / counts[c] * (1 + 6 / q**0.5)) * (1 << 62)) if q < counts[c] else 1 << 62) for c, q in wanted.items()]
    quota = labels.sparkSession.createDataFrame(limit, f"label {dict(named.dtypes)['label']}, quota long, weight double, below long")
    mark = F.shiftrightunsigned(F.xxhash64("id"), 2)
    thin = named.join(F.broadcast(quota), "label").where(mark < F.col("below"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(mark, "id"))
    chosen = thin.withColumn("rank", rank).where("rank <= quota").select("id", "label", "weight")
    rows = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "label", "weight").agg(F.min("text").alias("text")).select("id", "text", "label", "weight").toArrow().sort_by("id")


def best_limit(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """The limit between two scores from which on `positive` is told with the best F1; of equal ones the largest."""
    order = np.argsort(-score, kind="stable")
    hits, alarms = np.cumsum((weight * positive)[order]), np.cumsum(weight[order])
    last = np.flatnonzero(np.append(np.diff(score[order]) < 0, True))
    if len(last) < 2:
        return float("inf")
    f1 = 2 * hits[last[:-1]] / (alarms[last[:-1]] + (weight * positive).sum())
    k = last[int(np.argmax(f1))]
    return float((score[order][k] + score[order][k + 1]) / 2)


def best_limit_over(rows: DataFrame) -> float:
    """best_limit of all rows (score, positive), each of weight one: ranges of scores are summed, then each is searched from the sums before it."""
    rows = rows.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("hits"), F.count(F.lit(1)).alias("alarms"))
    steps = ranges(rows, F.desc("score"))
    hits = alarms = 0
    before, lowest = [], None
    for r in sorted(steps.groupBy("part").agg(F.sum("hits").alias("hits"), F.sum("alarms").alias("alarms"), F.min("score").alias("least")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], hits, alarms))
        hits, alarms, lowest = hits + r["hits"], alarms + r["alarms"], r["least"]
    offset = rows.sparkSession.createDataFrame(before, "part int, hits_before long, alarms_before long")
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    f1 = 2 * (F.sum("hits").over(down) + F.col("hits_before")) / (F.sum("alarms").over(down) + F.col("alarms_before") + F.lit(hits))
    best = steps.join(F.broadcast(offset), "part").select("score", f1.alias("f1")).where(F.col("score") > F.lit(lowest)).agg(F.max(F.struct("f1", "score"))).first()[0]
    if best is None:
        return float("inf")
    return (best["score"] + steps.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]) / 2
