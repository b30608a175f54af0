"""Sharding: the minimax contiguous partition of ordered atomic groups.

The smallest feasible capacity is found by binary search with a greedy check. The groups stay
distributed: the driver searches over at most RUNS summaries of consecutive groups, which bound
the answer from both sides, and asks for finer ones only where a cut can still fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, pick, table

SHARDS = 64
#: Summaries of the first look, and how much finer each further look is.
RUNS = 1 << 14
FINER = 32


@dataclass(frozen=True)
class Runs:
    """Consecutive groups, summed up: run i covers the sizes from begin[i] to end[i]; whole ones cannot be cut inside."""

    begin: np.ndarray
    end: np.ndarray
    whole: np.ndarray

    def greedy(self, capacity: int, divisible: bool) -> tuple[int | None, np.ndarray]:
        """(shards, cuts) when each shard is filled as far as capacity allows, or (None, cuts so far) if a piece does not fit.

        Runs that are not whole count as freely divisible, or not at all: the first takes no
        more shards than the groups themselves do, the second no fewer.
        """
        total, at, cuts = int(self.end[-1]) if len(self.end) else 0, 0, []
        while total - at > capacity:
            reach = at + capacity
            k = int(np.searchsorted(self.end, reach, side="right"))
            to = reach if divisible and not self.whole[k] else int(self.begin[k])
            if to <= at:
                return None, np.array(cuts, dtype=np.int64)
            cuts.append(to)
            at = to
        return len(cuts) + 1, np.array(cuts, dtype=np.int64)

    def smallest(self, shards: int, low: int, high: int, divisible: bool) -> int:
        """Smallest capacity from low to high that does with the shards; high must do."""
        while low < high:
            middle = (low + high) // 2
            used, _ = self.greedy(middle, divisible)
            if used is not None and used <= shards:
                high = middle
            else:
                low = middle + 1
        return low


def _reach(runs: Runs, low: int, high: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest and latest place of each cut, for capacities from low to high."""
    first, last, a, b = [], [], 0, 0
    total = int(runs.end[-1])
    for _ in range(shards - 1):
        k = min(int(np.searchsorted(runs.end, a + low, side="right")), len(runs.end) - 1)
        a = max(a, int(runs.begin[k])) if a + low < total else total
        k = min(int(np.searchsorted(runs.end, b + high, side="right")), len(runs.end) - 1)
        b = total if b + high >= total else (int(runs.begin[k]) if runs.whole[k] else b + high)
        first.append(a)
        last.append(b)
        if a >= total:
            break
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, runs_at_first: int = RUNS) -> tuple[int, list[int]]:
    """(capacity, cuts) of a table (begin, size): where each group begins in the running sum of sizes, and its size.

    capacity is the smallest largest shard that `shards` contiguous shards allow; cuts are the
    begins of the shards after the first, under that capacity, each shard as full as it can be.
    """
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return 0, []
    width = max(1, -(-total // runs_at_first))

    def look(part: DataFrame, width: int) -> Runs:
        at = part.groupBy(F.floor(F.col("begin") / F.lit(width)).alias("run")).agg(F.min("begin"), F.max("begin"), F.max(F.col("begin") + F.col("size")))
        rows = np.column_stack([np.asarray(c, dtype=np.int64) for c in at.toArrow().columns[1:]])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        return Runs(rows[:, 0], rows[:, 2], rows[:, 0] == rows[:, 1])

    runs = look(groups, width)
    while True:
        low = runs.smallest(shards, max(int(largest), -(-total // shards)), total, True)
        high = runs.smallest(shards, low, total, False)
        used, cuts = runs.greedy(high, False)
        # a cut is exact when the run it precedes cannot give up a first piece
        nexts = np.searchsorted(runs.begin, cuts)
        if low == high and runs.whole[nexts].all():
            return high, cuts.tolist()
        first, last = _reach(runs, low, high, shards)
        a = np.searchsorted(runs.end, first, side="right")
        b = np.searchsorted(runs.begin, last, side="right")
        open_ = np.zeros(len(runs.begin) + 1, dtype=np.int64)
        np.add.at(open_, np.minimum(a, len(runs.begin)), 1)
        np.add.at(open_, np.minimum(np.maximum(a, b), len(runs.begin)), -1)
        wide = np.cumsum(open_)[:-1] > 0
        if not (wide & ~runs.whole).any():
            wide = ~runs.whole
        width = max(1, width // FINER)
        # one range for each cut at most; whole runs inside are read again, so that ranges do not fall apart
        edge = np.flatnonzero(np.diff(np.concatenate(([False], wide, [False])).astype(np.int8)))
        if len(edge) > 2 * shards:
            edge = edge[[0, -1]]
            wide[edge[0] : edge[1]] = True
        ranges = [(F.col("begin") >= int(runs.begin[a])) & (F.col("begin") < int(runs.end[b - 1])) for a, b in zip(edge[::2], edge[1::2])]
        while len(ranges) > 1:
            ranges = [x | y for x, y in zip(ranges[::2], ranges[1::2])] + (ranges[-1:] if len(ranges) % 2 else [])
        finer = look(groups.where(ranges[0]), width)
        keep = np.flatnonzero(~wide)
        begin = np.concatenate((runs.begin[keep], finer.begin))
        order = np.argsort(begin, kind="stable")
        runs = Runs(begin[order], np.concatenate((runs.end[keep], finer.end))[order], np.concatenate((runs.whole[keep], finer.whole))[order])


def running_sums(groups: DataFrame, order: str, size: str) -> DataFrame:
    """groups with begin, the sum of the sizes before each row in the order of a column; one range shuffle, no global window."""
    kept = [c for c in groups.columns]
    ordered = groups.repartitionByRange(order).sortWithinPartitions(order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = np.asarray(batch.column(kept.index(size))).astype(np.int64)
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(ends - sizes), pa.array(np.full(len(sizes), part, dtype=np.int32))], names=[*kept, "begin", "part"]
            )
            at = int(ends[-1]) if len(ends) else at

    local = cut(ordered.mapInArrow(run, f"{schema}, begin long, part int"))
    sums = sorted((r[0], r[1]) for r in local.groupBy("part").agg(F.sum(size)).collect())
    before, at = [], 0
    for part, n in sums:
        before.append((part, at))
        at += n
    # one row a partition of the range shuffle
    offsets = local.sparkSession.createDataFrame(before, "part int, offset long")
    return local.join(F.broadcast(offsets), "part").withColumn("begin", F.col("begin") + F.col("offset")).drop("part", "offset")


def minimax_shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, runs_at_first: int = RUNS) -> DataFrame:
    """Shard of every document: (doc_id, group_id, shard, capacity).

    Documents of the same text form an atomic group: no shard border separates copies. Groups
    are ordered by their smallest doc_id (group_id) and weigh the bytes of all their texts; the
    shards are contiguous in that order and the largest is as small as it can be (capacity). A
    group without bytes between two shards belongs to the first of them.

    Defined cases: a null text weighs nothing and all null texts are one group, as are all empty
    ones; null ids come last and share a group only with equal texts; repeated rows are rows of
    their group and each weighs; other columns are ignored; a group larger than a fair share
    sets the capacity; fewer groups than shards leave shards empty; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    key = docs.select(
        "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("text").alias("low"), F.xxhash64(F.lit(17), "text").alias("high"), F.col("text").isNull().alias("none")
    )
    groups = key.groupBy("low", "high", "none").agg(F.min("id").alias("group_id"), F.sum("bytes").alias("size"))
    ranked = groups.withColumn("rank", F.coalesce("group_id", F.lit((1 << 63) - 1)))
    placed = cut(running_sums(ranked, "rank", "size"))
    capacity, cuts = minimax_cuts(placed.select("begin", "size"), shards, runs_at_first)
    borders = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    shard = F.size(F.filter(borders, lambda c: c < F.col("begin") + F.col("size"))).cast("int")
    where = placed.select("low", "high", "none", "group_id", shard.alias("shard"))
    return key.join(where, ["low", "high", "none"]).select(F.col("id").alias("doc_id"), "group_id", "shard", F.lit(capacity).cast("long").alias("capacity"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


#: The same by nested folds: the outer one halves the range of capacities, the inner one fills shards.
OP7_SQL = f"""
WITH RECURSIVE groups AS (
    SELECT min(doc_id) AS group_id, sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS size FROM documents GROUP BY text
), placed AS (
    SELECT group_id, size, row_number() OVER (ORDER BY group_id) AS place FROM groups
), sizes AS (
    SELECT list({{'used': 0::BIGINT, 'held': size}} ORDER BY place) AS sizes, max(size) AS largest, sum(size)::BIGINT AS total FROM placed
), searched AS (
    SELECT list_reduce(
        list_transform(range(64), lambda k: {{'low': 0::BIGINT, 'high': 0::BIGINT}}),
        lambda s, k: CASE
            WHEN s.low >= s.high THEN s
            WHEN list_reduce(sizes, lambda a, g: CASE WHEN a.held + g.held > (s.low + s.high) // 2 THEN {{'used': a.used + 1, 'held': g.held}} ELSE {{'used': a.used, 'held': a.held + g.held}} END, {{'used': 1::BIGINT, 'held': 0::BIGINT}}).used <= {SHARDS}
                THEN {{'low': s.low, 'high': (s.low + s.high) // 2}}
            ELSE {{'low': (s.low + s.high) // 2 + 1, 'high': s.high}} END,
        {{'low': largest, 'high': total}}).low AS capacity
    FROM sizes
), walk AS (
    SELECT 0::BIGINT AS place, 0 AS shard, 0::BIGINT AS held, -1::BIGINT AS group_id, (SELECT capacity FROM searched) AS capacity
    UNION ALL
    SELECT p.place, CASE WHEN w.held + p.size > w.capacity THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.held + p.size > w.capacity THEN p.size ELSE w.held + p.size END, p.group_id, w.capacity
    FROM walk w JOIN placed p ON p.place = w.place + 1
)
SELECT d.doc_id, w.group_id, w.shard::INTEGER AS shard, w.capacity FROM documents d JOIN (SELECT text, min(doc_id) AS group_id FROM documents GROUP BY text) g ON d.text IS NOT DISTINCT FROM g.text JOIN walk w ON w.group_id = g.group_id
"""
