"""Line dedup: two Bloom filters pick the lines that may repeat; only those are shuffled and confirmed.

The filters are cut in parts by hash, each the work of one group, so that there is no size from
which they are too large. A line sends 32 bits of its hash to its part; what may repeat is sent
back to the task it came from, and of those lines alone the digests are shuffled and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import kernels as K
from graphloom.llm.common import body_of, cut, pick, table, unused

BITS_PER_LINE = 8
#: Lines that one part of the filters serves; it takes a byte for each bit of the two while it is filled.
LINES_PER_PART = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 11, 12, 13, 32]] = True


def line_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start, end) of every line that is not blank, blanks at either end left out; lines are numbered from 0, blank ones too."""
    ink = ~_SPACE[data] & (data != 10)
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    starts, ends = K.runs(data != 10, offsets)
    filled = np.concatenate(([0], np.cumsum(ink)))
    some = filled[ends] > filled[starts]
    starts, ends = starts[some], ends[some]
    marks = np.flatnonzero(ink)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = feeds[starts] - feeds[offsets[doc]]
    first = marks[filled[starts]] if len(starts) else starts
    last = marks[filled[ends] - 1] + 1 if len(starts) else ends
    return doc, number, first, last


def line_packets(docs: DataFrame) -> DataFrame:
    """A row for each slice of docs (id, text, body): (task, ids, bodies, counts, numbers, digests), all but the task as packed arrays.

    counts are the lines of each text that are not blank, numbers and 128-bit digests (BLAKE2) are theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, digest = TaskContext.get().partitionId(), hashlib.blake2b
        for batch in batches:
            ids, texts, bodies = (batch.column(k) for k in range(3))
            for lo, hi in K.slices(texts):
                offsets, data = K.text_buffers(texts[lo:hi])
                doc, number, starts, ends = line_spans(offsets, data)
                if not len(doc):
                    continue
                raw = data.tobytes()
                digests = b"".join([digest(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())])
                counts = np.bincount(doc, minlength=hi - lo).astype(np.int32)
                packed = [np.asarray(ids[lo:hi]).tobytes(), np.asarray(bodies[lo:hi]).astype(np.int32).tobytes(), counts.tobytes(), number.astype(np.int32).tobytes(), digests]
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["task", "ids", "bodies", "counts", "numbers", "digests"])

    return docs.mapInArrow(run, "task int, ids binary, bodies binary, counts binary, numbers binary, digests binary")


def _parted(digests: bytes, parts: int) -> np.ndarray:
    """part << 32 | key of each digest: the part of the filters it belongs to, and its 32 bits there."""
    h = np.frombuffer(digests, dtype=np.uint64)[::2]
    return ((((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _bits(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in filters of so many."""
    x = keys.astype(np.uint64)
    other = K.mix64(x + np.uint64(1)) >> np.uint64(32)
    return ((x * np.uint64(width)) >> np.uint64(32)).astype(np.int64), ((other * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def possible_repeats(packets: DataFrame, lines: int, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """(task, part, keys): of each task the keys that may have come twice, from all tasks together.

    A part keeps two filters: keys that arrive when their bits are all in the first, and those
    that a task holds twice, go to the second. Every repeated line's key is in the second; others
    get in by chance only.
    """
    parts = max(1, -(-lines // lines_per_part))
    width = BITS_PER_LINE * max(1024, min(lines, lines_per_part))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], 0
        for batch in batches:
            for k, digests in enumerate(batch.column(1)):
                task = batch.column(0)[k].as_py()
                held.append(_parted(digests.as_py(), parts))
        if not held:
            return
        codes, count = np.unique(np.concatenate(held), return_counts=True)
        part = (codes >> np.uint64(32)).astype(np.int64)
        keys = codes.astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        stop = np.append(first[1:], len(part))
        yield pa.RecordBatch.from_pydict(
            {"part": part[first], "task": np.full(len(first), task), "once": [keys[a:b].tobytes() for a, b in zip(first, stop)], "twice": [keys[a:b][count[a:b] > 1].tobytes() for a, b in zip(first, stop)]},
            schema=pa.schema([("part", pa.int32()), ("task", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
        )

    def merge(key: tuple, sent: pa.Table) -> pa.Table:
        once, twice = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
        arrived = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in sent["once"]]
        for keys, again in zip(arrived, sent["twice"]):
            a, b = _bits(keys, width)
            seen = once[a] & once[b]
            twice[a[seen]] = twice[b[seen]] = True
            once[a] = once[b] = True
            a, b = _bits(np.frombuffer(again.as_py(), dtype=np.uint32), width)
            twice[a] = twice[b] = True
        tasks, replies = [], []
        for keys, task in zip(arrived, sent["task"]):
            a, b = _bits(keys, width)
            hit = keys[twice[a] & twice[b]]
            if len(hit):
                tasks.append(task.as_py())
                replies.append(hit.tobytes())
        return pa.table({"task": pa.array(tasks, pa.int32()), "part": pa.array([key[0].as_py()] * len(tasks), pa.int32()), "keys": pa.array(replies, pa.binary())})

    return packets.select("task", "digests").mapInArrow(send, "part int, task int, once binary, twice binary").groupBy("part").applyInArrow(merge, "task int, part int, keys binary")


def _suspected(pair: tuple[list[Row], list[tuple]], parts: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(digests, ids, places) of the lines of one task's packets whose keys its replies hold."""
    packets, replies = pair
    if not replies:
        return
    codes = np.sort(np.concatenate([np.frombuffer(keys, dtype=np.uint32).astype(np.uint64) | np.uint64(part << 32) for _, (part, keys) in replies]))
    for row in packets:
        mine = _parted(row["digests"], parts)
        hit = np.flatnonzero(codes[np.minimum(np.searchsorted(codes, mine), len(codes) - 1)] == mine)
        if len(hit):
            doc = np.repeat(np.arange(len(row["counts"]) // 4), np.frombuffer(row["counts"], dtype=np.int32))[hit]
            place = np.frombuffer(row["bodies"], dtype=np.int32).astype(np.int64)[doc] << 32 | np.frombuffer(row["numbers"], dtype=np.int32)[hit]
            yield np.frombuffer(row["digests"], dtype=np.int64).reshape(-1, 2)[hit].tobytes(), np.frombuffer(row["ids"], dtype=np.int64)[doc].tobytes(), place.tobytes()


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digests, ids, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
            both = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.frombuffer(ids, dtype=np.int64)), pa.array(np.frombuffer(places, dtype=np.int64))], names=["low", "high", "id", "place"])


def repeated_lines(docs: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """(id, body, line): the lines of docs (id, text) that occur before, in a smaller id or further up; body tells the texts of one id apart."""
    spark = docs.sparkSession
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text", body_of().alias("body"))
    packets = cut(line_packets(docs))
    lines = (packets.agg(F.sum(F.octet_length("digests").cast("long"))).first()[0] or 0) // 16
    if not lines:
        return spark.createDataFrame([], "id long, body int, line int")
    parts = max(1, -(-lines // lines_per_part))
    # replies meet their task's packets where those are: packets do not move
    tasks = packets.rdd.getNumPartitions()
    replies = possible_repeats(packets, lines, lines_per_part).rdd.map(lambda r: (r["task"], (r["part"], r["keys"]))).partitionBy(tasks, int)
    met = packets.rdd.glom().zip(replies.glom()).flatMap(lambda pair: _suspected(pair, parts))
    found = spark.createDataFrame(met, "digests binary, ids binary, places binary", verifySchema=False)
    suspects = cut(found.mapInArrow(_flat, "low long, high long, id long, place long"))
    # confirmation by digest. The aggregate combines before the shuffle, so a line of a billion texts is one row on its
    # side of the join, and the skew join splits the other
    first = suspects.groupBy("low", "high").agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = suspects.join(first, ["low", "high"]).where(F.struct("id", "place") > F.col("first"))
    return again.select("id", F.shiftright("place", 32).cast("int").alias("body"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("line")).distinct()


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", dropped: str = "dropped", lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """docs, all columns, each text without its repeated lines, and after them `dropped`, the number of lines it lost.

    Defined cases: as in line_dedup; other columns, whatever their names, stay as they are
    (`dropped` must be a name that docs doesn't have).
    """
    columns = docs.columns
    lines = repeated_lines(pick(docs, id=id_column, text=text_column), lines_per_part)
    lost = unused(docs, "lost")
    drops = lines.groupBy("id", "body").agg(F.collect_set("line").alias(lost))
    joined = docs.join(drops, (docs[id_column] == drops["id"]) & (body_of(docs[text_column]) == drops["body"]), "left").select(*(docs[c] for c in columns), drops[lost])
    place = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(len(columns))
            texts = batch.column(place)
            count = np.asarray(drops.value_lengths().fill_null(0)).astype(np.int32)
            hit = np.flatnonzero(count)
            if len(hit):
                changed = texts.to_pylist()
                for k in hit.tolist():
                    gone = set(drops[k].as_py())
                    changed[k] = "\n".join(x for n, x in enumerate(changed[k].split("\n")) if n not in gone)
                texts = pa.array(changed, texts.type)
            arrays = [texts if k == place else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count)], names=[*columns, dropped])

    # a set of line numbers for each text: a test of every line against a list would take the square of a long text's lines
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(dropped, T.IntegerType())]))


def remove_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count_column: str | None = "n_chars") -> DataFrame:
    """docs, its own columns, each line at its first occurrence only, without the rows of which nothing is left.

    Defined cases: as in line_dedup; rows that lose nothing stay as they are, empty and blank ones
    too; count_column, where docs has it, follows the text of the rows that change.
    """
    columns = docs.columns
    dropped = unused(docs, "dropped")
    kept = drop_repeated_lines(docs, id_column, text_column, dropped)
    kept = kept.where((F.col(dropped) == 0) | F.col(text_column).rlike(r"[^ \t\n\x0b\f\r]"))
    if count_column in columns:
        kind = docs.schema[count_column].dataType
        kept = kept.withColumn(count_column, F.when(F.col(dropped) > 0, F.length(text_column).cast(kind)).otherwise(F.col(count_column)))
    return kept.select(*columns)


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """Every document without the lines that occur before: (doc_id, text, dropped).

    A line is what stands between line feeds; two lines are equal when they are equal after
    blanks at either end are cut, which their 128-bit digests tell. The first occurrence, by id
    and then by line, stays; blank lines always stay. 32 bits of each line's hash go to two Bloom
    filters (seen once, seen twice), cut in parts of lines_per_part lines; lines outside the
    second are unique for certain, the digests of the others are shuffled and compared, so that
    chance hits change nothing.

    Defined cases: ids are integers; null texts stay null, null ids take no part, and both lose
    nothing; empty texts stay empty; a text whose lines are all repeats becomes empty; equal rows
    of one id count as one and lose the same lines; of several texts of an id one holds the first
    occurrence (the smaller hash), so that no line is lost in all; other columns are ignored; an
    empty table gives no rows.
    """
    return drop_repeated_lines(pick(docs, id=id_column, text=text_column), "id", "text", "dropped", lines_per_part).select(F.col("id").alias("doc_id"), "text", F.col("dropped").cast("long").alias("dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


#: Python's and SQL's notion of the blanks that are cut from a line.
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

OP5_SQL = f"""
WITH lines AS (
    SELECT doc_id, k - 1 AS line, string_split(text, chr(10))[k] AS raw
    FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(k)
    WHERE text IS NOT NULL AND doc_id IS NOT NULL
), ranked AS (
    SELECT doc_id, line, raw, trim(raw, {_BLANKS}) AS body,
           row_number() OVER (PARTITION BY trim(raw, {_BLANKS}) ORDER BY doc_id, line) AS rank
    FROM lines
), kept AS (
    SELECT doc_id,
           coalesce(string_agg(CASE WHEN rank = 1 OR body = '' THEN raw END, chr(10) ORDER BY line), '') AS text,
           sum(CASE WHEN rank = 1 OR body = '' THEN 0 ELSE 1 END)::BIGINT AS dropped
    FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, d.text) END AS text, coalesce(k.dropped, 0)::BIGINT AS dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
