"""Substring dedup: content-defined chunks under a gear rolling hash, deduplicated by digest.

A chunk ends where the gear hash of the last 16 bytes is the strict maximum among its
neighbours on either side, moved on to the next word border. Every cut depends on nearby
bytes alone, so an insertion moves the cuts of its surroundings and no others, and a passage
copied into another text is cut alike there, but for its two ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.common import body_of, pick, table

#: Bytes on either side that a cut's hash must exceed: chunks have more than this, and about twice as much on average.
NEIGHBOURHOOD = 24
#: Bytes within which a cut moves to a word border.
SNAP = 32
#: Bytes a run of repeated chunks must span; shorter ones are phrases of the language.
MIN_RUN = 96

_GEAR = (K.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(32)).astype(np.uint32)
_PAD = 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[byte i - j] << j over the last 16 bytes, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h * np.uint32(0x9E3779B1)


def _window_max(h: np.ndarray, width: int) -> np.ndarray:
    """Maximum of the width values that end at each position."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        wider = out.copy()
        np.maximum(out[step:], out[:-step], out=wider[step:])
        out, have = wider, have + step
    return out


def chunk_cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Sorted positions where a chunk ends inside a text (texts' own borders left out)."""
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    place = np.arange(n) + _PAD * (doc + 1)
    padded = np.zeros(n + _PAD * (docs + 1), dtype=np.uint8)
    padded[place] = data
    h = gear_hash(padded)
    real = np.zeros(len(padded), dtype=bool)
    real[place] = True
    h[~real] = 0
    before = np.zeros_like(h)
    before[1:] = _window_max(h, NEIGHBOURHOOD)[:-1]
    after = np.zeros_like(h)
    after[:-1] = _window_max(h[::-1], NEIGHBOURHOOD)[::-1][1:]
    top = np.flatnonzero((h > before) & (h > after))
    at = np.searchsorted(place, top)
    cut, end = at + 1, offsets[doc[at] + 1]
    borders = np.flatnonzero(_SPACE[data]) + 1
    next_border = np.append(borders, n + 10 * SNAP)[np.searchsorted(borders, cut)]
    snapped = np.where((next_border - cut <= SNAP) & (next_border < end), next_border, cut)
    inside = np.append((data & 0xC0) == 0x80, False)
    for _ in range(3):
        snapped += inside[np.minimum(snapped, n)] & (snapped < end)
    return np.unique(snapped[snapped < end])


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every chunk, starts and ends as bytes of the slice."""
    offsets, data = K.text_buffers(texts)
    return _chunk_spans(offsets, data)


def _chunk_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    filled = np.flatnonzero(np.diff(offsets))
    starts = np.union1d(offsets[filled], chunk_cuts(offsets, data)).astype(np.int64)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def chunk_table(docs: DataFrame) -> DataFrame:
    """(id, body, ord, start, length, low, high, again) of every chunk of docs (id, text, body): byte span in its text, 128-bit digest, whether the text held it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, bodies = (batch.column(k) for k in range(3))
            for lo, hi in K.slices(texts):
                offsets, data = K.text_buffers(texts[lo:hi])
                doc, starts, ends = _chunk_spans(offsets, data)
                if not len(doc):
                    continue
                low, high = (K.segment_hash(data, starts, ends, which) for which in (0, 1))
                first = np.searchsorted(doc, doc)
                order = np.lexsort((starts, high, low, doc))
                again = np.zeros(len(doc), dtype=bool)
                same = (doc[order][1:] == doc[order][:-1]) & (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
                again[order[1:]] = same
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi].take(pa.array(doc)),
                        bodies[lo:hi].take(pa.array(doc)),
                        pa.array((np.arange(len(doc)) - first).astype(np.int32)),
                        pa.array((starts - offsets[doc]).astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(K.signed(low)),
                        pa.array(K.signed(high)),
                        pa.array(again),
                    ],
                    names=["id", "body", "ord", "start", "length", "low", "high", "again"],
                )

    return docs.mapInArrow(run, "id long, body int, ord int, start int, length int, low long, high long, again boolean")


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(id, body, start, length, first_id): maximal byte spans of docs (id, text) made of chunks that a smaller id, or the text itself further up, holds.

    The digest table is aggregated with map-side combining and joined back, so a chunk that a
    billion texts share is one row on one side and is split by the skew join on the other.
    """
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text", body_of().alias("body"))
    chunks = chunk_table(docs)
    fresh = chunks.where(~F.col("again"))
    shared = fresh.groupBy("low", "high").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("last_id > first_id").drop("last_id")
    # chunks that stand further up in their own text come along in the same join: one pass less over the texts
    held = chunks.select("id", "body", "ord", "start", "length", "low", "high", "again").join(shared, ["low", "high"], "left")
    repeats = held.where(F.col("again") | (F.col("id") > F.col("first_id"))).select("id", "body", "ord", "start", "length", F.least("id", "first_id").alias("first_id"))
    # consecutive numbers less their rank are constant within a run; of a repeated row each number comes as often, with one rank
    ranked = repeats.withColumn("island", F.col("ord") - F.dense_rank().over(Window.partitionBy("id", "body").orderBy("ord")))
    spans = ranked.groupBy("id", "body", "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"), F.min("first_id").alias("first_id"))
    return spans.where(F.col("length") >= min_run).select("id", "body", "start", "length", "first_id")


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """The documents that repeat a passage, without it: (doc_id, text, removed_bytes, spans, first_doc_ids).

    text is what is left; spans are the removed (start, length) in bytes of the UTF-8 text;
    first_doc_ids are documents that keep a copy. A passage stays in the document of the
    smallest id that has it, and there where it stands first. Documents that repeat nothing
    are left alone and have no row.

    Defined cases: null ids and texts take no part; empty texts have no chunks; rows of one id
    count as one document: none loses what only others of them hold, equal rows lose the same spans
    and each of several texts its own; a text without word borders is cut
    between characters; other columns are ignored; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    spans = repeated_spans(docs, min_run)
    lists = spans.groupBy("id", "body").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("first_id")).alias("first_doc_ids"), F.sum("length").alias("removed_bytes")
    )
    joined = docs.where(F.col("text").isNotNull()).withColumn("body", body_of()).join(lists, ["id", "body"]).select("id", "text", "removed_bytes", "spans", "first_doc_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column(1), batch.column(3)):
                raw, parts, at = text.as_buffer().to_pybytes(), [], 0
                for span in spans.as_py():
                    parts.append(raw[at : span["start"]])
                    at = max(at, span["start"] + span["length"])
                parts.append(raw[at:])
                kept.append(b"".join(parts).decode("utf-8", "replace"))
            columns = [batch.column(k) for k in range(batch.num_columns)]
            columns[1] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed_bytes", "spans", "first_doc_ids"])

    return joined.mapInArrow(run, "doc_id long, text string, removed_bytes long, spans array<struct<start:int,length:int>>, first_doc_ids array<long>")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
