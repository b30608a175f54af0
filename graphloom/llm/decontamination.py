"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

Two passes over the texts. The first gathers document frequencies and a sketch S*A of the
passage-term matrix A (each passage is added, with a random sign, to one of SKETCH_ROWS rows);
the right singular vectors of the idf-weighted sketch span the latent space (randomised SVD by
a sparse row sketch: no passage leaves its task). The second pass projects every passage,
compares it with all benchmark items by cosine, and verifies what is near, all in one task.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.common import pick, table

TERMS = 4096
BLOCK_WORDS = 16
SKETCH_ROWS = 256
RANK = 128
#: Cosine from which a passage is a candidate; far under that of a copy with a third of its words changed.
MIN_COSINE = 0.3
#: Words from which an item is also searched by the passages it consists of: one of its passages is little like the whole.
LONG_ITEM = 3 * BLOCK_WORDS
#: Share of an item's content words, in order, that makes a leak: by itself, or along with the item's answer.
STRONG, WEAK, ANSWER = 0.75, 0.5, 0.5
#: Share of blocks that hold a term from which its words count as function words, and blocks that it takes at least.
#: Blocks that hold GRAM words of a benchmark item in a row are not counted: copies of a leak make no function words.
COMMON, LEAST_COMMON = 0.01, 20
GRAM = 4
#: An item with fewer content words than this, or a smaller share of its words, is searched by all its words.
FEW_WORDS, FEW_SHARE = 4, 0.25
#: Bits of the filter of benchmark grams for each of its words, and bits at most.
GRAM_BITS, MAX_GRAM_BITS = 256, 1 << 29
#: Benchmark text, and items, that one search holds in every worker (each takes some 200 MB there); a larger benchmark is
#: searched in several.
MAX_ITEM_BYTES, MAX_ITEMS = 8 << 20, 1 << 15
#: Cosines held at once, of the passages of a slice and some of the items.
COSINES = 1 << 22
#: Tasks whose sketches are added in one group; there are three rounds of adding.
FAN_IN = 64

_FLUSH = 1 << 21


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(52)).astype(np.int64)


def _blocks(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, number of blocks of each of n documents): runs of BLOCK_WORDS words."""
    counts = np.bincount(doc, minlength=n)
    blocks = -(-counts // BLOCK_WORDS)
    first_word = np.concatenate(([0], np.cumsum(counts)))[:-1]
    first_block = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    return first_block[doc] + (np.arange(len(doc)) - first_word[doc]) // BLOCK_WORDS, blocks


def _distinct_terms(block: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, term): a word repeated a hundred times weighs as one."""
    key = block * TERMS + terms
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key // TERMS, key % TERMS


def _grams(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of GRAM words of one text."""
    m = len(words) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[GRAM - 1 :])
    return at, K.mix64(h[at])


def _bits_of(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)


def gram_filter(words: int) -> np.ndarray:
    """An empty filter for the grams of so many benchmark words."""
    return np.zeros(min(max(1 << 16, 1 << (GRAM_BITS * max(words, 1) - 1).bit_length()), MAX_GRAM_BITS) // 8, dtype=np.uint8)


def add_grams(bits: np.ndarray, texts: pa.Array) -> None:
    for lo, hi in K.slices(texts):
        at = _bits_of(_grams(*K.word_hashes(texts[lo:hi]))[1], bits)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _copied_blocks(block: np.ndarray, doc: np.ndarray, words: np.ndarray, total: int, bits: np.ndarray) -> np.ndarray:
    """Whether each block holds a word of a run that the benchmark holds too."""
    first, h = _grams(doc, words)
    at = _bits_of(h, bits)
    first = first[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(total, dtype=bool)
    out[block[first]] = True
    out[block[first + GRAM - 1]] = True
    return out


@dataclass(frozen=True)
class LatentSpace:
    """basis[t]: the latent vector of a term, its idf included; common[t]: whether it is a function word's; whole: the space in which no term is left out."""

    basis: np.ndarray
    common: np.ndarray
    whole: LatentSpace | None = None


_TERM_MARK = K.mix64(np.arange(1, TERMS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _places_in_sketch(ids: np.ndarray, own: np.ndarray, terms: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, sign) of each block: by its text's id, its number there and its terms, so that neither reruns nor partitions matter."""
    sums = np.zeros(len(of), dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sums[own[starts]] = np.add.reduceat(_TERM_MARK[terms], starts)
    number = np.arange(len(of)) - np.searchsorted(of, of)
    mark = K.mix64(sums ^ K.mix64(ids[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64)))
    return (mark % np.uint64(SKETCH_ROWS)).astype(np.int64), np.where(mark >> np.uint64(40) & np.uint64(1), 1, -1)


def latent_space(docs: DataFrame, bits: np.ndarray, rank: int = RANK) -> LatentSpace:
    """Fitted on every passage of docs (id, text); bits: the filter of the benchmark's grams. Sums are of whole numbers: their order does not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    pieces = 16
    rows = SKETCH_ROWS // pieces

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, frequency, seen = np.zeros(SKETCH_ROWS * TERMS, dtype=np.int64), np.zeros(TERMS, dtype=np.int64), 0
        held: list[np.ndarray] = []
        signs: list[np.ndarray] = []
        bits = shared.value

        def flush() -> None:
            if held:
                np.add(sketch, np.bincount(np.concatenate(held), weights=np.concatenate(signs), minlength=len(sketch)).astype(np.int64), out=sketch)
                held.clear()
                signs.clear()

        waiting = 0
        for batch in batches:
            ids, texts = np.asarray(batch.column(0).fill_null(0)), batch.column(1)
            for lo, hi in K.slices(texts):
                doc, words = K.word_hashes(texts[lo:hi])
                block, blocks = _blocks(doc, hi - lo)
                total = int(blocks.sum())
                if not total:
                    continue
                own, terms = _distinct_terms(block, _terms(words))
                counted = ~_copied_blocks(block, doc, words, total, bits)
                frequency += np.bincount(terms[counted[own]], minlength=TERMS)
                seen += int(counted.sum())
                of = np.repeat(np.arange(hi - lo), blocks)
                row, sign = _places_in_sketch(ids[lo:hi], own, terms, of)
                # a passage is a block and the one after it in the same text
                held.append(row[own] * TERMS + terms)
                signs.append(sign[own])
                follows = np.flatnonzero(own > 0)
                follows = follows[of[own[follows]] == of[own[follows] - 1]]
                held.append(row[own[follows] - 1] * TERMS + terms[follows])
                signs.append(sign[own[follows] - 1])
                waiting += 2 * len(own)
                if waiting > _FLUSH:
                    flush()
                    waiting = 0
        flush()
        if not seen and not frequency.any() and not sketch.any():
            return
        parts = [*sketch.reshape(pieces, rows * TERMS), np.append(frequency, seen)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(pieces + 1, dtype=np.int32)), pa.array(np.full(pieces + 1, TaskContext.get().partitionId(), dtype=np.int32)), pa.array([_packed(x) for x in parts], pa.binary())], names=["piece", "task", "data"]
        )

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = reduce(np.add, (_unpacked(x.as_py()) for x in parts["data"]))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([_packed(total)], pa.binary())})

    schema = "piece int, task int, data binary"
    sums = docs.mapInArrow(gather, schema)
    # a group holds the sketches of FAN_IN tasks, however many there are
    for _ in range(2):
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("piece", "task").applyInArrow(add, schema)
    sums = {r["piece"]: r["data"] for r in sums.withColumn("task", F.lit(0)).groupBy("piece", "task").applyInArrow(add, schema).collect()}
    none = np.zeros(TERMS, dtype=bool)
    if pieces not in sums:
        nothing = np.zeros((TERMS, 1), np.float32)
        return LatentSpace(nothing, none, LatentSpace(nothing, none))
    counts = _unpacked(sums[pieces])
    frequency, seen = counts[:-1], int(counts[-1])
    common = frequency > max(COMMON * seen, LEAST_COMMON)
    # smoothed: positive for a term of every block, so that no item's vector is empty
    idf = np.log(1 + (1 + seen) / (1 + frequency))
    sketch = np.concatenate([_unpacked(sums[k]).reshape(rows, TERMS) for k in range(pieces)]).astype(np.float64)
    # function words say which language a passage is in, not what it says: left in, they fill the leading directions
    return LatentSpace(_basis(sketch, np.where(common, 0.0, idf), rank), common, LatentSpace(_basis(sketch, idf, rank), none))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them, led by that width."""
    top = int(np.abs(x).max()) if len(x) else 0
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype={1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[data[0]], offset=1).astype(np.int64)


def _basis(sketch: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    sketch = sketch * idf
    # right singular vectors by way of the small Gram matrix of the rows
    values, left = np.linalg.eigh(sketch @ sketch.T)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)]
    right = (sketch.T @ left[:, top]) / np.sqrt(values[top])
    return (right * idf[:, None]).astype(np.float32)


def common_subsequence(places: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of each word's places, n words) and words."""
    row = full = (1 << n) - 1
    for w in words:
        mask = places.get(w)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def answer_of(text: str) -> str:
    """The last sentence: what follows the last full stop, question mark, exclamation mark or line feed that words follow."""
    parts = [p for p in re.split(r"[.?!\n]+", text) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


@dataclass(frozen=True)
class Item:
    item_id: int
    n: int
    places: dict[int, int]
    size: int
    answer: dict[int, int]
    answer_size: int


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for k, w in enumerate(words):
        out[w] |= 1 << k
    return dict(out)


Group = tuple[LatentSpace, list["Item"], np.ndarray, np.ndarray]


def prepare_items(ids: list[int], texts: list[str], space: LatentSpace) -> list[Group]:
    """(space, items, unit vectors, item of each vector) of the items that have words: those searched by their content words in space, and those with few of them in space.whole."""
    groups: tuple[tuple[LatentSpace, list, list, list], ...] = ((space, [], [], []), (space.whole, [], [], []))
    for item_id, text in zip(ids, texts):
        _, words = K.word_hashes(pa.array([text]))
        if not len(words):
            continue
        terms = _terms(words)
        own = ~space.common[terms]
        few = own.sum() < max(FEW_WORDS, FEW_SHARE * len(words))
        of, items, vectors, owners = groups[int(few)]
        spans = [(0, len(words))]
        if len(words) > LONG_ITEM:
            spans += [(a, a + 2 * BLOCK_WORDS) for a in range(0, len(words) - BLOCK_WORDS, BLOCK_WORDS)]
        _, ending = K.word_hashes(pa.array([answer_of(text)]))
        content = words if few else words[own]
        kept = ending[~of.common[_terms(ending)]]
        answer = kept if len(kept) else ending
        for a, b in spans:
            vector = of.basis[np.unique(terms[a:b])].sum(axis=0)
            vectors.append(vector / max(float(np.linalg.norm(vector)), 1e-12))
            owners.append(len(items))
        items.append(Item(int(item_id), len(words), _places(content.tolist()), len(content), _places(answer.tolist()), len(answer)))
    return [(of, items, np.array(vectors, dtype=np.float32).reshape(len(vectors), of.basis.shape[1]), np.array(owners, dtype=np.int64)) for of, items, vectors, owners in groups]


def verify(item: Item, words: list[int]) -> tuple[float, bool, bool]:
    """(share of the item's content words found in order, whether its answer is there, whether it is a leak)."""
    share = common_subsequence(item.places, item.size, words) / max(item.size, 1)
    answer = item.answer_size > 0 and common_subsequence(item.answer, item.answer_size, words) >= ANSWER * item.answer_size
    return share, answer, share >= STRONG or (share >= WEAK and answer)


def verify_near(item: Item, words: list[int]) -> tuple[float, bool, bool]:
    """verify() for an item of few content words: within one and a half times its length, for function words stand in any order anywhere, and from STRONG on."""
    size, step = item.n + max(item.n // 2, 1), max(item.n // 4, 1)
    share, answer, _ = max(verify(item, words[a : a + size]) for a in range(0, max(len(words) - size, 0) + step, step))
    return share, answer, share >= STRONG


def _term_counts(items: list[Item]) -> np.ndarray:
    """How many places of each item (those that are compared) hold each term."""
    out = np.zeros((len(items), TERMS), dtype=np.uint8)
    for k, item in enumerate(items):
        terms = _terms(np.array(list(item.places), dtype=np.uint64))
        counts = np.bincount(terms, weights=[mask.bit_count() for mask in item.places.values()], minlength=TERMS)
        out[k] = np.minimum(counts, 255)
    return out


def _can_hold(which: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Upper bound of the common subsequence of item which[i] and the words a[i] to b[i], or -1 where it is under need[i].

    No more words can be in common than the words of the window whose term the item has, nor
    more than the item's places whose term the window has; so nothing that verifies is lost.
    """
    bound = np.full(len(which), -1, dtype=np.int64)
    step = max(1, (1 << 21) // max(int((b - a).max()), 1)) if len(which) else 1
    for lo in range(0, len(which), step):
        w, s, sizes = which[lo : lo + step], a[lo : lo + step], (b - a)[lo : lo + step]
        ends = np.cumsum(sizes)
        flat = terms[np.repeat(s - (ends - sizes), sizes) + np.arange(ends[-1])]
        owner = np.repeat(np.arange(len(w)), sizes)
        held = counts[w[owner], flat]
        hit = np.flatnonzero(held)
        seen = np.bincount(owner[hit], minlength=len(w))
        some = seen[owner[hit]] >= need[lo : lo + step][owner[hit]]
        key = owner[hit][some] * TERMS + flat[hit][some]
        key, first = np.unique(key, return_index=True)
        places = np.bincount(key // TERMS, weights=held[hit][some][first], minlength=len(w)).astype(np.int64)
        places[np.bincount(key // TERMS, weights=held[hit][some][first] == 255, minlength=len(w)) > 0] = 1 << 30
        top = np.minimum(seen, places)
        bound[lo : lo + step] = np.where(top >= need[lo : lo + step], top, -1)
    return bound


def _crowded(of: np.ndarray, own: np.ndarray, terms: np.ndarray, items: list[Item], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) around which one and a half times the item's length can hold STRONG of its words, whatever the cosine."""
    edges = np.searchsorted(own, np.arange(len(of) + 1))
    filled = np.flatnonzero(np.diff(edges))
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(filled):
        for k, item in enumerate(items):
            weight = np.zeros(len(of), dtype=np.int64)
            weight[filled] = np.add.reduceat(counts[k][terms].astype(np.int64), edges[:-1][filled])
            sums = np.concatenate(([0], np.cumsum(weight)))
            reach = (item.n + item.n // 2) // BLOCK_WORDS + 2
            at = np.arange(len(of))
            stop = np.minimum(np.searchsorted(of, of, side="right"), at + reach)
            start = np.maximum(np.searchsorted(of, of), at - reach)
            full = counts[k].max() == 255
            near = (sums[stop] - sums[start] >= STRONG * item.size) & (weight > 0) if not full else weight > 0
            at = np.flatnonzero(near)
            out.append((at, np.full(len(at), k)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def search_slice(texts: pa.Array, groups: list[tuple], min_cosine: float) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(cosine, lcs, answer) by (row, item id) of the leaks in some texts; of several passages the one with the most words in common."""
    n = len(texts)
    doc, words = K.word_hashes(texts)
    found: dict[tuple[int, int], tuple[float, float, bool]] = {}
    if not len(doc):
        return found
    block, blocks = _blocks(doc, n)
    word_terms = _terms(words)
    every_own, every_term = _distinct_terms(block, word_terms)
    of = np.repeat(np.arange(n), blocks)
    joined = np.flatnonzero(of[1:] == of[:-1])
    first_word, first_block = np.searchsorted(doc, np.arange(n + 1)), np.concatenate(([0], np.cumsum(blocks)))
    for basis, common, items, vectors, owners, counts, lengths, sizes, whole in groups:
        content = ~common[every_term]
        own, terms = every_own[content], every_term[content]
        edges = np.searchsorted(own, np.arange(len(of) + 1))
        sums, sizes_of = np.zeros((len(of), basis.shape[1]), dtype=np.float32), np.diff(edges)
        # the k-th term of every block at once: many times faster than sums over ranges of rows
        for k in range(int(sizes_of.max())):
            some = np.flatnonzero(sizes_of > k)
            sums[some] += basis[terms[edges[some] + k]]
        passage = sums.copy()
        passage[joined] += sums[joined + 1]
        passage /= np.maximum(np.linalg.norm(passage, axis=1, keepdims=True), 1e-12)
        parts = [_crowded(of, own, terms, items, counts)] if whole else []
        if not whole:
            step = max(1, COSINES // len(of))
            for lo in range(0, len(vectors), step):
                at, vector = np.nonzero(passage @ vectors[lo : lo + step].T >= min_cosine)
                parts.append((at, owners[vector + lo]))
        pairs = np.concatenate([x[0] * len(items) + x[1] for x in parts])
        pairs.sort()
        pairs = pairs[np.concatenate((pairs[:1] >= 0, pairs[1:] != pairs[:-1]))]
        at, which = pairs // len(items), pairs % len(items)
        start = first_word[of[at]] + (at - first_block[of[at]]) * BLOCK_WORDS
        a = np.maximum(first_word[of[at]], start - lengths[which])
        b = np.minimum(first_word[of[at] + 1], start + 2 * BLOCK_WORDS + lengths[which])
        bound = _can_hold(which, a, b, np.ceil((STRONG if whole else WEAK) * sizes[which] - 1e-9), word_terms, counts)
        near = np.flatnonzero(bound >= 0)
        near = near[np.lexsort((near, -bound[near] / sizes[which[near]]))]
        for k in near.tolist():
            item, key = items[which[k]], (int(of[at[k]]), items[which[k]].item_id)
            best = found.get(key)
            if best is not None and (best[1], best[2]) >= (bound[k] / item.size, True):
                continue
            share, answer, leak = (verify_near if whole else verify)(item, words[a[k] : b[k]].tolist())
            if leak and (best is None or (share, answer) > (best[1], best[2])):
                found[key] = (round(float((vectors[owners == which[k]] @ passage[at[k]]).max()), 4), share, answer)
    return found


def _shared(docs: DataFrame, groups: list[Group]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(
        [(space.basis, space.common, items, vectors, owners, _term_counts(items), np.array([x.n for x in items]), np.array([x.size for x in items]), space.whole is None) for space, items, vectors, owners in groups if items]
    )


def _search(docs: DataFrame, groups: list[Group], min_cosine: float) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, lcs double, answer boolean"
    shared = _shared(docs, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                found = search_slice(texts[lo:hi], groups, min_cosine)
                if found:
                    keys = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids[lo:hi].take(pa.array([d for d, _ in keys])),
                            pa.array([i for _, i in keys], pa.int64()),
                            *(pa.array([found[key][j] for key in keys], kind) for j, kind in enumerate((pa.float64(), pa.float64(), pa.bool_()))),
                        ],
                        names=["doc_id", "item_id", "cosine", "lcs", "answer"],
                    )

    return docs.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", min_cosine: float = MIN_COSINE, max_item_bytes: int = MAX_ITEM_BYTES
) -> DataFrame:
    """Documents that hold a benchmark item, as it stands or paraphrased: (doc_id, item_id, cosine, lcs, answer).

    cosine is that of the passage and the item in the latent space, lcs the share of the item's
    content words found there in order, answer whether the item's last sentence is there. A pair
    is a leak from lcs STRONG on, or from WEAK on along with the answer; of several passages of a
    text the one with the most words in common is reported. Every passage is compared with every
    item by cosine; all from min_cosine on are compared word by word, but for those whose terms
    rule a leak out. Words of over COMMON of the blocks are function words and left out; blocks
    that copy a benchmark item do not count there. An item that is left with few words is
    searched by all of them, wherever enough of them stand, and is a leak from STRONG on within
    one and a half times its length. The result does not depend on how docs is partitioned.

    Defined cases: ids are integers; null and wordless texts and items match nothing; null ids
    are reported as null; a repeated document row is reported again, and each text of an id that
    has several; of an item id that occurs twice the better match is reported; of equal matches
    any passage's cosine; other columns are ignored; an empty table on either side gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    searches = _searches(docs, benchmark, item_id_column, item_text_column, max_item_bytes)
    return reduce(DataFrame.unionByName, (_search(docs, groups, min_cosine) for groups in searches))


def _searches(docs: DataFrame, benchmark: DataFrame, item_id_column: str, item_text_column: str, max_item_bytes: int) -> list[list[Group]]:
    """The items of benchmark, prepared in the latent space of docs (id, text), as many at a time as one search holds."""
    items = pick(benchmark, id=item_id_column, text=item_text_column).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, math.ceil(size / max_item_bytes), math.ceil(count / MAX_ITEMS))

    def part_of(part: int) -> pa.Table:
        return items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id", "text").toArrow()

    bits = gram_filter(size // 4)
    first = part_of(0)
    for part in range(parts):
        add_grams(bits, K.as_array((part_of(part) if part else first)["text"]))
    space = latent_space(docs, bits)
    rows = (part_of(part) if part else first for part in range(parts))
    return [prepare_items(r["id"].to_pylist(), r["text"].to_pylist(), space) for r in rows]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """docs, all columns, without the rows in whose text find_leaks finds an item. Searched in place: no shuffle.

    Defined cases: ids are integers; rows of a null id stay, as do null and empty texts; of an id
    with several texts those that hold an item go, and repeated rows go together; column names
    cannot clash; an empty table on either side drops nothing.
    """
    base = pick(docs, id=id_column, text=text_column)
    place, key = docs.columns.index(text_column), docs.columns.index(id_column)
    for groups in _searches(base, benchmark, "item_id", "text", max_item_bytes):
        docs = _without(docs, _shared(docs, groups), key, place)
    return docs


def _without(docs: DataFrame, shared: Broadcast, key: int, place: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in batches:
            texts = batch.column(place)
            for lo, hi in K.slices(texts):
                stays = np.asarray(batch.column(key)[lo:hi].is_null()).copy()
                gone = np.zeros(hi - lo, dtype=bool)
                gone[[d for d, _ in search_slice(texts[lo:hi], groups, MIN_COSINE)]] = True
                yield batch.slice(lo, hi - lo).filter(pa.array(stays | ~gone))

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
