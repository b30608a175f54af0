"""N-gram Jaccard join: MinHash banding, then exact verification on the full n-gram sets.

Documents with the same n-gram set are folded onto their smallest doc_id first, so a
text copied a million times is signed, banded and verified once; the fold is undone
by an equi-join at the end. Only band hashes and the sets of candidates are shuffled.
Pairs of crowded buckets are neither listed nor shuffled: blocks of the bucket's documents
are held against each other. The query has a row a document: its class and the number of
its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.common import body_of, cut, pick, table

N_GRAM = 3
THRESHOLD = 0.55
TARGET_RECALL = 0.95
#: Hash functions of a signature, unless the threshold is so low that the target recall takes more.
MAX_PERMUTATIONS = 128


def choose_bands(threshold: float, target_recall: float, permutations: int = MAX_PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most selective banding that still finds a pair exactly at the threshold with target_recall.

    Bands of one row, as many as the recall takes, where the threshold is too low for more rows
    within so many permutations. Both arguments lie over 0, the recall under 1.
    """
    if not 0 < threshold <= 1 or not 0 < target_recall < 1:
        raise ValueError("threshold must be in (0, 1], target_recall in (0, 1)")
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-target_recall) / math.log1p(-hit))
        if best is None or bands * rows <= permutations:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signature_bands(doc: np.ndarray, grams: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents present, their band hashes as a matrix); doc must be sorted."""
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros((0, bands), dtype=np.uint64)
    a, b = _multipliers(bands * rows)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        acc = np.full(len(starts), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            low = np.minimum.reduceat(x * a[k] + b[k], starts)
            acc = K.mix64(acc * np.uint64(0x100000001B3) + low.astype(np.uint64))
        out[:, band] = acc
    return doc[starts], out


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, body, set_a, set_b, grams, bands) of docs (id, text, body): a 128-bit digest of the n-gram set, its size, and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                doc, words = K.word_hashes(texts[lo:hi])
                doc, grams = K.unique_per_doc(*K.word_ngrams(doc, words, n))
                present, hashes = signature_bands(doc, grams, bands, rows)
                if not len(present):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                digest = [np.add.reduceat(K.mix64(grams ^ np.uint64(salt)), starts) for salt in (0x51ED27, 0xB5297A4D)]
                size = np.diff(np.concatenate((starts, [len(doc)])))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi].take(pa.array(present)),
                        batch.column(2)[lo:hi].take(pa.array(present)),
                        pa.array(K.signed(digest[0])),
                        pa.array(K.signed(digest[1])),
                        pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(present) + 1, dtype=np.int32) * bands), pa.array(K.signed(hashes.ravel()))),
                    ],
                    names=["id", "body", "set_a", "set_b", "grams", "bands"],
                )

    return docs.mapInArrow(run, "id long, body int, set_a long, set_b long, grams int, bands array<long>")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, grams): the sorted distinct 64-bit n-gram hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                doc, words = K.word_hashes(texts[lo:hi])
                doc, grams = K.unique_per_doc(*K.word_ngrams(doc, words, n))
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [grams[edges[i] : edges[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(sets, pa.binary())], names=["id", "grams"])

    return docs.mapInArrow(run, "id long, grams binary")


#: Bytes of n-gram sets that one block of a crowded neighbourhood holds, and that one verifying task reads.
BLOCK_BYTES = 4 << 20
TASK_BYTES = 24 << 20
#: Pairs that one verifying task checks, about, and those it holds as Python numbers at once.
TASK_PAIRS, SLICE_PAIRS = 1 << 18, 1 << 16
#: Documents up to which the pairs of a band's bucket are listed, and documents of a block of a larger one.
HOT, BLOCK_DOCS = 64, 1024
#: Columns of the incidence matrices that are multiplied at once.
COLUMNS = 4096


def _score(threshold: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        column = K.as_array(sets["grams"])
        offsets, data = K.text_buffers(column)
        grams = np.frombuffer(data.tobytes(), dtype=np.uint64)
        at = offsets // 8
        place = {int(i): (int(s), int(e)) for i, s, e in zip(np.asarray(sets["id"]), at[:-1], at[1:])}
        a, b = np.asarray(pairs["a"]), np.asarray(pairs["b"])
        score = np.zeros(len(a))
        for lo in range(0, len(a), SLICE_PAIRS):
            for i, (x, y) in enumerate(zip(a[lo : lo + SLICE_PAIRS].tolist(), b[lo : lo + SLICE_PAIRS].tolist()), lo):
                (s, e), (u, v) = place[x], place[y]
                both = np.concatenate((grams[s:e], grams[u:v]))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                score[i] = common / (len(both) - common)
        keep = score >= threshold
        return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep]), "jaccard": pa.array(score[keep])})

    return run


def _verify(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates at or over the threshold, by their full sets.

    A pair is checked at the smallest candidate partner of its smaller document, so a set is
    shipped about once for a whole neighbourhood and not once a pair; neighbourhoods of more
    than BLOCK_BYTES are cut in blocks, and a task checks one pair of blocks.
    """
    lead = candidates.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("lead"))
    pairs = cut(candidates.join(lead, "a", "left").select(F.coalesce("lead", "a").alias("lead"), "a", "b"))
    sizes = sets.select("id", F.octet_length("grams").alias("bytes"))
    crowd = pairs.select("lead", F.explode(F.array("a", "b")).alias("id")).distinct().join(sizes, "id").groupBy("lead").agg(F.sum("bytes").alias("bytes"))
    total = crowd.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_BYTES), math.ceil(pairs.count() / TASK_PAIRS))
    blocks = crowd.where(F.col("bytes") > BLOCK_BYTES).select("lead", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    keyed = pairs.join(blocks, "lead", "left").withColumns({"x": block("a"), "y": block("b")})
    place = F.pmod(F.xxhash64("lead", F.least("x", "y"), F.greatest("x", "y")), F.lit(tasks)).cast("int")
    keyed = cut(keyed.select(place.alias("place"), "a", "b"))
    shipped = keyed.select(F.col("place").alias("spot"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id").select("spot", "id", "grams")
    return keyed.groupBy("place").cogroup(shipped.groupBy("spot")).applyInArrow(_score(threshold), "a long, b long, jaccard double")


def common_counts(left: np.ndarray, left_starts: np.ndarray, right: np.ndarray, right_starts: np.ndarray) -> np.ndarray:
    """How many values each set on the left shares with each on the right; sets are distinct values, one after the other."""
    out = np.zeros((len(left_starts) - 1, len(right_starts) - 1), dtype=np.float32)
    both = np.intersect1d(left, right)
    sides = []
    for values, starts in ((left, left_starts), (right, right_starts)):
        row, at = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.searchsorted(both, values)
        held = both[np.minimum(at, len(both) - 1)] == values if len(both) else np.zeros(len(values), bool)
        row, at = row[held], at[held]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for lo in range(0, len(both), COLUMNS):
        parts = []
        for (row, at), height in zip(sides, out.shape):
            s, e = np.searchsorted(at, (lo, lo + COLUMNS))
            part = np.zeros((height, min(COLUMNS, len(both) - lo)), dtype=np.float32)
            part[row[s:e], at[s:e] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T  # whole numbers under 2 ** 24: exact
    return out


def _forest(keep: np.ndarray, one_block: bool) -> tuple[list[int], list[int]]:
    """Edges (u, v) of a spanning forest of the links; of two blocks the columns are numbered after the rows."""
    height = keep.shape[0]
    links = keep | keep.T if one_block else keep
    left = np.ones(height if one_block else sum(keep.shape), dtype=bool)
    us, vs = [], []
    for root in range(height):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            u = queue.pop()
            if one_block:
                found = np.flatnonzero(links[u] & left)
            elif u < height:
                found = np.flatnonzero(links[u] & left[height:]) + height
            else:
                found = np.flatnonzero(links[:, u - height] & left[:height])
            left[found] = False
            us += [u] * len(found)
            vs += found.tolist()
            queue += found.tolist()
    return us, vs


def _cell(threshold: float, listed: bool):
    """Holds two blocks of a crowd, or one, against each other: all links, or a forest of them and each document's number."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        side, ids, leads, weight, count = (np.asarray(rows[c]) for c in ("side", "id", "lead", "weight", "size"))
        one_block = bool(rows["x"][0] == rows["y"][0])
        mixed = rows["lead_a"][0] != rows["lead_b"][0]
        at = [np.arange(len(ids))] * 2 if one_block else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        flat = {}
        for name in ("grams", "marks"):
            flat[name] = []
            for index in at[:1] if one_block else at:
                column = K.as_array(rows[name].take(pa.array(index)))
                if name == "marks":
                    values, starts = np.asarray(column.flatten()), np.asarray(pa.compute.list_value_length(column))
                else:
                    offsets, data = K.text_buffers(column)
                    values, starts = np.frombuffer(data.tobytes(), dtype=np.uint64)[offsets[0] // 8 : offsets[-1] // 8], np.diff(offsets) // 8
                flat[name].append((values, np.concatenate(([0], np.cumsum(starts, dtype=np.int64)))))
        (ra, rb), (ga, gb) = (flat[name] * 2 if one_block else flat[name] for name in ("marks", "grams"))
        keep = common_counts(*ra, *rb) > 0
        a, b = at
        na, nb = count[a][:, None].astype(np.float64), count[b][None, :].astype(np.float64)
        keep &= np.minimum(na, nb) >= threshold * np.maximum(na, nb)
        if one_block:
            keep &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        if mixed:
            keep &= leads[a][:, None] != leads[b][None, :]
        if keep.any():
            common = common_counts(*ga, *gb).astype(np.float64)
            score = common / (na + nb - common)
            keep &= score >= threshold
        if listed:
            i, j = np.nonzero(keep)
            x, y = ids[a[i]], ids[b[j]]
            return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y)), "jaccard": pa.array(score[i, j] if len(i) else np.zeros(0)), "near": pa.nulls(len(i), pa.int64())})
        near = np.zeros(len(ids), dtype=np.int64)
        np.add.at(near, a, keep @ weight[b])
        np.add.at(near, b, weight[a] @ keep)
        u, v = _forest(keep, one_block)
        name = ids[a] if one_block else np.concatenate((ids[a], ids[b]))
        u, v, linked = name[np.array(u, np.int64)], name[np.array(v, np.int64)], np.flatnonzero(near)
        return pa.table(
            {
                "a": pa.array(np.concatenate((np.minimum(u, v), ids[linked]))),
                "b": pa.concat_arrays([pa.array(np.maximum(u, v)), pa.nulls(len(linked), pa.int64())]),
                "jaccard": pa.nulls(len(u) + len(linked), pa.float64()),
                "near": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(near[linked])]),
            }
        )

    return run


def _crowds(hot: DataFrame, marked: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: float, listed: bool) -> DataFrame:
    """(a, b, jaccard, near) of the pairs that share a crowded bucket: see _cell.

    hot (id, bucket) are the documents of crowded buckets, marked (id, lead, marks) each of them with its
    buckets and the smallest document of these. Documents meet under the pair of their leads, so that each
    pair is checked once, however many buckets it shares; who meets there is cut in blocks of BLOCK_DOCS and
    BLOCK_BYTES, and a task holds two blocks at a time. A set is shipped once for each block of its crowd.
    """
    of = hot.join(marked.select("id", "lead"), "id")
    leads = of.select("bucket", F.col("lead").alias("other")).distinct()
    meet = cut(of.join(leads, "bucket").select(F.least("lead", "other").alias("lead_a"), F.greatest("lead", "other").alias("lead_b"), "id").distinct())
    data = cut(
        marked.join(sets, "id").join(sizes.select(F.col("rep").alias("id"), F.col("size").alias("weight")), "id")
        .select("id", "lead", "marks", "grams", "weight", (F.octet_length("grams") / 8).cast("long").alias("size"))
    )
    crowd = meet.join(data.select("id", "size"), "id").groupBy("lead_a", "lead_b").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("grams"))
    blocks = crowd.select("lead_a", "lead_b", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        meet.join(blocks, ["lead_a", "lead_b"])
        .select("lead_a", "lead_b", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("lead_a", "lead_b", "id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    shipped = cells.join(data, "id").select("lead_a", "lead_b", "x", "y", "side", "id", "lead", "marks", "grams", "weight", "size")
    return shipped.groupBy("lead_a", "lead_b", "x", "y").applyInArrow(_cell(threshold, listed), "a long, b long, jaccard double, near long")


def similar_sets(
    docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, listed: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(members, edges, near, standing) of a table (id, text).

    members (rep, id): every document with at least one word, under the smallest id that has
    the same n-gram set. edges (a, b, jaccard): pairs of representatives, a < b, at or over
    the threshold. Unless they are to be listed, of those that share a crowded bucket only enough
    to lead to the same documents; near (rep, near) has the number of documents at their other ends,
    for all links, and is None if they are listed. standing (id, stands): of each id with several
    texts the hash (body_of) of the one that takes part; None if there are none.
    """
    bands, rows = choose_bands(threshold, target_recall)
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    signed = cut(sign(docs.select("id", "text", body_of().alias("body")), n, bands, rows))
    standing = cut(signed.groupBy("id").agg(F.min("body").alias("stands"), F.max("body").alias("other")).where("stands <> other").select("id", "stands"))
    if standing.isEmpty():
        standing = None
    else:
        others = standing.select(F.col("id").alias("id_"), "stands")
        signed = signed.join(others, F.col("id") == F.col("id_"), "left").where("stands is null or body = stands").drop("id_", "stands")
        docs = docs.join(others, F.col("id") == F.col("id_"), "left").where(F.col("stands").isNull() | (body_of() == F.col("stands"))).select("id", "text")
    key = ["set_a", "set_b", "grams"]
    heads = signed.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = signed.select("id", *key).join(heads.where("copies > 1").select("rep", *key), key).select("rep", "id")
    singles = heads.where("copies = 1").select("rep", F.col("rep").alias("id"))
    members = cut(members.unionByName(singles).distinct())
    reps = signed.join(members.where("id <> rep").select("id"), "id", "left_anti").dropDuplicates(["id"])
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    bucket = Window.partitionBy("band", "hash")
    banded = reps.select("id", "grams", F.posexplode("bands").alias("band", "hash"))
    shared = cut(banded.withColumns({"held": F.count(F.lit(1)).over(bucket), "first": F.min("id").over(bucket)}).where("held > 1"))
    few = shared.where(F.col("held") <= HOT).select("id", "grams", "band", "hash")
    other = few.select(F.col("id").alias("id2"), F.col("grams").alias("grams2"), "band", "hash")
    candidates = (
        few.join(other, ["band", "hash"])
        .where((F.col("id") < F.col("id2")) & (F.least("grams", "grams2") >= threshold * F.greatest("grams", "grams2")))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
        .distinct()
    )
    hot = shared.where(F.col("held") > HOT).select("id", F.xxhash64("band", "hash").alias("bucket"), "first")
    crowded = not hot.isEmpty()
    if crowded:
        marked = cut(hot.groupBy("id").agg(F.min("first").alias("lead"), F.collect_set("bucket").alias("marks")))
        # pairs that share a crowded bucket too are checked with it
        for end in ("a", "b"):
            candidates = candidates.join(marked.select(F.col("id").alias(end), F.col("marks").alias(f"marks_{end}")), end, "left")
        candidates = candidates.where(~F.coalesce(F.arrays_overlap("marks_a", "marks_b"), F.lit(False))).select("a", "b")
    candidates = cut(candidates)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id"))
    if crowded:
        wanted = wanted.unionByName(marked.select("id"))
    sets = cut(gram_sets(docs.join(wanted.distinct(), "id", "left_semi"), n).dropDuplicates(["id"]))
    edges, near = cut(_verify(candidates, sets, threshold)), None
    crowds = cut(_crowds(hot.select("id", "bucket"), marked, sets, sizes, threshold, listed)) if crowded else None
    if not listed:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(sizes.select(F.col("rep").alias("b"), "size"), "b").select(F.col("a").alias("rep"), F.col("size").alias("near"))
        if crowded:
            near = near.unionByName(crowds.where("near is not null").select(F.col("a").alias("rep"), "near"))
        near = near.groupBy("rep").agg(F.sum("near").alias("near"))
    if crowded:
        edges = edges.unionByName(crowds.where("near is null").select("a", "b", "jaccard"))
    return members, edges, near, standing


def ngram_jaccard_join(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """Every pair of documents whose word n-gram sets have a Jaccard similarity of at least threshold.

    Result: (doc_a, doc_b, jaccard) with doc_a < doc_b, each pair once. Bands and rows come from
    choose_bands; a pair at the threshold is found with probability target_recall, a pair of equal
    sets always. There is no cap on the partners of a document: all pairs inside a group of
    copies are returned, at a cost in proportion to the number of pairs.

    Defined cases: ids are integers; a null id or text takes no part; a text without words has no
    n-grams and is similar to nothing; a text of fewer than n words has one gram, of all its words;
    repeated rows of one id count once, and of an id with several texts one takes part (the one of
    the smallest hash); pairs exactly at the threshold count; other columns are ignored; an empty
    table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    members, edges, _, _ = similar_sets(docs, n, threshold, target_recall)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    crowded = members.where("id <> rep").select("rep").distinct()
    groups = members.join(crowded, "rep", "left_semi")
    copies = (
        groups.select("rep", F.col("id").alias("x")).join(groups.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    )
    near = edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "jaccard")
    return copies.unionByName(near).select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the connected components of edges (a, b); root is the smallest id. Ids without an edge are not listed.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm
    of the longest chain, and no step gathers a component's edges in more than one row each.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        edges = cut(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = tuple(now)


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """docs without those whose group of near copies has a smaller id; groups are connected components of the join's pairs.

    Defined cases: as in ngram_jaccard_join; all columns of docs stay, whatever their names; rows
    that take no part in the join (null id, null or wordless text, another text of an id with
    several) stay as they are; repeated rows stay or go together.
    """
    members, edges, _, standing = similar_sets(pick(docs, id=id_column, text=text_column), n, threshold, target_recall, listed=False)
    star = components(edges.select("a", "b"))
    root = star.where("id <> root").select(F.col("id").alias("rep"), "root")
    losers = members.where("id <> rep").select("id").unionByName(root.select(F.col("rep").alias("id"))).distinct()
    gone = docs[id_column] == losers["id"]
    if standing is not None:
        losers = losers.join(standing, "id", "left")
        gone = (docs[id_column] == losers["id"]) & (losers["stands"].isNull() | (body_of(docs[text_column]) == losers["stands"]))
    return docs.join(losers, gone, "left_anti")


def ngram_jaccard_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """Every document with its class and the number of its links: (doc_id, class_id, links).

    Links are the pairs of ngram_jaccard_join, all of them: of different sets each is verified, and
    those inside and between groups of copies are counted by the sizes of the groups and not made.
    class_id is the smallest id that a chain of links leads to. The output has a row for each id,
    however many copies there are.

    Defined cases: as in ngram_jaccard_join; an id that takes no part in the join (null or wordless
    text) is a class of its own without links; a null id has no row, a repeated one has one.
    """
    docs = pick(docs, id=id_column, text=text_column)
    members, edges, near, _ = similar_sets(docs, n, threshold, target_recall, listed=False)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    root = components(edges).select(F.col("id").alias("rep"), "root")
    classes = (
        sizes.join(near, "rep", "left")
        .join(root, "rep", "left")
        .select("rep", F.coalesce("root", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    )
    found = members.join(classes, "rep").select("id", "class_id", "links")
    ids = docs.where(F.col("id").isNotNull()).select("id").distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"))


#: Classes and links of all pairs by their shared n-grams. MinHash finds a pair at the threshold with the target recall, others with more.
OP1_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N_GRAM} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {N_GRAM} + 2), lambda i: array_to_string(w[i : i + {N_GRAM} - 1], ' ')) END) AS gram
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), shared AS (
    SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS MATERIALIZED (
    SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
    WHERE c::DOUBLE / (x.n + y.n - c) >= {THRESHOLD}
), linked AS MATERIALIZED (
    SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL
    UNION
    SELECT reach.doc_id, b FROM reach JOIN linked ON a = other
), counts AS (
    SELECT a, count(*) AS n FROM linked GROUP BY 1
), classes AS (
    SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1
)
SELECT doc_id, class_id, coalesce(n, 0) AS links FROM classes LEFT JOIN counts ON a = doc_id
"""
