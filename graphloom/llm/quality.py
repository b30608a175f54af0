"""Quality rules: an isolation forest over rule statistics of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.common import cut, pick, ranges, table
from graphloom.llm.labelled import best_limit, best_limit_over

TREES = 200
SUBSAMPLE = 256
#: Rows the trees draw in all, each from all labelled rows of its half; no more rows reach the driver.
TRAINING_ROWS = TREES * SUBSAMPLE
#: Ordinary words every text counts in addition, so that a few words are no evidence of anything.
PRIOR_WORDS = 10

STATISTICS = (
    "mean_word_bytes", "symbol_share", "digit_share", "upper_share", "punctuation_share", "long_word_share",
    "distinct_word_share", "repeated_line_share", "repeated_pair_share", "words_per_line", "plain_word_share", "top_word_share",
)

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 letter, 2 digit, 3 space, 4 punctuation, 5 symbol
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def rule_statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; an empty or null text has zeros."""
    n = len(texts)
    offsets, raw = K.text_buffers(texts)
    out = np.zeros((n, len(STATISTICS)))
    if not len(raw):
        return out
    total = np.diff(offsets)

    def share_of(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return np.diff(sums[offsets])

    kinds = _CLASS[raw]
    letters = share_of(kinds == 1)
    low_offsets, low = K.text_buffers(pc.utf8_lower(texts))
    if len(low) == len(raw):
        upper = share_of(low != raw)
    else:
        upper = share_of((raw >= 65) & (raw <= 90))
    doc, starts, ends = K.word_spans(low_offsets, low)
    words = np.bincount(doc, minlength=n)
    width = ends - starts
    hashes = K.segment_hash(low, starts, ends)

    def distinct(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, count of the commonest) of each text."""
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(of)])))
        top = np.zeros(n, dtype=np.int64)
        np.maximum.at(top, of[first], size)
        return np.bincount(of[first], minlength=n), top

    different, top = distinct(doc, hashes)
    pair_doc, pairs = K.word_ngrams(doc, hashes, 2)
    pair_count = np.bincount(pair_doc, minlength=n)
    pair_different, _ = distinct(pair_doc, pairs)
    line_starts, line_ends = K.runs(raw != 10, offsets)
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    line_different, _ = distinct(line_doc, K.segment_hash(raw, line_starts, line_ends))
    # tokens between spaces that hold letters and closing punctuation only
    token_starts, token_ends = K.runs(kinds != 3, offsets)
    token_doc = np.searchsorted(offsets, token_starts, side="right") - 1
    odd = np.concatenate(([0], np.cumsum((kinds != 1) & (kinds != 4))))
    plain = (odd[token_ends] - odd[token_starts]) == 0
    tokens = np.bincount(token_doc, minlength=n)
    columns = {
        "mean_word_bytes": (np.bincount(doc, weights=width, minlength=n) + 6 * PRIOR_WORDS) / (words + PRIOR_WORDS),
        "symbol_share": share_of(kinds == 5) / (total + 6 * PRIOR_WORDS),
        "digit_share": share_of(kinds == 2) / (total + 6 * PRIOR_WORDS),
        "upper_share": upper / (letters + 6 * PRIOR_WORDS),
        "punctuation_share": share_of(kinds == 4) / (total + 6 * PRIOR_WORDS),
        "long_word_share": np.bincount(doc, weights=width > 16, minlength=n) / (words + PRIOR_WORDS),
        "distinct_word_share": np.log1p(different) - np.log1p(words),
        "repeated_line_share": (lines - line_different) / (lines + 2),
        "repeated_pair_share": (pair_count - pair_different) / (pair_count + PRIOR_WORDS),
        "words_per_line": np.log1p((words + 2 * PRIOR_WORDS) / (lines + 1)),
        "plain_word_share": (np.bincount(token_doc, weights=plain, minlength=n) + PRIOR_WORDS) / (tokens + PRIOR_WORDS),
        "top_word_share": top / (words + PRIOR_WORDS),
    }
    for k, name in enumerate(STATISTICS):
        out[:, k] = columns[name]
    out[np.diff(offsets) == 0] = 0
    return out


def _expected_depth(n: float) -> float:
    """Mean depth at which a search in a random tree of n rows ends without success."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat arrays: a leaf has feature -1 and its path length in value."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float
    anomalous_over: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / normal path): near 1 for rows that random splits isolate early."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[row, np.maximum(f, 0)] < self.value[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            total += self.value[at]
        return np.power(2.0, -total / (len(self.roots) * self.norm)) if len(self.roots) else np.zeros(len(x))


def grow_trees(samples: list[np.ndarray], size: int, seed: int = 13) -> IsolationForest:
    """A tree for each sample of size rows; none where size is under 2."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    feature, value, left, right, roots = [], [], [], [], []

    def node() -> int:
        for part in (feature, value, left, right):
            part.append(-1)
        return len(feature) - 1

    for x in samples if size > 1 else []:
        root = node()
        roots.append(root)
        stack = [(root, x, 0)]
        while stack:
            at, rows, depth = stack.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                value[at] = depth + _expected_depth(len(rows))
                continue
            f = int(rng.choice(usable))
            split = rng.uniform(low[f], high[f])
            under = rows[:, f] < split
            if not under.any() or under.all():
                value[at] = depth + _expected_depth(len(rows))
                continue
            feature[at], value[at], left[at], right[at] = f, split, node(), node()
            stack += [(left[at], rows[under], depth + 1), (right[at], rows[~under], depth + 1)]
    return IsolationForest(
        np.array(feature, dtype=np.int64), np.array(value, dtype=np.float64), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(roots, dtype=np.int64), limit + 1, max(_expected_depth(size), 1.0), 2.0
    )


def grow_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 13) -> IsolationForest:
    rng, size = np.random.default_rng(seed), min(subsample, len(x))
    return grow_trees([x[rng.choice(len(x), size, replace=False)] for _ in range(trees)], size, seed)


@dataclass(frozen=True)
class Draws:
    """Of each tree the ranks of its good and of its bad rows, among all labelled rows of that class."""

    trees: list[tuple[np.ndarray, np.ndarray]]
    size: int
    halves: int

    def ranks(self, kind: int) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(t[kind] for t in self.trees)]))

    def grow(self, good: np.ndarray, bad: np.ndarray) -> IsolationForest:
        """The forest from the rows of ranks(0) and ranks(1)."""
        places = self.ranks(0), self.ranks(1)
        return grow_trees([np.concatenate((good[np.searchsorted(places[0], g)], bad[np.searchsorted(places[1], b)])) for g, b in self.trees], self.size)

    def held_out(self, forest: IsolationForest, x: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Scores of labelled rows by the trees of the other half."""
        if self.halves == 1:
            return forest.score(x)
        out, middle = np.zeros(len(x)), len(forest.roots) // 2
        for half, roots in enumerate((forest.roots[middle:], forest.roots[:middle])):
            own = rank % 2 == half
            out[own] = replace(forest, roots=roots).score(x[own])
        return out


def draw(good: int, bad: int, bad_share: float = 0.02, seed: int = 13) -> Draws:
    """What the trees draw from so many good and bad rows. Those of even rank in their class are one half, for the first
    half of the trees; a class of one row, or a lacking one, leaves it at one."""
    bad = bad if good else 0
    halves = 2 if good > 1 and bad > 1 else 1
    counts = [(len(range(h, good, halves)), len(range(h, bad, halves))) for h in range(halves)]
    few = [min(b, max(1, int(bad_share * g))) for g, b in counts]
    size = min(SUBSAMPLE, *(g + k for (g, _), k in zip(counts, few)))
    trees, rng = [], np.random.default_rng(seed)
    for half, ((g, b), k) in enumerate(zip(counts, few)):
        for _ in range(TREES // halves):
            odd = int(rng.hypergeometric(k, g, size)) if k else 0
            trees.append((rng.choice(g, size - odd, replace=False) * halves + half, rng.choice(b, odd, replace=False) * halves + half))
    return Draws(trees, size, halves)


def fit_quality(texts: pa.Array, good: np.ndarray, weight: np.ndarray | None = None, bad_share: float = 0.02) -> IsolationForest:
    """The forest and its limit from labelled texts (1 good, 0 bad); weight is how many texts each stands for.

    Half of the trees are grown on one half of the rows, the others on the other. A tree draws its
    rows from all good ones of its half with a few of all bad ones (bad_share), so that splits
    also fall in ranges that only bad texts reach while those stay rare enough to be isolated
    early. The limit has the best F1 for bad rows over all rows, each scored by the trees of the
    other half; where there are no two rows of each class, all trees draw from and score all rows.
    Without both labels nothing is anomalous.
    """
    x = np.concatenate([rule_statistics(texts[lo:hi]) for lo, hi in K.slices(texts)]) if len(texts) else np.zeros((0, len(STATISTICS)))
    good = np.asarray(good).astype(bool)
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, dtype=np.float64)
    draws = draw(int(good.sum()), int((~good).sum()), bad_share)
    forest = draws.grow(x[good][draws.ranks(0)], x[~good][draws.ranks(1)])
    if not good.any() or good.all():
        return forest
    rank = np.where(good, np.cumsum(good), np.cumsum(~good)) - 1
    limit = best_limit(draws.held_out(forest, x, rank), ~good, weight)
    return replace(forest, anomalous_over=min(limit, 2.0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(s).fill_null(0.0)) for s in STATISTICS])


def fit_quality_over(labelled: DataFrame) -> IsolationForest:
    """fit_quality of all rows (id, good, *STATISTICS) in the order of their distinct ids; only rows that trees draw and sums reach the driver."""
    rows = ranges(labelled, "id")
    counts = sorted(tuple(r) for r in rows.groupBy("part", "good").count().collect())
    total, before = {True: 0, False: 0}, []
    for part, good, n in counts:
        before.append((part, good, total[good]))
        total[good] += n
    draws = draw(total[True], total[False])
    wanted = [draws.ranks(0), draws.ranks(1)]
    offset = labelled.sparkSession.createDataFrame(before, "part int, good boolean, before long")
    rank = F.row_number().over(Window.partitionBy("part", "good").orderBy("id")) - 1 + F.col("before")
    ranked = rows.join(F.broadcast(offset), ["part", "good"]).select("good", rank.cast("long").alias("rank"), *STATISTICS)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, at = np.asarray(batch.column("good")), np.asarray(batch.column("rank"))
            yield batch.filter(pa.array(np.where(good, np.isin(at, wanted[0]), np.isin(at, wanted[1]))))

    found = ranked.mapInArrow(drawn, ranked.schema).toArrow().combine_chunks().sort_by("rank")
    x = np.column_stack([found[s].to_numpy() for s in STATISTICS])
    good = found["good"].to_numpy().astype(bool)
    forest = draws.grow(x[good], x[~good])
    if not total[True] or not total[False]:
        return forest

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = draws.held_out(forest, _matrix(batch), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(~np.asarray(batch.column("good")))], names=["score", "positive"])

    return replace(forest, anomalous_over=min(best_limit_over(ranked.mapInArrow(judged, "score double, positive boolean")), 2.0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Anomaly of every document: (doc_id, anomaly, keep) and the statistics it rests on.

    keep is false where anomaly reaches the limit. Statistics are taken once of every whole text;
    the trees draw from all labelled documents, and the limit is calibrated on all of them.

    Defined cases: ids are integers; an anomaly equal to the limit is not kept; a null text has null anomaly and statistics and is not kept; an empty text
    has zero statistics and is scored like any other; rows of a null or repeated id are scored
    as they stand; of an id that is labelled twice the larger label counts, of a labelled id with
    several texts the one of the smallest statistics; other columns are ignored; without labels
    of both kinds all texts are kept; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    labels = pick(labels, id=id_column, good=label_column)
    columns = ", ".join(f"{s} double" for s in STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                x, none = rule_statistics(texts[lo:hi]), np.asarray(texts[lo:hi].is_null())
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *(pa.array(x[:, k], mask=none) for k in range(len(STATISTICS)))], names=["id", *STATISTICS])

    measured = cut(docs.mapInArrow(measure, f"id long, {columns}"))
    named = labels.where(F.col("id").isNotNull() & F.col("good").isNotNull()).groupBy("id").agg(F.max("good").cast("boolean").alias("good"))
    labelled = measured.where(F.col("id").isNotNull() & F.col(STATISTICS[0]).isNotNull()).join(named, "id")
    labelled = labelled.groupBy("id", "good").agg(F.min(F.struct(*STATISTICS)).alias("x")).select("id", "good", "x.*")
    forest = fit_quality_over(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, none = forest.score(_matrix(batch)), np.asarray(batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, mask=none), pa.array((score < forest.anomalous_over) & ~none), *batch.columns[1:]], names=["doc_id", "anomaly", "keep", *STATISTICS]
            )

    return measured.mapInArrow(run, f"doc_id long, anomaly double, keep boolean, {columns}")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
