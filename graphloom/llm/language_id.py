"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import kernels as K
from graphloom.llm.common import pick, table
from graphloom.llm.labelled import labelled_sample

#: Labelled documents the binary classifiers are fitted on, at most.
TRAINING_ROWS = 3000
BUCKETS = 4096
#: Share of right held-out answers that the ambiguity limit may flag.
FLAG_SHARE = 0.01


@dataclass(frozen=True)
class EcocModel:
    languages: list[str]
    code: np.ndarray
    loss_weights: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    ambiguous_under: float


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 code of one row a class: all distinct splits up to 7 classes, beyond that random columns with rows far apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 7:
        columns = [[1] + [1 if (mask >> i) & 1 else -1 for i in range(classes - 1)] for mask in range(2 ** (classes - 1) - 1)]
        return np.array(columns, dtype=np.float64).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(15 * np.log2(classes)))
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        code = code[:, (np.abs(code.sum(axis=0)) < classes)]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(classes, dtype=int) * bits
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that ends at each position."""
    x = data.astype(np.uint32)
    h = x * np.uint32(0x9E3779B1)
    h[1:] ^= x[:-1] * np.uint32(0x85EBCA6B)
    h[2:] += x[:-2] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(20)).astype(np.int32)


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, whether a letter is among the trigram) of the lower-cased texts."""
    offsets, data = K.text_buffers(pc.utf8_lower(texts))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    near = letter.copy()
    near[1:] |= letter[:-1]
    near[2:] |= letter[:-2]
    bucket = _gram_buckets(data)
    for k in (0, 1):
        head = offsets[:-1] + k
        near[head[head < offsets[1:]]] = False
    return offsets, bucket, near


def _frequencies(texts: pa.Array) -> np.ndarray:
    """Root of the relative trigram frequencies of each text; for training only."""
    offsets, bucket, near = _prepared(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[near]
    counts = np.bincount(doc * BUCKETS + bucket[near], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _margins(model: EcocModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, margin of every bit) of each text."""
    offsets, bucket, near = _prepared(texts)
    total = np.concatenate(([0], np.cumsum(near)))
    edges = total[offsets]
    n = np.diff(edges)
    gathered = model.weights[bucket[near]]
    sums = np.zeros((len(texts), model.weights.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(gathered, edges[:-1][some], axis=0)
    return n, sums / np.maximum(n, 1)[:, None] + model.bias


def decode(model: EcocModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest codeword, its loss, how much nearer it is than the next): exponential loss, each bit weighted by its class's accuracy."""
    loss = np.exp(-np.clip(margins[:, None, :] * model.code[None, :, :], -4, 4))
    distance = (loss * model.loss_weights[None, :, :]).sum(axis=2)
    order = np.argsort(distance, axis=1, kind="stable")
    row = np.arange(len(margins))
    best = distance[row, order[:, 0]]
    second = distance[row, order[:, 1]] if distance.shape[1] > 1 else np.full(len(margins), np.inf)
    return order[:, 0], best, second - best


def fit_language_id(texts: pa.Array, languages: list[str]) -> EcocModel:
    """Least-squares binary classifiers of the code's bits; loss weights and the ambiguity limit come from a held-out fifth."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    code = codewords(len(names))
    x = np.concatenate([_frequencies(texts[lo:hi]) for lo, hi in K.slices(texts)]) if len(texts) else np.zeros((0, BUCKETS), np.float32)
    if len(names) < 2:
        return EcocModel(names, code, np.ones_like(code), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 0.0)
    # counts vary with their mean: dividing by its root makes the buckets comparable
    scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5)
    held = np.arange(len(label)) % 5 == 4
    if held.sum() < 10:
        held[:] = False
    train = ~held
    z = x[train] * scale
    mean = z.mean(axis=0)
    z = z - mean
    gram = (z @ z.T).astype(np.float64)
    target = code[label[train]]
    bias = target.mean(axis=0)
    ridge = 0.02 * np.trace(gram) / len(gram) + 1e-9
    alpha = np.linalg.solve(gram + ridge * np.eye(len(gram)), target - bias)
    w = z.T.astype(np.float64) @ alpha
    bias = bias - mean @ w
    weights = (w * scale[:, None]).astype(np.float32)
    check = held if held.any() else train
    margins = x[check].astype(np.float64) @ weights + bias
    hits = np.vstack([((np.sign(margins) == code[label[check]])[label[check] == c]).mean(axis=0) if (label[check] == c).any() else np.ones(code.shape[1]) for c in range(len(names))])
    loss_weights = np.maximum(hits, 1e-3)
    loss_weights = loss_weights / loss_weights.sum(axis=1, keepdims=True)
    model = EcocModel(names, code, loss_weights, weights, bias, 0.0)
    got, _, gap = decode(model, margins)
    right = gap[got == label[check]]
    limit = float(np.quantile(right, FLAG_SHARE)) if len(right) else 0.0
    return EcocModel(names, code, loss_weights, weights, bias, limit)


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Language of every document: (doc_id, language, loss, gap, ambiguous).

    loss is the distance to the nearest codeword, gap how much farther the second is; ambiguous
    marks a gap under the limit that FLAG_SHARE of the right held-out answers fall under.
    The bit classifiers are fitted on at most training_rows rows that carry a language; a rare
    one has a fixed share of them.

    Defined cases: ids are integers; of equally near codewords that of the first language in
    alphabetical order is taken, and flagged; a null text, or one without a letter, has a null language and is ambiguous;
    rows of a null or repeated id are answered as they stand; with a single labelled language
    every other text is of that language; with none all languages are null; other columns are
    ignored; an empty table gives no rows.
    """
    named = pick(docs, id=id_column, text=text_column, label=language_column)
    sample = labelled_sample(named.select("id", "text"), named.where("text is not null").select("id", "label"), training_rows, "label")
    model = fit_language_id(K.as_array(sample["text"]), sample["label"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                part = texts[lo:hi]
                n, margins = _margins(model, part)
                none = n == 0
                if not model.languages:
                    none[:] = True
                    got, best, gap = np.zeros(len(part), np.int64), np.zeros(len(part)), np.zeros(len(part))
                    spoken = pa.nulls(len(part), pa.string())
                else:
                    got, best, gap = decode(model, margins)
                    spoken = names.take(pa.array(got, mask=none))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], spoken, pa.array(best, mask=none), pa.array(gap, mask=none), pa.array(none | (gap < model.ambiguous_under))],
                    names=["doc_id", "language", "loss", "gap", "ambiguous"],
                )

    return named.select("id", "text").mapInArrow(run, "doc_id long, language string, loss double, gap double, ambiguous boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
