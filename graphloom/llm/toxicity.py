"""Toxicity: cumulative-link ordinal regression on sparse word and word-prefix features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import kernels as K
from graphloom.llm.common import pick, table
from graphloom.llm.labelled import best_limit, labelled_sample

#: Labelled documents the model is fitted on, at most.
TRAINING_ROWS = 6000
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is in so many toxic texts at least, and so many times as often there as in others.
LEAST_TEXTS, LEAST_ODDS = 3, 20
#: Grades that binary labels are refined to.
GRADES = 4


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = logistic(cuts[k] - w.x): one weight vector for all thresholds."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    reject_at: float


def document_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit feature) of every word and every longer word's prefixes, lower-cased; repeats included."""
    offsets, data = K.text_buffers(pc.utf8_lower(texts))
    doc, starts, ends = K.word_spans(offsets, data)
    docs, found = [doc], [K.segment_hash(data, starts, ends)]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        docs.append(doc[longer])
        found.append(K.segment_hash(data, starts[longer], starts[longer] + k) ^ np.uint64(k))
    return np.concatenate(docs), np.concatenate(found)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _margins(n: int, doc: np.ndarray, feature: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=weights[feature], minlength=n)


def fit_ordinal(n: int, doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, features: int, grades: int, l2: float = 0.02, steps: int = 400, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of the proportional-odds model, by Adam on the penalised likelihood.

    (doc, feature) are the ones of a 0/1 matrix of n rows; weight is how many rows each stands
    for. Grades are weighted by the root of their rarity besides.
    """
    weight = np.ones(n) if weight is None else weight
    counts = np.maximum(np.bincount(grade, weights=weight, minlength=grades), 1e-9)
    weight = weight * np.sqrt(weight.sum() / counts)[grade]
    weight = weight / weight.mean()
    w, first, gaps = np.zeros(features), 1.0, np.zeros(grades - 2)
    params = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    upper = np.arange(grades - 1)
    for step in range(1, steps + 1):
        w, first, gaps = params[:features], params[features], params[features + 1 :]
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        eta = _margins(n, doc, feature, w)
        below = np.column_stack((np.zeros(n), _sigmoid(cuts[None, :] - eta[:, None]), np.ones(n)))
        slope = np.column_stack((np.zeros(n), below[:, 1:-1] * (1 - below[:, 1:-1]), np.zeros(n)))
        row = np.arange(n)
        p = np.maximum(below[row, grade + 1] - below[row, grade], 1e-12)
        d_eta = weight * (slope[row, grade + 1] - slope[row, grade]) / p
        d_cut = np.zeros(grades - 1)
        for k in upper:
            at, over = grade == k, grade == k + 1
            d_cut[k] = -(weight[at] * slope[at, k + 1] / p[at]).sum() + (weight[over] * slope[over, k + 1] / p[over]).sum()
        g_w = np.bincount(feature, weights=d_eta[doc], minlength=features) / n + l2 * w / n * 50
        g_gaps = np.array([d_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(grades - 2)]) / n
        g = np.concatenate((g_w, [d_cut.sum() / n], g_gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, first, gaps = params[:features], params[features], params[features + 1 :]
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


@dataclass(frozen=True)
class _Texts:
    """Distinct features of each of n texts, sorted by text."""

    n: int
    doc: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> _Texts:
        docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi in K.slices(texts):
            doc, feature = K.unique_per_doc(*document_features(texts[lo:hi]))
            docs.append(doc + lo)
            found.append(feature)
        return _Texts(len(texts), np.concatenate(docs), np.concatenate(found))


def _telling(held: _Texts, toxic: np.ndarray, weight: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Sorted features that the toxic ones of the texts in use hold far more often than the others."""
    bad = use & toxic
    names, count = np.unique(held.feature[bad[held.doc]], return_counts=True)
    names = names[count >= LEAST_TEXTS]
    if not len(names):
        return names
    at, known = _look_up(names, held.feature)
    mine = known & use[held.doc]
    each = weight[held.doc[mine]]
    hit = toxic[held.doc[mine]]
    with_bad = np.bincount(at[mine][hit], weights=each[hit], minlength=len(names))
    with_rest = np.bincount(at[mine][~hit], weights=each[~hit], minlength=len(names))
    odds = (with_bad / weight[bad].sum()) / ((with_rest + 0.5) / max(weight[use & ~toxic].sum(), 1e-9))
    return names[odds >= LEAST_ODDS]


def _look_up(names: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature among sorted names, whether it is there)."""
    if not len(names):
        return np.zeros(len(features), dtype=np.int64), np.zeros(len(features), dtype=bool)
    at = np.minimum(np.searchsorted(names, features), len(names) - 1)
    return at, names[at] == features


def cross_graded(held: _Texts, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Grades from binary labels: 0, and for toxic texts 1 to 3 by thirds of the number of distinct toxic features they hold.

    Which features are is told by the other half of the labelled texts, so that no text's grade
    rests on what its own label made of its words.
    """
    half = np.arange(held.n) % 2 == 0
    number = np.zeros(held.n)
    for part in (half, ~half):
        known = _look_up(_telling(held, toxic, weight, ~part), held.feature)[1]
        number[part] = np.bincount(held.doc[known], minlength=held.n)[part]
    some = number[toxic & (number > 0)]
    limits = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else (1, 1)
    return np.where(toxic, 1 + (number > limits[0]) + (number > limits[1]), 0)


def _fitted(held: _Texts, names: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, cuts, expected severity of all texts) of a model fitted on the texts in use."""
    at, known = _look_up(names, held.feature)
    doc, feature = held.doc[known], at[known]
    rows = np.flatnonzero(use)
    place = np.full(held.n, -1)
    place[rows] = np.arange(len(rows))
    inside = use[doc]
    w, cuts = fit_ordinal(len(rows), place[doc[inside]], feature[inside], grade[rows], len(names), grades, weight=weight[rows])
    return w, cuts, expected_severity(_margins(held.n, doc, feature, w), cuts)


def fit_toxicity(texts: pa.Array, label: np.ndarray, weight: np.ndarray | None = None) -> OrdinalModel:
    """The model from labelled texts; weight is how many texts each stands for.

    Labels of more than two kinds are the grades themselves, the smallest of them harmless;
    binary ones are refined to GRADES grades by cross_graded. Features are all that texts over the
    smallest label hold far more often than others. The limit to reject at is the expected severity
    with the best F1, each half of the texts scored by a model of the other half. Without two kinds
    of labels the model has no features and rejects nothing.
    """
    n = len(texts)
    values, level = np.unique(np.asarray(label).astype(np.int64), return_inverse=True)
    empty = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([4.0, 5.0, 6.0]), 10.0)
    if len(values) < 2:
        return empty
    weight = np.ones(n) if weight is None else np.asarray(weight, dtype=np.float64) / np.mean(weight)
    toxic, every = level > 0, np.ones(n, dtype=bool)
    held = _Texts.of(texts)
    names = _telling(held, toxic, weight, every)
    if not len(names):
        return empty
    grade = level if len(values) > 2 else cross_graded(held, toxic, weight)
    grades = int(max(grade.max() + 1, 3))
    weights, cuts, severity = _fitted(held, names, grade, grades, weight, every)
    # scored by models that have not seen the text
    half = np.arange(n) % 2 == 0
    unseen = severity.copy()
    for part in (half, ~half):
        theirs = _telling(held, toxic, weight, ~part)
        if len(theirs) and (toxic & ~part).any() and (~toxic & ~part).any():
            unseen[part] = _fitted(held, theirs, grade, grades, weight, ~part)[2][part]
    return OrdinalModel(names, weights, cuts, best_limit(unseen, toxic, weight))


def expected_severity(eta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Expected grade: the sum over thresholds of the chance to lie above."""
    return _sigmoid(eta[:, None] - cuts[None, :]).sum(axis=1)


def _sparse_margin(model: OrdinalModel, texts: pa.Array) -> np.ndarray:
    doc, found = document_features(texts)
    filter_bits = np.zeros(1 << 16, dtype=bool)
    filter_bits[(model.features >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(filter_bits[(found >> np.uint64(48)).astype(np.int64)])
    doc, found = doc[maybe], found[maybe]
    at = np.minimum(np.searchsorted(model.features, found), max(len(model.features) - 1, 0))
    held = model.features[at] == found if len(model.features) else np.zeros(len(found), dtype=bool)
    doc, feature = K.unique_per_doc(doc[held], at[held].astype(np.uint64))
    return _margins(len(texts), doc, feature.astype(np.int64), model.weights) if len(doc) else np.zeros(len(texts))


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(id, severity, grade, toxic) for each row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                part = texts[lo:hi]
                eta = _sparse_margin(model, part)
                above = _sigmoid(eta[:, None] - model.cuts[None, :])
                severity = above.sum(axis=1)
                chance = -np.diff(np.column_stack((np.ones(len(eta)), above, np.zeros(len(eta)))), axis=1)
                none = np.asarray(part.is_null())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi],
                        pa.array(severity, mask=none),
                        pa.array(chance.argmax(axis=1).astype(np.int32), mask=none),
                        pa.array((severity >= model.reject_at) & ~none),
                    ],
                    names=["id", "severity", "grade", "toxic"],
                )

    return docs.mapInArrow(run, "id long, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Severity of every document: (doc_id, severity, grade, toxic).

    severity is the expected grade from 0 on (to 3 with binary labels), grade the likeliest one,
    toxic whether severity reaches the limit found on the labels. The model is fitted on at most
    training_rows labelled documents (a hash of the id chooses, a rare label has a fixed share);
    all documents are scored, over their whole texts.

    Defined cases: ids are integers; a null text has null severity and grade and is not toxic; an
    empty text has the severity of a text without any known feature; rows of a null or repeated
    id are scored as they stand; a severity equal to the limit is toxic, of equally likely grades
    the smallest is given; other columns are ignored; without two kinds of labels nothing is
    toxic; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    sample = labelled_sample(docs, pick(labels, id=id_column, toxic=label_column), training_rows, "toxic")
    model = fit_toxicity(K.as_array(sample["text"]), np.asarray(sample["label"]), np.asarray(sample["weight"]))
    return score_toxicity(docs, model).withColumnRenamed("id", "doc_id")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """docs, all columns, without the documents toxicity() calls toxic. Scored in place: no shuffle.

    Defined cases: as in toxicity; rows are judged one by one, so null and empty texts and null
    ids stay, repeated rows go together and of several texts of an id the toxic ones go; column
    names cannot clash.
    """
    base = pick(docs, id=id_column, text=text_column)
    sample = labelled_sample(base, pick(labels, id=id_column, toxic=label_column), training_rows, "toxic")
    model = fit_toxicity(K.as_array(sample["text"]), np.asarray(sample["label"]), np.asarray(sample["weight"]))

    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for lo, hi in K.slices(texts):
                toxic = expected_severity(_sparse_margin(model, texts[lo:hi]), model.cuts) >= model.reject_at
                yield batch.slice(lo, hi - lo).filter(pa.array(~toxic | np.asarray(texts[lo:hi].is_null())))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
