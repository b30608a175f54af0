"""Scalar functions over paths, texts and vectors, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.schema import EDGE_LABELS, LAYERS


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def rooted(path: Column) -> Column:
    """path with one leading slash, so that a layer at its very top also has slashes on either side."""
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/+", ""))


def in_layer(path: Column, layer: str | None) -> Column:
    """Whether the path lies in the layer; an unknown or missing layer holds every path."""
    segment = LAYERS.get(layer or "")
    return F.lit(True) if segment is None else F.contains(rooted(path), F.lit(segment))


def is_test_file(path: Column) -> Column:
    return F.lower(rooted(path)).rlike(r"\.(test|spec)\.tsx?|/e2e/|/__tests__/")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4.0)


def edge_label(edge_type: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in EDGE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, edge_type), F.lit(""))


def hop_label(hop: Column) -> Column:
    return F.when(hop == 1, "direct").when(hop == 2, "indirect").otherwise(F.concat(hop.cast("string"), F.lit("-hop")))


def truncate_dims(vec: Column, dims: int = 768) -> Column:
    """The first dims components; not rescaled."""
    return F.slice(vec, 1, dims)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision: 0 where a norm is 0, null where lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, zero, lambda s, v: s + v * v)) * F.sqrt(F.aggregate(y, zero, lambda s, v: s + v * v))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot / norm))


def subsequence_pattern(query: str) -> str:
    """A pattern that matches names holding the query's letters in order."""
    special = set(r"\.[]{}()*+-?^$|")
    return ".*".join("\\" + c if c in special else c for c in query.lower())


def raw_score(query: Column, name: Column) -> Column:
    """1 less the edit distance as a share of the longer string."""
    return 1 - F.levenshtein(query, name) / F.greatest(F.length(query), F.length(name))


def length_penalty(query: Column, name: Column) -> Column:
    """min(1, ratio / 0.4) for the ratio of the lengths."""
    ratio = F.length(query) / F.length(name)
    return F.when(ratio < 0.4, ratio / 0.4).otherwise(1.0)
