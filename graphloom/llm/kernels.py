"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow string array at a time and never creates a
Python string per document: offsets and bytes are taken from the Arrow buffers
and all further work is numpy over the concatenated bytes. Nulls count as empty
texts; callers that must tell the two apart keep the validity mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes of text per slice; eight-byte temporaries of a slice stay near the cache.
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(seed: int, n: int = 256) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = (_table(11), _table(1213))
_BASE = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)
_INV = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = []
        for base in (_BASE[which], _INV[which]):
            p = np.full(size, _U(base), dtype=_U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 16 * SLICE_BYTES:
            return out[0], out[1]
        have = _POWERS[which] = (out[0], out[1])
    return have


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), dtype=_U)
    power, inverse = _powers(which, n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[which][data] * power[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 documents, bytes), offsets starting at 0; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) row ranges of about max_bytes each; one long text is a range of its own."""
    if len(texts) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    block = np.cumsum(sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    yield from zip(edges, edges[1:])


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document's border."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, stops = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    stops[:-1] &= ~member[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = member[inner]
    stops[inner - 1] = member[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each word, start, end): words are runs of letters, digits, '_' and non-ASCII bytes."""
    starts, ends = runs(_WORD[data], offsets)
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, 64-bit hash) over the lower-cased texts, in text order."""
    offsets, data = text_buffers(pc.utf8_lower(texts))
    doc, starts, ends = word_spans(offsets, data)
    return doc, segment_hash(data, starts, ends)


_GRAM = _table(77, 64) | _U(1)


def word_ngrams(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word n-gram; a text of 1 to n - 1 words has one gram, of all its words."""
    m = len(words)
    if m == 0:
        return doc, words
    counts = np.bincount(doc)
    present = np.flatnonzero(counts)
    first = np.concatenate(([0], np.cumsum(counts[present])[:-1]))
    out = np.zeros(m, dtype=_U)
    for k in range(n):
        out[: m - k] += words[k:] * _GRAM[k]
    valid = np.zeros(m, dtype=bool)
    if m >= n:
        valid[: m - n + 1] = doc[: m - n + 1] == doc[n - 1 :]
    for at in first[counts[present] < n]:
        length = int(counts[doc[at]])
        out[at] = np.sum(words[at : at + length] * _GRAM[:length], dtype=_U) + _U(length)
        valid[at] = True
    return doc[valid], mix64(out[valid])


def unique_per_doc(doc: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, gram), sorted by both."""
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[keep], grams[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
