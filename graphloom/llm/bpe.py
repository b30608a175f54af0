"""BPE encoding and decoding by speculation: greedy longest matches are proposed, every adjacent pair is tested, and only failing words are merged exactly."""

from __future__ import annotations

import base64
import hashlib
import heapq
import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import kernels as K
from graphloom.llm.common import pick, table

#: Splits a text into the words that are encoded one by one; the published pattern of the byte-level vocabularies.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words a worker remembers; the memory is emptied when it is full and affects speed alone.
REMEMBERED = 1 << 19
#: Words of so many bytes at most are merged in a list, longer ones with a heap.
SHORT = 48


def default_vocabulary() -> str:
    """The installed 50k byte-level vocabulary, as a file of base64 tokens and ranks."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / "byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class Vocabulary:
    """tokens by rank; the two tokens each was merged from; and the ranks of those pairs, sorted by pair."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray


def exact_merge(word: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """The parts of word after merging, again and again, the leftmost adjacent pair of lowest rank (under `below`)."""
    n = len(word)
    if n < 2:
        return [word] if n else []
    if n <= SHORT:
        cuts, never = list(range(n + 1)), 1 << 62
        rank = [r if (r := ranks.get(word[i : i + 2], never)) < below else never for i in range(n - 1)]
        while rank and (low := min(rank)) < never:
            i = rank.index(low)
            del cuts[i + 1], rank[i]
            for k in (i - 1, i):
                if 0 <= k < len(rank):
                    r = ranks.get(word[cuts[k] : cuts[k + 2]], never)
                    rank[k] = r if r < below else never
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None and r < below]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or end[i] >= n:
            continue
        j = end[i]
        if end[j] - i != size:
            continue
        alive[j], end[i] = False, end[j]
        if end[i] < n:
            before[end[i]] = i
            r = ranks.get(word[i : end[end[i]]])
            if r is not None and r < below:
                heapq.heappush(heap, (r, i, end[end[i]] - i))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p : end[i]])
            if r is not None and r < below:
                heapq.heappush(heap, (r, p, end[i] - p))
    return [word[i : end[i]] for i in range(n) if alive[i]]


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of "base64-token rank" lines whose ranks are 0 to n - 1 and whose single bytes are all tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    left, right = np.arange(len(tokens), dtype=np.int64), np.arange(len(tokens), dtype=np.int64)
    for rank, token in enumerate(tokens):
        if len(token) > 1:
            parts = exact_merge(token, ranks, rank)
            if len(parts) == 2:
                left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    merged = np.flatnonzero(left != np.arange(len(tokens)))
    keys = (left[merged] << 32) | right[merged]
    order = np.argsort(keys, kind="stable")
    return Vocabulary(tokens, left, right, keys[order], merged[order])


def compatible(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether BPE, given the bytes of first + second, ends with just these two tokens; for all pairs at once.

    Both tokens are taken apart along the border, the later merge first; the pair fails as soon
    as the two pieces that touch there would have merged earlier than the piece was built.
    """
    t1, t2 = first.astype(np.int64).copy(), second.astype(np.int64).copy()
    limit = np.full(len(t1), 1 << 40, dtype=np.int64)
    good = np.zeros(len(t1), dtype=bool)
    live = np.arange(len(t1))
    while len(live):
        a, b = t1[live], t2[live]
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        merge = np.where(v.pair_keys[at] == key, v.pair_ranks[at], 1 << 41)
        stay = merge >= limit[live]
        live, a, b = live[stay], a[stay], b[stay]
        base_a, base_b = v.right[a] == a, v.left[b] == b
        take_a = np.where(a > b, ~base_a, base_b & ~base_a)
        take_b = ~take_a & ~base_b
        done = ~take_a & ~take_b
        good[live[done]] = True
        limit[live] = np.where(take_a, a, b + 1)
        t1[live] = np.where(take_a, v.right[a], a)
        t2[live] = np.where(take_b, v.left[b], b)
        live = live[~done]
    return good


class Encoder:
    """Encodes texts with a vocabulary; made once in each worker."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.ranks = {t: k for k, t in enumerate(v.tokens)}
        self.longest = max(map(len, v.tokens))
        self.words = regex.compile(WORD_PATTERN)
        self.known: dict[str, bytes] = {}
        self.exact = 0
        self.proposed = 0
        lengths = np.array([len(t) for t in v.tokens], dtype=np.int64)
        self.token_bytes = np.frombuffer(b"".join(v.tokens), dtype=np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum(lengths)))

    def _greedy(self, word: bytes) -> list[int]:
        ranks, n, at, out = self.ranks, len(word), 0, []
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                rank = ranks.get(word[at:end])
                if rank is not None:
                    out.append(rank)
                    at = end
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self._greedy(w) for w in raw]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        flat = np.array([x for t in tokens for x in t], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails = np.zeros(len(words), dtype=bool)
        if len(inner):
            fails[owner[inner[~compatible(self.v, flat[inner], flat[inner + 1])]]] = True
        self.proposed += len(words)
        self.exact += int(fails.sum())
        for k in np.flatnonzero(fails).tolist():
            tokens[k] = [self.ranks[p] for p in exact_merge(raw[k], self.ranks)]
        for w, t in zip(words, tokens):
            self.known[w] = np.array(t, dtype=np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, token ids) of the texts; a null counts as empty."""
        split = [self.words.findall(t) if t else [] for t in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = {w for words in split for w in words}
            self.learn(sorted(fresh))
        known = self.known
        parts = [b"".join([known[w] for w in words]) for words in split]
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
        return offsets, np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte offsets, bytes) of the token lists."""
        starts = self.token_at[ids]
        sizes = self.token_at[ids + 1] - starts
        ends = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
        return ends[offsets], self.token_bytes[source]


#: The encoder of the vocabulary last used, so that a worker's tasks share the words it has learnt.
_LAST: dict[str, Encoder] = {}


def _encoder(name: str, v: Vocabulary) -> Encoder:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Encoder(v)
    return _LAST[name]


def bpe_encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document: (doc_id, tokens, n_tokens, round_trip).

    round_trip says whether decoding the ids gave the text's bytes again; it is computed for
    every row. The vocabulary's file is read on the driver and broadcast (its size is fixed).

    Defined cases: a null text has null tokens, count and round_trip; an empty text has no
    tokens; words of any length are encoded whole; rows of a null or repeated id are encoded as
    they stand; other columns are ignored; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    path = vocabulary or default_vocabulary()
    loaded = load_vocabulary(path)
    name = f"{path} {len(loaded.tokens)} {hashlib.sha256(b'|'.join(loaded.tokens)).hexdigest()}"
    shared = docs.sparkSession.sparkContext.broadcast(loaded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                part = texts[lo:hi]
                offsets, tokens = encoder.encode(part.to_pylist())
                at, data = encoder.decode(offsets, tokens)
                want_at, want = K.text_buffers(part)
                same = np.ones(hi - lo, dtype=bool)
                if not (np.array_equal(at, want_at) and np.array_equal(data, want)):
                    same = np.array([np.array_equal(data[a:b], want[c:d]) for a, b, c, d in zip(at[:-1], at[1:], want_at[:-1], want_at[1:])])
                none = np.asarray(part.is_null())
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=pa.array(none)), pa.array(np.diff(offsets), mask=none), pa.array(same, mask=none)],
                    names=["doc_id", "tokens", "n_tokens", "round_trip"],
                )

    return docs.mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def bpe_decode(rows: DataFrame, id_column: str = "doc_id", tokens_column: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """Texts of token lists: (doc_id, text).

    Defined cases: null tokens give a null text, no tokens an empty one; an id outside the
    vocabulary, or a null one, makes the text null; bytes that are no UTF-8 become U+FFFD.
    """
    rows = pick(rows, id=id_column, tokens=tokens_column)
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                if ids is None or any(i is None or not 0 <= i < len(tokens) for i in ids):
                    out.append(None)
                else:
                    out.append(b"".join([tokens[i] for i in ids]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))
