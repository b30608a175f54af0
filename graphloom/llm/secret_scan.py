"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import kernels as K
from graphloom.llm.common import pick, table
from graphloom.llm.labelled import labelled_sample

#: Labelled documents whose strings the models are trained on, at most.
TRAINING_ROWS = 3000
#: Bytes a candidate string has at least; shorter ones hold too few characters to tell chance from language.
MIN_LENGTH = 16
#: Letters of a word that names and paths are made of, at most.
MAX_PART = 32

_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/="
#: 0 is the border of a string, 1 to 67 the alphabet, 68 any non-ASCII byte.
_CODE = np.full(256, -1, dtype=np.int16)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
_CODE[128:] = len(_ALPHABET) + 1
_SYMBOLS = len(_ALPHABET) + 2
_ASSIGNED = re.compile(r"""(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?\b["']?\s*(?:[:=]|=>)\s*["']?([A-Za-z0-9_\-+/=]{16,})""")


_LONG = re.compile(r"[A-Za-z0-9_\-+/=]{16,}")
#: Share of the evidence that labelled strings have at least, and the characters from which on made ones shrink to the rest.
LABELLED_SHARE, LEAST_LABELLED = 0.5, 20_000


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b, c]: how much likelier c is after a, b in a random string than in an identifier, as a logarithm.

    A run is a secret over limit; a stretch of a longer run is one where its sum of ratios less the limit is over gain."""

    ratio: np.ndarray
    limit: float
    gain: float = np.inf


def candidate_spans(offsets: np.ndarray, data: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs of the alphabet's bytes that have min_length bytes or more and a letter."""
    code = _CODE[data]
    starts, ends = K.runs(code > 0, offsets)
    letters = np.concatenate(([0], np.cumsum((code > 10) & (code <= 62))))
    long = (ends - starts >= min_length) & (letters[ends] > letters[starts])
    starts, ends = starts[long], ends[long]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def _coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings, each led by two borders, and where each begins."""
    lengths = np.array([len(s) + 2 for s in strings], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    codes = np.zeros(at[-1], dtype=np.int64)
    for s, start in zip(strings, at[:-1].tolist()):
        codes[start + 2 : start + 2 + len(s)] = np.maximum(_CODE[np.frombuffer(s, dtype=np.uint8)], 0)
    return codes, at


def _ratios(model: MarkovPair, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each character, each string led by two zeros, and where each begins."""
    codes, at = _coded(strings)
    each = np.zeros(len(codes))
    each[2:] = model.ratio[codes[:-2], codes[1:-1], codes[2:]]
    border = np.concatenate((at[:-1], at[:-1] + 1))
    each[border] = 0
    return each, at


def _scores(model: MarkovPair, strings: list[bytes]) -> np.ndarray:
    """Log-likelihood ratio a character."""
    if not strings:
        return np.zeros(0)
    each, at = _ratios(model, strings)
    return np.add.reduceat(each, at[:-1]) / (np.diff(at) - 2)


def _gains(model: MarkovPair, strings: list[bytes], min_length: int) -> np.ndarray:
    """The largest sum of ratios less the limit over a stretch of min_length or more bytes of each string; -inf of a shorter one."""
    if not strings:
        return np.zeros(0)
    each, at = _ratios(model, strings)
    each -= model.limit
    head = at[:-1]
    each[head] = each[head + 1] = 0
    sums = np.cumsum(each)
    owner = np.repeat(np.arange(len(strings)), np.diff(at))
    sums -= sums[head][owner]
    # lowered from string to string by more than sums vary: a running minimum that starts anew in each
    step = 2 * np.abs(sums).max() + 1
    lowest = np.minimum.accumulate(sums - owner * step) + owner * step
    out = np.full(len(strings), -np.inf)
    # the sum up to the byte before a stretch stands min_length places or more before that of its last
    end = np.flatnonzero(np.arange(len(sums)) - head[owner] >= min_length + 1)
    np.maximum.at(out, owner[end], sums[end] - lowest[end - min_length])
    return out


def _stretches(ratio: np.ndarray, letter: np.ndarray, model: MarkovPair, min_length: int) -> list[tuple[int, int]]:
    """Disjoint stretches of one string over model.gain that hold a letter, the best first taken, in order."""
    out, open_ = [], [(0, len(ratio))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < min_length:
            continue
        sums = np.concatenate(([0.0], np.cumsum(ratio[lo:hi] - model.limit)))
        low = np.minimum.accumulate(sums)[: len(sums) - min_length]
        gain = sums[min_length:] - low
        k = int(np.argmax(gain))
        if gain[k] <= model.gain:
            continue
        end = lo + k + min_length
        start = lo + int(np.argmin(sums[: k + 1]))
        if letter[start:end].any():
            out.append((start, end))
        open_ += [(lo, start), (end, hi)]
    return sorted(out)


def _counts(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((_SYMBOLS, _SYMBOLS, _SYMBOLS))
    if strings:
        codes, at = _coded(strings)
        use = np.ones(len(codes), dtype=bool)
        use[np.concatenate((at[:-1], at[:-1] + 1))] = False
        at3 = np.flatnonzero(use)
        np.add.at(out, (codes[at3 - 2], codes[at3 - 1], codes[at3]), 1)
    return out


def _mixed(labelled: list[bytes], made: list[bytes]) -> np.ndarray:
    """Counts of both, in which the labelled strings weigh at least LABELLED_SHARE (where there are any)."""
    a, b = _counts(labelled), _counts(made)
    if a.sum() and b.sum():
        b = b * min(1.0, a.sum() * (1 - LABELLED_SHARE) / LABELLED_SHARE / b.sum()) if a.sum() >= LEAST_LABELLED else b
        a = a * max(1.0, b.sum() * LABELLED_SHARE / (1 - LABELLED_SHARE) / a.sum())
    return a + b


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """P(c | a, b), backed off to P(c | b) and P(c)."""
    one = counts.sum(axis=(0, 1)) + 0.05
    one = one / one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    return (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)


def random_strings(n: int, seed: int = 5) -> list[bytes]:
    """Samples of the random class: hexadecimal of either case, letters with digits, base64 and its URL form."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[:62] + "_-", _ALPHABET[:36]]
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), size=int(rng.integers(16, 65)))).encode() for k in range(n)]


def ordinary_identifiers(words: list[str], n: int, seed: int = 6) -> list[bytes]:
    """Samples of the ordinary class: words, and names made of them (snake, kebab, camel and upper case, paths, numbered)."""
    rng = np.random.default_rng(seed)
    out = [w.encode() for w in words]
    if words:
        for k in range(n):
            part = [words[i] for i in rng.integers(0, len(words), size=int(rng.integers(2, 5)))]
            name = ["_".join(part), "-".join(part), part[0] + "".join(p.capitalize() for p in part[1:]), "_".join(part).upper(), "/".join(part), "".join(p.capitalize() for p in part), "_".join(part) + str(int(rng.integers(0, 1000)))][k % 7]
            out.append(name.encode())
    out += ["".join(rng.choice(list("0123456789"), size=int(rng.integers(8, 21)))).encode() for _ in range(max(20, n // 50))]
    return out


def labelled_strings(texts: list[str], good: list[bool] | None = None) -> tuple[list[str], list[str], list[str]]:
    """(secrets, words, long names) of labelled texts: values assigned to a secret's name; words of the good texts, and their
    candidate strings that nothing marks as secret."""
    secret, words, names = set(), set(), set()
    for text in texts:
        secret |= set(_ASSIGNED.findall(text))
    for text in texts if good is None or not any(good) else [t for t, g in zip(texts, good) if g]:
        found = set(_ASSIGNED.findall(text))
        words |= {w for w in re.findall(r"[^\W\d_]{3,}", text) if not any(w in s for s in found)}
        names |= {x for x in _LONG.findall(text) if not any(x in s or s in x for s in found)}
    return sorted(secret), sorted(words), sorted(names - secret)


def train_markov(texts: list[str], good: list[bool] | None = None) -> MarkovPair:
    """Both models from labelled texts: see labelled_strings. Made samples join them, for secrets and names of forms that no
    labelled text happens to hold; with enough labelled strings they weigh no more than those. The limit is that of the best
    balanced accuracy on a held-out fifth of both classes, where a false alarm weighs ten misses."""
    secret, words, names = ([x.encode() for x in part] for part in labelled_strings(texts, good))
    plain = [w.decode() for w in words]
    made_p, made_n = random_strings(4000), ordinary_identifiers(plain, 20_000)[len(plain) :]
    train = lambda part: [x for k, x in enumerate(part) if k % 5 != 4]
    held = lambda *parts: [x for part in parts for x in part[4::5]]
    ratio = np.log(_smoothed(_mixed(train(secret), train(made_p)))) - np.log(_smoothed(_mixed(train(words) + train(names), train(made_n))))
    model = MarkovPair(ratio.astype(np.float32), 0.0)
    test_p, test_n = held(secret, made_p), [x for x in held(words, names, made_n) if len(x) >= MIN_LENGTH]
    p, q = _scores(model, test_p), _scores(model, test_n)
    if not len(q):
        return model
    # a false alarm weighs ten misses: ordinary strings are the common case
    model = MarkovPair(model.ratio, _best_limit(p, q, 10))
    short = [w for w in plain if len(w) <= MAX_PART]
    if not short:
        return model
    # a stretch is chosen among many, so it has a limit of its own, from names and paths with and without a secret
    paths = joined_words(short, 5000)
    joined = [path + b"=/-_"[k % 4 :][:1] + s for k, (path, s) in enumerate(zip(paths[::2], random_strings(len(paths) // 2, seed=8)))]
    return MarkovPair(model.ratio, model.limit, max(0.0, _best_limit(_gains(model, joined, MIN_LENGTH), _gains(model, [x for x in paths[1::2] + test_n if MIN_LENGTH <= len(x) <= 12 * MAX_PART], MIN_LENGTH), 100)))


def joined_words(words: list[str], n: int, seed: int = 9) -> list[bytes]:
    """Long ordinary strings: two to twelve words as a path or a name."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        part = [words[i] for i in rng.integers(0, len(words), size=int(rng.integers(2, 13)))]
        out.append(["/".join(part), "_".join(part), "-".join(part), "_".join(part).upper(), part[0] + "".join(p.capitalize() for p in part[1:]), "/".join(part) + "=" + part[0]][k // 2 % 6].encode())
    return out


def _best_limit(p: np.ndarray, q: np.ndarray, alarm: float) -> float:
    """Between the scores p of secrets and q of others; a false alarm weighs so many misses."""
    edges = np.unique(np.concatenate((p, q)))
    middle = (edges[1:] + edges[:-1]) / 2
    p, q = np.sort(p), np.sort(q)
    cost = alarm * (1 - np.searchsorted(q, middle) / len(q)) + np.searchsorted(p, middle) / len(p)
    best = np.flatnonzero(cost == cost.min())
    return float(middle[best[len(best) // 2]])


def secret_scan(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", training_rows: int = TRAINING_ROWS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Suspected secrets: (doc_id, start, length, score, masked), a row for each.

    start and length are in characters of the text; score is the log-likelihood ratio a
    character; masked shows the first four characters and stars. Candidates are the maximal
    runs of letters, digits and _-+/= of min_length or more bytes with an ASCII letter in them;
    of a run that is none as a whole, the stretches of min_length or more bytes with the most
    evidence, so that a path or a name before a secret does not hide it.
    Models are trained on at most training_rows labelled documents (words and names on those whose
    label is not 0, secrets on all); all texts are scanned whole.

    Defined cases: ids are integers; a score equal to the limit is no secret; null and empty texts hold nothing; rows of a null or repeated id are scanned
    as they stand; a string found twice is reported twice; without labelled rows the models rest
    on made samples alone; other columns are ignored; an empty table gives no rows.
    """
    docs = pick(docs, id=id_column, text=text_column)
    sample = labelled_sample(docs, pick(labels, id=id_column, label_=label_column), training_rows, "label_")
    model = train_markov(sample["text"].to_pylist(), [bool(x) for x in sample["label"].to_pylist()])
    schema = "doc_id long, start int, length int, score double, masked string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in K.slices(texts):
                offsets, data = K.text_buffers(texts[lo:hi])
                doc, starts, ends = candidate_spans(offsets, data, min_length)
                if not len(doc):
                    continue
                strings = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
                score = _scores(model, strings)
                whole = score > model.limit
                rest = np.flatnonzero(~whole)
                rest = rest[_gains(model, [strings[k] for k in rest.tolist()], min_length) > model.gain]
                parts = [(doc[whole], starts[whole], ends[whole], score[whole])]
                for k in rest.tolist():
                    ratio = _ratios(model, [strings[k]])[0][2:]
                    code = _CODE[data[starts[k] : ends[k]]]
                    for a, b in _stretches(ratio, (code > 10) & (code <= 62), model, min_length):
                        parts.append(([doc[k]], [starts[k] + a], [starts[k] + b], [ratio[a:b].mean()]))
                doc, starts, ends, score = (np.concatenate([x[j] for x in parts]) for j in range(4))
                hit = np.argsort(starts, kind="stable")
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                begin = chars[starts[hit]] - chars[offsets[doc[hit]]]
                size = chars[ends[hit]] - chars[starts[hit]]
                shown = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")[:4] + "*" * int(n - 4) for k, n in zip(hit.tolist(), size)]
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi].take(pa.array(doc[hit])), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(score[hit]), pa.array(shown, pa.string())],
                    names=["doc_id", "start", "length", "score", "masked"],
                )

    return docs.mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
