"""Toxic spans by a linear-chain conditional random field over words.

Labels are known for whole documents only, so words are labelled first: a word of a toxic document is
toxic if it, or one of its beginnings, is found in toxic documents after many different words and in
clean ones hardly ever; copies of one text thus lend little weight. The field has two states; a word's
evidence is the sum of weights of its hashed features, neighbouring states are tied by transition
weights, and both are fitted by the gradient of the conditional likelihood, which forward-backward
gives. In a text the same recursion gives every word's marginal probability of being toxic. A
document's score is a logistic function of the highest marginal and of their sum; words of at least
one half are reported with their character offsets.

The fit takes at most ``SAMPLE`` labelled rows of each class, of at most ``SAMPLE_CHARS`` characters,
and of their words at most ``MOST_WINDOWS`` windows of ``WINDOW``, those with toxic words first;
scoring takes every text whole. Null texts count as empty; an empty text gets the score of a text
without evidence. Ties and repeated rows: every row is scored by its text alone. Without toxic or
without clean examples nothing can be learnt, and all scores are 0. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import in_fold

FOLDS = 5
SAMPLE = 2000
SAMPLE_CHARS = 20_000
FEATURES = 1 << 18
_MARKS = 1 << 22
WINDOW = 64
MOST_WINDOWS = 16_000
ROUNDS = 80
# Words whose evidence a worker keeps; beyond it the worker starts anew.
KNOWN_WORDS = 300_000
RATIO = 10.0
_SLICE = 4 << 20
_NO_WORD = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    """The word without punctuation around it, and its beginnings."""
    bare = _NO_WORD.sub("", word.lower())
    return [f"={bare}", *(f"{n}{bare[:n]}" for n in range(3, 7) if len(bare) >= n)]


def codes(word: str) -> list[int]:
    """Hashes of the word's features."""
    return [zlib.crc32(f.encode()) for f in features(word)]


@dataclass
class Field:
    """Weights: of features, of transitions 0 to 1, 1 to 0, 1 to 1, of the document's score."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    logistic: np.ndarray


def _toxic_words(
    coded: list[np.ndarray], toxic: list[bool], owner: np.ndarray, code: np.ndarray, size: int
) -> np.ndarray:
    """Which of ``size`` words are toxic: some feature of theirs has support from toxic documents
    and next to none from clean ones. Each pair of a word and its predecessor counts once."""
    pairs: list[list[np.ndarray]] = [[], []]
    for words, label in zip(coded, toxic):
        before = np.concatenate([[-1], words[:-1]]) if len(words) else words
        pairs[label].append((before + 1) * size + words)
    seen, totals = [], []
    marks, at = np.unique(code % _MARKS, return_inverse=True)
    for part in pairs:
        distinct = np.unique(np.concatenate(part))
        by_word = np.bincount(distinct % size, minlength=size)
        seen.append(np.bincount(at, by_word[owner], minlength=len(marks)))
        totals.append(sum(map(len, part)) + 1)
    clean, bad = seen
    marked = bad >= max(3, sum(toxic) // 200)
    marked &= bad / totals[1] >= RATIO * (clean + 1) / totals[0]
    return np.bincount(owner, marked[at], minlength=size) > 0


def _forward_backward(odds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 from the words up to each, and from those after it; time runs down."""
    to, back, stay = np.exp(moves)
    ahead, behind = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0] * to
    for t in range(1, len(odds)):
        ahead[t] = odds[t] * (to + stay * ahead[t - 1]) / (1 + back * ahead[t - 1])
    for t in range(len(odds) - 2, -1, -1):
        x = odds[t + 1] * behind[t + 1]
        behind[t] = (back + stay * x) / (1 + to * x)
    return ahead, behind


def fit(texts: list[str], toxic: list[bool], prior: float) -> Field | None:
    """The field for sample texts with labels; ``prior`` is the share of toxic documents at large."""
    if not any(toxic) or all(toxic):
        return None
    ids: dict[str, int] = {}
    coded = [np.array([ids.setdefault(w, len(ids)) for w in t.split()], np.int64) for t in texts]
    names = list(ids)
    ids.clear()
    sizes, hashed = array("I"), array("Q")
    for w in names:
        found = codes(w)
        sizes.append(len(found))
        hashed.extend(found)
    owner = np.repeat(np.arange(len(names)), np.frombuffer(sizes, np.uint32))
    code = np.frombuffer(hashed, np.uint64).astype(np.int64)
    if not len(code):
        return None
    bad_word = _toxic_words(coded, toxic, owner, code, len(names))
    flat = code % FEATURES

    rows, labels = [], []
    for words, label in zip(coded, toxic):
        for at in range(0, len(words), WINDOW):
            part = words[at : at + WINDOW]
            row = np.full(WINDOW, -1, np.int64)
            row[: len(part)] = part
            rows.append(row)
            labels.append((row >= 0) & label & bad_word[row])
    grid, truth = np.array(rows), np.array(labels)
    order = np.lexsort((np.arange(len(grid)) * 2654435761 % 1000003, ~truth.any(1)))
    keep = order[: MOST_WINDOWS]
    grid, truth = grid[keep].T, truth[keep].T
    there = grid >= 0
    y = truth.astype(float)

    weights, bias, moves = np.zeros(FEATURES), -4.0, np.array([0.0, 0.0, 0.0])
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, np.zeros(1), moves)]
    pairs = np.array(
        [((1 - y[:-1]) * y[1:]).sum(), (y[:-1] * (1 - y[1:])).sum(), (y[:-1] * y[1:]).sum()]
    )
    scale = 1 / max(1.0, y.sum())
    for step in range(1, ROUNDS + 1):
        evidence = bias + np.bincount(owner, weights[flat], minlength=len(names))
        odds = np.where(there, np.exp(np.clip(evidence[grid], -20, 20)), np.exp(-20.0))
        ahead, behind = _forward_backward(odds, moves)
        p = ahead * behind / (1 + ahead * behind)
        # Probabilities of neighbouring states, from the odds on either side.
        x = odds[1:] * behind[1:]
        to, back, stay = np.exp(moves)
        cells = np.stack([to * x, back * ahead[:-1], stay * ahead[:-1] * x])
        expected = (cells / (1 + cells.sum(0))).sum((1, 2))
        error = np.where(there, y - p, 0.0)
        by_word = np.bincount(grid[there], error[there], minlength=len(names))
        slopes = (
            np.bincount(flat, by_word[owner], minlength=FEATURES) * scale - 1e-4 * weights,
            np.array([error.sum()]) * scale,
            (pairs - expected) * scale - 1e-3 * moves,
        )
        moved = []
        for slope, (first, second) in zip(slopes, state):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            moved.append(
                0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            )
        weights, bias, moves = weights + moved[0], bias + moved[1][0], moves + moved[2]
    field = Field(weights.astype(np.float32), float(bias), moves, np.zeros(3))
    reader, raw = Reader(field), [t.encode() for t in texts]
    parts = [reader.marginals(raw[at : at + 500]) for at in range(0, len(raw), 500)]
    seen = np.array([summary(p) for part in parts for p in part])
    field.logistic = _logistic(seen, np.array(toxic, float), prior)
    return field


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's score is a function of: highest marginal, sum of marginals."""
    if not len(p):
        p = np.zeros(1)
    top = min(float(p.max()), 1 - 1e-6)
    return 1.0, max(-8.0, float(np.log((top + 1e-9) / (1 - top)))), float(np.log(1e-3 + p.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression by Newton's method, classes weighted to their shares at large."""
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(bend, slope)
    return beta


class Reader:
    """Marginals of texts; evidence of words met before is looked up."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[bytes, float] = {}

    def _evidence(self, words: list[bytes]) -> list[float]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in set(words).difference(known):
                at = [c % FEATURES for c in codes(w.decode("utf-8", "replace"))]
                known[w] = self.field.bias + float(self.field.weights[at].sum())
            return [known[w] for w in words]

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """Probability of the toxic state at each word of each text, all texts side by side."""
        rows = [np.array(self._evidence(t.split()), np.float64) for t in texts]
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order], np.int64)
        if not len(lengths) or not lengths[0]:
            return rows
        odds = np.exp(np.clip(np.concatenate([rows[i] for i in order]), -20, 20))
        starts = np.cumsum(lengths) - lengths
        # Texts that are at least t + 1 words long come first, so each step takes a beginning.
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        to, back, stay = np.exp(self.field.moves)
        ahead, behind = np.empty_like(odds), np.ones_like(odds)
        at = starts[: active[0]]
        last = ahead[at] = odds[at] * to
        for t in range(1, lengths[0]):
            at = starts[: active[t]] + t
            last = last[: active[t]]
            last = ahead[at] = odds[at] * (to + stay * last) / (1 + back * last)
        after = np.zeros(0)
        for t in range(lengths[0] - 1, -1, -1):
            at = starts[: active[t]] + t
            mine = np.ones(len(at))
            if t + 1 < lengths[0]:
                x = odds[starts[: active[t + 1]] + t + 1] * after
                mine[: active[t + 1]] = (back + stay * x) / (1 + to * x)
            after = behind[at] = mine
        p = ahead * behind / (1 + ahead * behind)
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        for i, a, n in zip(order, starts, lengths):
            out[i] = p[a : a + n]
        return out

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.field.logistic, summary(p)), -30, 30))))


def spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Character ranges of the words that are toxic rather than not."""
    found = []
    if len(p) and p.max() >= 0.5:
        at = chars = 0
        for match, chance in zip(re.finditer(rb"[^\x20\x09-\x0D]+", text), p):
            if chance >= 0.5:
                chars += len(text[at : match.start()].decode("utf-8", "replace"))
                at = match.start()
                length = len(match[0].decode("utf-8", "replace"))
                found.append({"start": chars, "end": chars + length, "p": float(chance)})
    return found


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    folds: int = FOLDS, sample: int = SAMPLE,
) -> Field | None:
    """A field from labelled documents outside the held-out fold, drawn by a hash of their ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds))
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, clean = sizes.get(1, 0), sizes.get(0, 0)
    drawn = [
        usable.where(F.col("toxic") == k).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for k in (0, 1)
    ]
    ids = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("__id"), "toxic")
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    rows = (
        texts.where(F.length("__text") <= SAMPLE_CHARS)
        .join(F.broadcast(ids), F.col("__key") == F.col("__id"))
        .dropDuplicates(["__key"])
        .select("__key", "__text", "toxic")
        .toArrow()
        .sort_by("__key")
    )
    texts, toxic = rows.column("__text").to_pylist(), rows.column("toxic").to_pylist()
    del rows
    field = fit(texts, [bool(t) for t in toxic], bad / max(1, bad + clean))
    del texts
    _give_back()
    return field


def _give_back() -> None:
    """Return the memory of the fit to the system before the next stage starts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_RESULT = "struct<score: double, spans: array<struct<start: int, end: int, p: double>>>"


def scored(docs: DataFrame, field: Field | None, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``to``: score and spans of each text; the other columns stay in Spark."""
    kind = pa.struct(
        [
            ("score", pa.float64()),
            (
                "spans",
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])),
            ),
        ]
    )

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        reader = Reader(field) if field else None
        out = []
        held, size = [], 0
        whole = texts.to_pylist()
        for i, text in enumerate(whole):
            held.append(text)
            size += len(text)
            if size >= _SLICE or i + 1 == len(whole):
                if reader is None:
                    out += [{"score": 0.0, "spans": []} for _ in held]
                else:
                    for t, p in zip(held, reader.marginals(held)):
                        out.append({"score": reader.score(p), "spans": spans(t, p)})
                held, size = [], 0
        return pa.array(out, kind)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.withColumn(to, judge(text))


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    field = learn(docs, labels, id_col, text_col)
    return scored(docs, field, text_col, "__toxicity").where("__toxicity.score < 0.5").drop("__toxicity")
