"""Quality of documents by a factorisation machine over words, structure and metadata.

A text's features are its hashed words, weighted by the logarithm of their number and scaled to
length one, the classes that its structure statistics fall into, and the classes of metadata columns.
Every feature has a weight and a short vector; the score is a logistic function of the weights and of
the products of all pairs of vectors, times both values. The pairs aren't formed: for each dimension
their sum is half the difference of the square of the sum and the sum of the squares, so a score is
linear in the number of features.

The fit takes at most ``SAMPLE`` labelled rows of each class, of at most ``SAMPLE_CHARS`` characters,
drawn by a hash of their ids; their features are taken in the tasks and only these reach the driver,
which weighs the classes by their numbers among all labels. Scoring takes every text whole. Null texts
count as empty, and an empty one is scored by its structure alone; null metadata is a class of its
own. Ties and repeated rows: every row is scored by its text and metadata alone. Without examples of
both classes nothing can be learnt, and all scores are the share of good labels, or one half without
any. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rideflow.llm.common import in_fold

FOLDS = 5
SAMPLE = 1500
SAMPLE_CHARS = 50_000
WORDS = 1 << 17
# Classes of each statistic and of all metadata.
_CLASSES = 64
_META = 1 << 10
FACTORS = 8
ROUNDS = 12
_BATCH = 128
# Words whose bucket a worker keeps; beyond it the worker starts anew.
KNOWN_WORDS = 300_000
_SLICE = 4 << 20
# Distinct words are counted within so many, so that the length of a text is no matter.
_WINDOW = 64
_STATISTICS = 11
FEATURES = WORDS + _STATISTICS * _CLASSES + _META


def _byte_classes() -> np.ndarray:
    """Symbols 1, capital letters 2, small letters 3, digits 4, marks of sentences 5, bytes beyond
    ASCII 6, line ends 7, else 0."""
    kind = np.zeros(256, np.uint8)
    for number, chars in enumerate(
        (b"#*$%&|<>@^~_={}[]\\/+`", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789",
         b".,;:?!'\"()-", bytes(range(128, 256)), b"\n"),
        1,
    ):
        kind[np.frombuffer(chars, np.uint8)] = number
    return kind


_KIND = _byte_classes()


class Reader:
    """Features of texts; the buckets of words met before are looked up."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _buckets(self, words: list[bytes]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = zlib.crc32(w.lower()) % WORDS
            return [known[w] for w in words]

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all texts in a row: where each text's features begin, their numbers and values."""
        n = len(texts)
        rows = [np.array(self._buckets(t.split()), np.int64) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        word = np.concatenate(rows) if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Distinct words of each window, then of each text.
        parts = (sizes + _WINDOW - 1) // _WINDOW
        window = np.repeat(np.cumsum(parts) - parts, sizes) + place // _WINDOW
        in_window, often = np.unique(window * WORDS + word, return_counts=True)
        text_of = np.repeat(np.arange(n), parts)[in_window // WORDS] if len(word) else owner
        fresh = np.bincount(text_of, minlength=n)
        key, first = np.unique(text_of * WORDS + in_window % WORDS, return_inverse=True)
        number = np.bincount(first, often, minlength=len(key)).astype(np.int64)
        text, bucket = np.divmod(key, WORDS)
        value = 1 + np.log(np.maximum(number, 1))
        value /= np.sqrt(np.bincount(text, value * value, minlength=n))[text]
        most = np.zeros(n)
        np.maximum.at(most, text, number)

        statistics = self._statistics(texts, rows, sizes, fresh, most)
        structure = WORDS + np.arange(_STATISTICS) * _CLASSES + statistics
        all_rows = np.concatenate([text, np.repeat(np.arange(n), _STATISTICS)])
        order = np.argsort(all_rows, kind="stable")
        values = np.concatenate([value, np.full(n * _STATISTICS, 0.5)])[order]
        starts = np.searchsorted(all_rows[order], np.arange(n))
        return starts, np.concatenate([bucket, structure.ravel()])[order], values

    @staticmethod
    def _statistics(texts, rows, sizes, fresh, most) -> np.ndarray:
        """The class of each statistic of each text."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        kinds = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        count = np.bincount(owner * 8 + kinds, minlength=n * 8).reshape(n, 8)
        letters = np.maximum(1, count[:, 2] + count[:, 3])
        chars, words = np.maximum(1, lengths), np.maximum(1, sizes)
        lines = [[x for x in t.split(b"\n") if x] for t in texts]
        n_lines = np.array([max(1, len(x)) for x in lines])
        copies = np.array([len(x) - len(set(x)) for x in lines])

        def share(part, whole):
            # Finer near zero.
            return np.minimum(_CLASSES - 1, (24 * np.sqrt(part / whole)).astype(np.int64))

        def power(x):
            return np.minimum(_CLASSES - 1, (2 * np.log2(1 + x)).astype(np.int64))

        return np.stack(
            [
                share(count[:, 1], chars), share(count[:, 2], letters), share(count[:, 4], chars),
                share(count[:, 5], chars), share(count[:, 6], chars), share(count[:, 7], words),
                np.minimum(_CLASSES - 1, 2 * lengths // words), share(sizes - fresh, words),
                share(most, words), power(sizes), share(copies, n_lines),
            ],
            axis=1,
        )


@dataclass
class Machine:
    """Weights and vectors of the features that the sample had; others count nothing."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, starts: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        total, _, _ = _forward(self.bias, self.weights[at], self.vectors[at], x, starts)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _forward(bias, weights, vectors, x, starts):
    """Score before the logistic function, and the sums it needs, by the sum of squares."""
    parts = vectors * x[:, None]
    sums = np.add.reduceat(parts, starts)
    squares = np.add.reduceat(parts * parts, starts)
    total = bias + np.add.reduceat(weights * x, starts) + ((sums * sums - squares) / 2).sum(1)
    return total, sums, parts


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share: float,
    factors: int = FACTORS, rounds: int = ROUNDS,
) -> Machine | None:
    """A machine for the features and labels of a sample; ``share`` of all labels are good ones."""
    if not good.any() or good.all():
        return None
    seen, at = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True)
    x = np.concatenate([v for _, v in rows])
    sizes = np.array([len(f) for f, _ in rows])
    begin = np.cumsum(sizes) - sizes
    weight = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    draw = np.random.default_rng(11)
    bias, w = float(np.log(share / (1 - share))), np.zeros(len(seen))
    v = 0.05 * draw.standard_normal((len(seen), factors))
    # Each parameter's steps shrink with the squares of its slopes so far.
    past = [1e-4, np.full(len(seen), 1e-4), np.full((len(seen), factors), 1e-4)]
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for head in range(0, len(order), _BATCH):
            batch = order[head : head + _BATCH]
            size = sizes[batch]
            starts = np.cumsum(size) - size
            entry = np.repeat(begin[batch] - starts, size) + np.arange(size.sum())
            f, value = at[entry], x[entry]
            total, sums, parts = _forward(bias, w[f], v[f], value, starts)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            error = weight[batch] * (p - good[batch]) / len(batch)
            pull = np.repeat(error, size) * value
            mine, local = np.unique(f, return_inverse=True)
            slope_w = np.bincount(local, pull) + 1e-5 * w[mine]
            pairs = pull[:, None] * (np.repeat(sums, size, axis=0) - parts)
            slope_v = np.stack([np.bincount(local, c) for c in pairs.T], 1) + 1e-5 * v[mine]
            slope = float(error.sum())
            past[0] += slope * slope
            past[1][mine] += slope_w * slope_w
            past[2][mine] += slope_v * slope_v
            bias -= 0.1 * slope / past[0] ** 0.5
            w[mine] -= 0.1 * slope_w / np.sqrt(past[1][mine])
            v[mine] -= 0.05 * slope_v / np.sqrt(past[2][mine])
    weights, vectors = np.zeros(FEATURES, np.float32), np.zeros((FEATURES, factors), np.float32)
    weights[seen], vectors[seen] = w, v
    return Machine(bias, weights, vectors)


def _metadata(columns: Sequence[str]) -> Column:
    """Numbers of the classes of metadata columns: numbers by their power of two, others as they are."""

    def number(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        double = value.try_cast("double")
        label = F.when(double.isNull(), F.coalesce(value, F.lit("\0"))).otherwise(
            F.floor(2 * F.log2(1 + F.abs(double))).cast("string")
        )
        named = F.concat(F.lit(f"{name}="), label)
        return (F.crc32(named.cast("binary")) % _META + (FEATURES - _META)).cast("int")

    return F.array(*[number(c) for c in columns]).cast("array<int>")


def _slices(texts: pa.Array, meta: pa.Array):
    """Texts and metadata by a bounded number of bytes."""
    held, more, size = [], [], 0
    classes = meta.to_pylist()
    for i, text in enumerate(texts):
        held.append(text.as_py())
        more.append(classes[i])
        size += len(held[-1])
        if size >= _SLICE or len(held) >= 4096:
            yield held, more
            held, more, size = [], [], 0
    if held:
        yield held, more


def _with_meta(starts, at, x, meta):
    """The features with those of the metadata behind each text's own."""
    if not meta or not meta[0]:
        return starts, at, x
    width = len(meta[0])
    ends = np.append(starts[1:], len(at))
    at = np.insert(at, np.repeat(ends, width), np.array(meta).ravel())
    x = np.insert(x, np.repeat(ends, width), 0.5)
    return starts + width * np.arange(len(starts)), at, x


def _read(reader: Reader, texts: list[bytes], meta: list[list[int]]):
    return _with_meta(*reader.features(texts), meta)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", metadata: Sequence[str] = (), folds: int = FOLDS, sample: int = SAMPLE,
) -> tuple[Machine | None, float]:
    """A machine from labelled documents outside the held-out fold, and the share of good labels."""
    usable = labels.where(
        F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds) & F.col(label_col).isin(0, 1)
    )
    sizes = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    share = good / (good + bad) if good + bad else 0.5
    if not good or not bad:
        return None, share
    drawn = [
        usable.where(F.col(label_col) == k).groupBy("doc_id").agg(F.max(label_col).alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for k in (0, 1)
    ]
    ids = drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "__id")
    own = docs.select(
        F.col(id_col).alias("__key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        _metadata(metadata).alias("__meta"),
    )
    # At most twice the sample's number of ids.
    found = (
        own.where(F.length("__text") <= SAMPLE_CHARS)
        .join(F.broadcast(ids), F.col("__key") == F.col("__id"))
        .groupBy("__key")
        .agg(F.max("__label").alias("label"), F.min(F.struct("__text", "__meta")).alias("d"))
        .select("__key", "label", F.col("d.__text").cast("binary").alias("t"), F.col("d.__meta").alias("m"))
    )

    def take(batches):
        reader = Reader()
        for batch in batches:
            done = 0
            for texts, meta in _slices(batch.column("t"), batch.column("m")):
                starts, at, x = _read(reader, texts, meta)
                cuts = pa.array(np.append(starts, len(at)).astype(np.int32))
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__key"),
                        part.column("label"),
                        pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.float32))),
                    ],
                    names=["k", "label", "at", "x"],
                )

    kind = found.schema["__key"].dataType.simpleString()
    label_kind = found.schema["label"].dataType.simpleString()
    taken = found.mapInArrow(
        take, f"k {kind}, label {label_kind}, at array<int>, x array<float>"
    ).toArrow().sort_by("k").combine_chunks()
    if not taken.num_rows:
        return None, share
    columns = [taken.column(c).combine_chunks() for c in ("at", "x")]
    cuts = columns[0].offsets.to_numpy()
    at, x = (c.values.to_numpy() for c in columns)
    rows = [(at[a:b].astype(np.int64), x[a:b].astype(float)) for a, b in zip(cuts, cuts[1:])]
    return fit(rows, taken.column("label").to_numpy() == 1, share), share


def scored(
    docs: DataFrame, model: tuple[Machine | None, float], text_col: str = "text",
    metadata: Sequence[str] = (), to: str = "quality_score",
) -> DataFrame:
    """``docs`` with the score of each text in a column ``to``; the other columns stay in Spark."""
    machine, share = model

    @F.arrow_udf("double")
    def judge(texts: pa.Array, meta: pa.Array) -> pa.Array:
        if machine is None:
            return pa.array(np.full(len(texts), share))
        reader = Reader()
        parts = [machine.score(*_read(reader, *part)) for part in _slices(texts, meta)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.withColumn(to, judge(text, _metadata(metadata)))
