"""Scores of texts under a smoothed n-gram model, read off a weighted automaton with failure arcs.

A state is a context that was seen in training; an arc leads on by a word that was seen after it, and
a failure arc gives the probability that is left to the next shorter context. With c the counts and
K = ``PRIOR`` words' worth of trust in the shorter context,

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K),    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

so an arc weighs log10 p(w | h), a failure arc log10 (K / (c(h) + K)). Every distinct n-gram of the
training texts takes part, however many there are. A text is walked once from left to right with the state
carried along: at each token the walk takes the state's arc, or goes down failure arcs, adding their
weights, until a state has one; the arc leads to the longest seen context that ends there.

The corpus is never held in one place. Texts are turned into blocks of some million tokens; each
block reports the distinct n-grams it has and how often it trained on them; the reports are summed by
n-gram in buckets whose number follows the corpus, and a block gets back what the others have of its
own n-grams, from which it builds its own part of the automaton. Words and n-grams are known by hashes:
words by all 64 bits, longer n-grams by their bucket and 48 bits more.

Null texts count as empty; an empty text is one end token. Null ids are trained on. Repeated rows
count as often as they occur. Very long texts stay whole. With no training text every token has the
probability 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import documents, in_fold
from rideflow.session import stage

ORDER = 2
PRIOR = 50.0
BLOCK_TOKENS = 1_500_000
BUCKET_TOKENS = 1 << 21
STRIDE = 512
FOLDS = 10
_SEED = 42
_LOW = 48
_START, _END = np.uint64(0x5374617274), np.uint64(0x456E64)

_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, lengths binary, low binary, high binary, "
    "words binary, n_tokens long, n_train long"
)
_REPORT = "size int, bucket int, block long, keys binary, counts binary"


class _Block:
    """Tokens of some documents as codes of a list of words."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.ids, self.held, self.lengths = [], [], []
        self.tokens = self.trained = 0

    def add(self, doc_id, text: bytes, held: bool) -> None:
        codes = self.codes
        # Code 0 is the end token.
        part = [codes.setdefault(w, len(codes) + 1) for w in text.lower().split()]
        part.append(0)
        self.parts.append(np.array(part, np.uint32))
        self.ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(part))
        self.tokens += len(part)
        self.trained += 0 if held else len(part)

    def row(self, number: int) -> tuple:
        import xxhash

        codes = np.concatenate(self.parts)
        digest = xxhash.xxh64_digest
        known = np.frombuffer(b"".join([digest(w, _SEED) for w in self.codes]), ">u8")
        # The most frequent words get the smallest codes, which compress best.
        order = np.argsort(-np.bincount(codes, minlength=len(known) + 1)[1:], kind="stable")
        rank = np.zeros(len(known) + 1, np.uint32)
        rank[order + 1] = np.arange(1, len(known) + 1)
        codes = rank[codes]
        return (
            number,
            self.ids,
            self.held,
            np.array(self.lengths, "<u4").tobytes(),
            (codes & 0xFFFF).astype("<u2").tobytes(),
            (codes >> 16).astype("<u2").tobytes(),
            known[order].astype("<u8").tobytes(),
            self.tokens,
            self.trained,
        )


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """The corpus in blocks of about ``BLOCK_TOKENS`` tokens, or a task's last rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    plain = documents(docs, id_col, text_col)
    rows = plain.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), in_fold(F.col("doc_id"), folds)
    )
    kinds = to_arrow_schema(_parse_datatype_string(_BLOCK))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for key, text, held in zip(*(batch.column(i) for i in range(3))):
                block.add(key.as_py(), text.as_py(), held.as_py())
                if block.tokens >= BLOCK_TOKENS:
                    yield _record([block.row(number)], kinds)
                    number, block = number + 1, _Block()
        if block.tokens:
            yield _record([block.row(number)], kinds)

    return rows.mapInArrow(collect, _BLOCK)


def _record(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, kinds)], schema=kinds
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """A block's tokens with the hash of the n-gram of each size that ends at each."""

    def __init__(self, row: dict, order: int, bits: int):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        codes = np.frombuffer(row["low"], "<u2").astype(np.uint32)
        codes |= np.frombuffer(row["high"], "<u2").astype(np.uint32) << 16
        words = np.concatenate([[_END], np.frombuffer(row["words"], "<u8")])
        word = words[codes]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(~self.held, self.lengths)
        self.place = np.arange(len(word)) - np.repeat(self.starts, self.lengths)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        longer = word
        for size in range(1, order + 1):
            if size > 1:
                before = np.empty_like(longer)
                before[1:] = longer[:-1]
                before[self.starts] = _START
                longer = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(size))
            # Besides its words an n-gram may have the start of the text, once.
            there = self.place >= size - 2
            shift = np.uint64(0 if size == 1 else max(0, 64 - _LOW - bits))
            self.grams.append((longer >> shift, there))

    def distinct(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of a size, which of them each token ends, their trained counts."""
        grams, there = self.grams[size - 1]
        keys, at = np.unique(grams, return_inverse=True)
        counts = np.bincount(at, self.trained & there, minlength=len(keys))
        return keys, at, counts.astype(np.int64)


def _low(size: int, bits: int) -> int:
    """Bits of an n-gram's key below its bucket."""
    return 64 - bits if size == 1 else min(_LOW, 64 - bits)


def _packed(keys: np.ndarray, low: int) -> bytes:
    """The low bits of the keys in as few bytes as hold them."""
    width = -(-low // 8)
    rows = (keys & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return rows[:, :width].tobytes()


def _unpacked(data: bytes, bucket: int, low: int) -> np.ndarray:
    width = -(-low // 8)
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :width] = rows
    return wide.view("<u8").ravel() | (np.uint64(bucket) << np.uint64(low))


def _short(counts: np.ndarray) -> bytes:
    """Counts that are mostly small: their number, a byte each, then those that a byte can't hold."""
    size = np.array([len(counts)], "<u8").tobytes()
    small = np.minimum(counts, 255).astype(np.uint8)
    return size + small.tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _long(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", -1, 8 + n)
    return counts


def reports(table: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """By block and bucket the block's distinct n-grams and their trained counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(_REPORT))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = Tokens(row, max(sizes), bits)
                for size in sizes:
                    keys, _, counts = tokens.distinct(size)
                    low = _low(size, bits)
                    edges = np.searchsorted(keys >> np.uint64(low), np.arange(1 << bits), "left")
                    rows = []
                    for bucket, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)])):
                        if a < b:
                            data = _short(counts[a:b])
                            rows.append((size, bucket, row["block"], _packed(keys[a:b], low), data))
                    yield _record(rows, kinds)

    return table.mapInArrow(report, _REPORT)


def totals(reported: DataFrame, bits: int) -> DataFrame:
    """For each block and bucket how often its n-grams, in their order, were trained on elsewhere.

    Rows without a block tell the number of distinct n-grams of a bucket that were trained on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{_REPORT}, distinct long"
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size, bucket = rows[0]["size"], rows[0]["bucket"]
        low = _low(size, bits)
        keys = [_unpacked(r["keys"], bucket, low) for r in rows]
        own = [_long(r["counts"]) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(at, np.concatenate(own), minlength=len(distinct)).astype(np.int64)
        out = [(size, bucket, None, b"", b"", int((summed > 0).sum()))]
        end = 0
        for row, c in zip(rows, own):
            start, end = end, end + len(c)
            out.append((size, bucket, row["block"], b"", _short(summed[at[start:end]] - c), 0))
        return pa.Table.from_batches([_record(out, kinds)])

    return reported.groupBy("size", "bucket").applyInArrow(total, schema)


class Automaton:
    """A block's part of the automaton: its states with their failure arcs, and its arcs.

    State 0 is the empty context, state 1 the start of a text; then come the block's distinct n-grams
    below the order. Arcs lie sorted by state and word; those of state 0, which has one for every
    word, by word alone. An arc leads to the longest context that was seen of what it ends. The
    block's n-grams are let go once they have been turned into states and arcs.
    """

    def __init__(self, tokens: Tokens, found: dict[int, list], floor: float, texts: int):
        order = len(tokens.grams)
        self.tokens, self.first = tokens, 1 if order > 1 else 0
        counts, at, ends = [], [], []
        for size in range(1, order + 1):
            keys, inverse, own = tokens.distinct(size)
            # Buckets follow the order of the keys.
            own += np.concatenate([_long(data) for _, data in sorted(found[size])])
            # A block has far less than 2^31 tokens.
            inverse = inverse.astype(np.int32)
            end = np.empty(len(keys), np.int32)
            end[inverse] = np.arange(len(inverse), dtype=np.int32)
            counts.append(own)
            at.append(inverse)
            ends.append(end)
            tokens.grams[size - 1] = None
        self.words, self.counts = at[0], counts[0]
        # A context of size k and number j is state bases[k] + j.
        bases = np.concatenate([[0, 2], 2 + np.cumsum([len(c) for c in counts])])
        n_states = int(bases[order]) if order > 1 else 1
        self.failed = np.zeros(n_states, np.int32)
        self.failure = np.zeros(n_states)
        if order > 1:
            self.failure[1] = np.log10(PRIOR / (texts + PRIOR))
        sources, labels, weights, targets = [], [], [], []
        chance = (counts[0] + 0.1) / floor
        self.root_weight = np.log10(chance)
        self.root_target = np.zeros(len(counts[0]), np.int32)
        for size in range(1, order + 1):
            n, end = counts[size - 1], ends[size - 1]
            if size > 1:
                # An n-gram that ends at a text's first token has the start as its context.
                opens = tokens.place[end] == 0
                context = np.where(opens, 1, bases[size - 1] + at[size - 2][end - 1])
                before = np.where(opens, texts, counts[size - 2][at[size - 2][end - 1]])
                chance = (n + PRIOR * chance[at[size - 2][end]]) / (before + PRIOR)
            if size < order:
                mine = bases[size] + np.arange(len(n))
                self.failed[mine] = bases[size - 1] + at[size - 2][end] if size > 1 else 0
                self.failure[mine] = np.log10(PRIOR / (n + PRIOR))
                target = mine
            else:
                target = bases[size - 1] + at[size - 2][end] if size > 1 else np.zeros(len(n), int)
            seen = n > 0
            if size == 1:
                self.root_target[seen] = target[seen]
            else:
                sources.append(context[seen])
                labels.append(at[0][end[seen]])
                weights.append(np.log10(chance[seen]))
                targets.append(target[seen])
        none = np.zeros(0, np.int32)
        arcs = self._arc(np.concatenate([none, *sources]), np.concatenate([none, *labels]))
        del sources, labels
        # The last entry is no arc: a search that finds nothing ends there at the latest.
        by = np.argsort(arcs)
        self.arcs = np.append(arcs[by], np.iinfo(np.int64).max)
        self.weight = np.append(np.concatenate([none, *weights])[by], 0.0)
        self.target = np.append(np.concatenate([none, *targets])[by], 0).astype(np.int32)

    def _arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return state.astype(np.int64) * len(self.counts) + word

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and weight from each state by each word, over failure arcs where need be."""
        total = np.zeros(len(state))
        after = np.zeros(len(state), np.int32)
        left = np.arange(len(state))
        while len(left):
            at_root = state == 0
            end = left[at_root]
            total[end] += self.root_weight[word[at_root]]
            after[end] = self.root_target[word[at_root]]
            left, state, word = left[~at_root], state[~at_root], word[~at_root]
            key = self._arc(state, word)
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            end = left[hit]
            total[end] += self.weight[arc[hit]]
            after[end] = self.target[arc[hit]]
            left, state, word = left[~hit], state[~hit], word[~hit]
            total[left] += self.failure[state]
            state = self.failed[state]
        return after, total

    def walk(self) -> np.ndarray:
        """Sum of the weights along each text.

        All texts are walked side by side, a token at a time. Texts of more than ``STRIDE`` tokens are
        walked in strides; one after the first is led to its first state by the tokens before it: a
        state is never longer than the order less one.
        """
        lead = len(self.tokens.grams) - 1
        strides = -(-self.tokens.lengths // STRIDE)
        text = np.repeat(np.arange(len(strides)), strides)
        number = np.arange(len(text)) - np.repeat(np.cumsum(strides) - strides, strides)
        begin = number * STRIDE
        stop = np.minimum(begin + STRIDE, self.tokens.lengths[text])
        early = np.where(number > 0, np.minimum(begin, lead), 0)
        length = stop - begin + early
        order = np.argsort(-length, kind="stable")
        place = (self.tokens.starts[text] + begin - early)[order]
        early, length = early[order], length[order]
        state = np.where(number[order] > 0, 0, self.first).astype(np.int32)
        total = np.zeros(len(order))
        # The longest come first, so that those still under way are a beginning of the list.
        under_way = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for t, n in enumerate(under_way):
            state[:n], weight = self.step(state[:n], self.words[place[:n] + t])
            total[:n] += np.where(t >= early[:n], weight, 0.0)
        return np.bincount(text[order], total, minlength=len(strides))


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    order: int = ORDER,
) -> DataFrame:
    """A row per document: counts of tokens, log10 probability by words alone and by the model."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    table = stage(blocks(docs, id_col, text_col, folds), "lm-blocks")
    size = table.agg(
        F.sum("n_tokens").alias("n"),
        F.sum("n_train").alias("train"),
        F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts"),
    ).first()
    trained, texts = int(size.train or 0), int(size.texts or 0)
    bits = max(1, min(23, (int(size.n or 0) // BUCKET_TOKENS).bit_length()))
    words = stage(totals(reports(table, [1], bits), bits), "lm-words")
    distinct = int(words.agg(F.sum("distinct").alias("v")).first().v or 0)
    floor = trained + 0.1 * (distinct + 1)
    known = words.where("block is not null")
    if order > 1:
        longer = totals(reports(table, list(range(2, order + 1)), bits), bits)
        known = known.unionByName(longer.where("block is not null"))
    kinds = to_arrow_schema(_parse_datatype_string(_SCORES))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for r in right.to_pylist():
            found.setdefault(r["size"], []).append((r["bucket"], r["counts"]))
        out = []
        for row in left.to_pylist():
            tokens = Tokens(row, order, bits)
            model = Automaton(tokens, found, floor, texts)
            plain = ((model.counts > 0).astype(np.int64), model.root_weight)
            sums = [np.add.reduceat(x[model.words], tokens.starts) for x in plain]
            sums.append(model.walk())
            out += zip(
                tokens.ids,
                tokens.held.tolist(),
                tokens.lengths.tolist(),
                sums[0].tolist(),
                [trained] * len(tokens.ids),
                sums[1].tolist(),
                sums[2].tolist(),
            )
        return pa.Table.from_batches([_record(out, kinds)])

    return (
        table.groupBy("block")
        .cogroup(known.select("size", "bucket", "block", "counts").groupBy("block"))
        .applyInArrow(score, _SCORES)
    )
