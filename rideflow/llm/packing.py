"""Packing of tokenised documents into windows of equal capacity.

Each text becomes ids by a public tokenizer, is closed with an end id and cut into pieces: as many of
full capacity as it holds, the rest into pieces of ``PIECE`` ids at most. Only a piece's place, length
and checksum travel on, unless the ids are asked for. Pieces are dealt by hash to groups of about
``WINDOWS`` windows; within a group the largest-differencing method for many parts joins the two
partial partitions that are furthest from balance, the fullest parts of one with the emptiest of the
other, until one partition is left. If its fullest window exceeds the capacity, the group is
partitioned anew into one window more.

Null and empty texts have the end id alone. Repeated rows are packed as documents of their own. Ties
are settled by the order of id, start and checksum. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import documents
from rideflow.session import stage

CAPACITY = 4096
PIECE = 512
WINDOWS = 512
END_ID = 2
_SLICE = 6 << 20
_TOGETHER = 200
_BATCH = 50

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
    "sequence_id long, offset long"
)


# Small letters of ASCII and Latin-1, which no normalising changes, then any ASCII punctuation but
# for that of contractions and of the tokenizer's own marks.
_STOP = r"[!-&(-/:;=?@\[-`{}~]"
_PLAIN = rf"^[a-zß-öø-ÿ]+{_STOP}*$"


class WordEncoder:
    """Ids of whole texts, each distinct word of a batch encoded once.

    The tokenizer lowers case, drops white space and lets no token cross it, so the ids of a text are
    those of its words in order. Plain words, one unit or two with their punctuation, need no
    normalising, and the last id of each unit marks its end: many of them are encoded as one text.
    All other words go through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.Punctuation("contiguous"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[ends] = True

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has; none if the ends don't fit."""
        edges = np.append(np.arange(0, len(words), _TOGETHER), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), words), " ").to_pylist()
        parts = []
        for first in range(0, len(texts), _BATCH):
            found = self.bare.encode_batch_fast(
                texts[first : first + _BATCH], add_special_tokens=False
            )
            parts += [np.array(x.ids, np.uint32) for x in found]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.last[ids]) + 1
        stopped = pc.match_substring_regex(words, f"{_STOP}$").to_numpy(zero_copy_only=False)
        units = np.cumsum(1 + stopped)
        if units[-1] != len(ends):
            return self._any(words)
        return ids, np.diff(ends[units - 1], prepend=0)

    def _any(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of any kind."""
        found = self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
        sizes = np.array([len(x.ids) for x in found], np.int64)
        return np.array([i for x in found for i in x.ids], np.uint32), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin, the end of the last included."""
        # Only the tokenizer's own marks tell capitals from small letters.
        marked = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(distinct, _PLAIN)
        ids, sizes = [np.zeros(0, np.uint32)], np.zeros(len(distinct), np.int64)
        where = []
        for mask, encode in ((plain, self._plain), (pc.invert(plain), self._any)):
            chosen = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            if len(chosen):
                found, sizes[chosen] = encode(distinct.filter(mask))
                ids.append(found)
                where.append(chosen)
        pool, order = np.concatenate(ids), np.concatenate([np.zeros(0, np.int64), *where])
        starts = np.zeros(len(distinct), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat((starts[at] - ends[:-1]).astype(np.int32), lengths)
        place += np.arange(ends[-1], dtype=np.int32)
        return pool[place], ends[edges - edges[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes, so that a worker holds few words at a time."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    whole = n // capacity * capacity
    full = [(s, capacity) for s in range(0, whole, capacity)]
    return full + [(s, min(piece, n - s)) for s in range(whole, n, piece)]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    capacity: int = CAPACITY,
    piece: int = PIECE,
) -> DataFrame:
    """The pieces of every document; ``ids`` has a piece's ids if asked for, else null."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One thread a worker: others would only keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                rows = []
                found, edges = encode(texts.slice(a, b - a))
                data, edges = found.astype("<u4").tobytes(), (4 * edges).tolist()
                for key, low, high in zip(keys[a:b], edges, edges[1:]):
                    ids = data[low:high] + end
                    n = len(ids) // 4
                    for start, length in cuts(n, capacity, piece):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append(
                            (key, start, length, zlib.crc32(part), n, part if with_ids else None)
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.binary()])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )
                pa.default_memory_pool().release_unused()

    plain = documents(docs, id_col, text_col)
    return plain.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, _PIECES
    )


class _Parts:
    """A partial partition: sums of its parts from the largest down, and the chain of each part."""

    __slots__ = ("first", "last", "sums")

    def __init__(self, sums, first, last):
        self.sums, self.first, self.last = sums, first, last


def _added(parts: _Parts, size: int, leaf: int, chain: np.ndarray) -> _Parts:
    """One item goes to the smallest part, which moves up to its place."""
    sums, first, last = parts.sums, parts.first, parts.last
    total, head = sums[-1] + size, first[-1]
    if head < 0:
        head = leaf
    else:
        chain[last[-1]] = leaf
    at = len(sums) - 1 - int(np.searchsorted(sums[-2::-1], total, "left"))
    for values, new in ((sums, total), (first, head), (last, leaf)):
        values[at + 1 :] = values[at:-1].copy()
        values[at] = new
    return parts


def _joined(a: _Parts, b: _Parts, chain: np.ndarray) -> _Parts:
    """The largest parts of one with the smallest of the other."""
    first, last = b.first[::-1], b.last[::-1]
    sums = a.sums + b.sums[::-1]
    both = (a.first >= 0) & (first >= 0)
    chain[a.last[both]] = first[both]
    heads = np.where(a.first >= 0, a.first, first)
    tails = np.where(first >= 0, last, a.last)
    order = np.argsort(-sums, kind="stable")
    return _Parts(sums[order], heads[order], tails[order])


def balanced(sizes: np.ndarray, count: int) -> np.ndarray:
    """Part of each item when ``sizes`` are split into ``count`` parts by largest differencing."""
    n = len(sizes)
    chain = np.full(n, -1, np.int64)
    heap = [(-int(s), i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n

    def grown(size: int, leaf: int) -> _Parts:
        parts = _Parts(*(np.full(count, v, np.int64) for v in (0, -1, -1)))
        return _added(parts, size, leaf, chain)

    while len(heap) > 1:
        (da, ia, a), (db, ib, b) = heapq.heappop(heap), heapq.heappop(heap)
        if a is None and b is None:
            made = _added(grown(-da, ia), -db, ib, chain)
        elif a is None:
            made = _added(b, -da, ia, chain)
        elif b is None:
            made = _added(a, -db, ib, chain)
        else:
            made = _joined(a, b, chain)
        heapq.heappush(heap, (-int(made.sums[0] - made.sums[-1]), turn, made))
        turn += 1
    spread, leaf, parts = heap[0]
    if parts is None:
        parts = grown(-spread, leaf)
    out = np.zeros(n, np.int64)
    for part, item in enumerate(parts.first.tolist()):
        while item >= 0:
            out[item] = part
            item = int(chain[item])
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, as few near-equal windows as the capacity lets differencing find."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = balanced(sizes, count)
        if np.bincount(part, sizes, minlength=count).max() <= capacity:
            return part
        count += 1


def pack(cut: DataFrame, capacity: int = CAPACITY, group_windows: int = WINDOWS) -> DataFrame:
    """``cut`` pieces with ``sequence_id`` and ``offset``; ``cut`` should be a written table.

    A group has about ``group_windows`` windows' worth of tokens however long the input is.
    """
    total = cut.agg(F.sum("length").alias("n")).first().n or 0
    groups = max(1, -(-int(total) // (capacity * group_windows)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        lengths = table["length"].to_numpy()
        full = lengths >= capacity
        window = np.empty(len(lengths), np.int64)
        window[full] = np.arange(full.sum())
        window[~full] = full.sum() + windows(lengths[~full], capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        starts = np.searchsorted(window[order], window[order], "left")
        offset = np.empty_like(before)
        offset[order] = before - before[starts]
        sequence = table["g"].to_numpy() * (1 << 24) + window
        table = table.append_column("sequence_id", pa.array(sequence))
        return table.append_column("offset", pa.array(offset)).drop_columns("g")

    # With its row number: pieces that are equal in all columns are dealt like any others.
    row = F.monotonically_increasing_id()
    dealt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", row), F.lit(groups))
    return cut.withColumn("g", dealt).groupBy("g").applyInArrow(place, _PLACED)


def packed(docs: DataFrame, tokenizer: str, with_ids: bool = False, **columns) -> DataFrame:
    """Documents to placed pieces: tokenised once, the pieces written, then packed."""
    return pack(stage(pieces(docs, tokenizer, with_ids=with_ids, **columns), "pieces"))
