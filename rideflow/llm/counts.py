"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A task puts the distinct words of its texts into a trie. A node stands for a beginning of words; it
stores the best score of any segmentation of that beginning into pieces of the vocabulary, which is
the maximum, over the pieces that end there, of the score of the node before the piece plus the
piece's own, and the number of pieces in it. Words that begin alike share these nodes, so each
beginning is scored once. Ends of words keep their counts; a text's count is the sum over its words.

Of equal scores the one with the longer last piece counts. A character without a piece costs the
model's penalty and counts as its bytes if the model falls back to bytes, else as one token. Null and
empty texts have no tokens; very long texts are counted whole, and so are very long words, as the
trie keeps no more than ``NODES`` nodes between batches. Repeated rows get the same answer each. An
empty table gives no rows. Other columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import documents
from rideflow.llm.pieces import Normaliser, model_proto

NODES = 1_000_000
PENALTY = 10.0
_SLICE = 1 << 21
_NORMAL, _OWN = 1, 4


class Trie:
    """Forward scores of all beginnings of the words seen so far."""

    def __init__(self, scores: dict[str, float], fallback: bool):
        self.scores = scores
        self.fallback = fallback
        self.unknown = min(scores.values(), default=0.0) - PENALTY
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]
        self.ends: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Number of pieces in the best segmentation of ``word``."""
        path, node, step = [0], 0, self.next
        for depth, char in enumerate(word, 1):
            child = step.get((node, char))
            if child is None:
                child = step[node, char] = len(self.best)
                self._score(word, depth, path)
            node = child
            path.append(node)
        self.ends[word] = self.pieces[node]
        return self.pieces[node]

    def _score(self, word: str, depth: int, path: list[int]) -> None:
        scores, tails, best = self.scores, self.tails, self.best
        top, count = None, 0
        for start in range(depth - 1, -1, -1):
            tail = word[start:depth]
            score = scores.get(tail)
            if score is not None:
                score += best[path[start]]
                if top is None or score >= top:
                    top, count = score, self.pieces[path[start]] + 1
            elif start == depth - 1:
                # No piece for the character alone.
                top = best[path[start]] + self.unknown
                count = self.pieces[path[start]] + (len(tail.encode()) if self.fallback else 1)
            if tail not in tails:
                break
        best.append(top)
        self.pieces.append(count)


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: doc_id, n_words (pre-tokens), n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = model_proto(model)
        normal = Normaliser(proto)
        scores = {p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _OWN)}
        trie = Trie(scores, proto.trainer_spec.byte_fallback)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = held = 0
            for i, text in enumerate(texts):
                held += len(text)
                if held < _SLICE and i + 1 < len(texts):
                    continue
                split = [normal.words(normal(t)) for t in texts[start : i + 1]]
                if len(trie.best) > NODES:
                    trie.clear()
                ends = trie.ends
                for word in sorted(set().union(*split).difference(ends)):
                    trie.insert(word)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[start : i + 1], pa.int64()),
                        pa.array([len(s) for s in split], pa.int64()),
                        pa.array([sum([ends[w] for w in s]) for s in split], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )
                start, held = i + 1, 0

    plain = documents(docs, id_col, text_col)
    return plain.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_tokens long"
    )
