"""SentencePiece models on the tokenizers library: encoding, decoding, parity.

The model's protobuf is parsed and rebuilt: the normaliser (its character map, white space rules and
dummy prefix), the metaspace marker, the vocabulary with its scores as a unigram model or, if the
model says so, as merges in the order of scores, and byte fallback. Where no piece of the vocabulary
reaches beyond one marked word, a text is cut before each marker and a word met before is looked up;
new words are encoded in batches on several threads. Parity with the sentencepiece library is verified
for every word of every text, as is that its ids decode to it again; texts that can't be cut are
verified whole.

Null texts count as empty, and empty texts have no ids. Very long texts are encoded whole. Repeated
rows get the same answer each. An empty table gives no rows. Other columns of any name are no matter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rideflow.llm.common import documents

MARK = "▁"
# Distinct words whose ids a worker keeps; beyond it the worker starts anew.
KNOWN_WORDS = 600_000
_SLICE = 4 << 20
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _OWN, _BYTE = 1, 2, 3, 4, 6


def model_proto(path: str):
    """The parsed model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


def merges(pieces: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, by falling score of the piece, then by its place."""
    rank = {p: i for i, (p, _) in enumerate(pieces)}
    found = []
    for i, (piece, score) in enumerate(pieces):
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                found.append((-score, i, rank[left], rank[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


class Normaliser:
    """Text to marked text by the model's rules, and marked text to words."""

    def __init__(self, proto):
        from tokenizers import Regex, normalizers

        rules = proto.normalizer_spec
        steps = []
        if rules.precompiled_charsmap:
            steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
        if rules.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex("[ ]{2,}"), " ")]
        self.plain = not steps
        steps.append(normalizers.Replace(" ", MARK))
        self.rules = normalizers.Sequence(steps)
        self.prefix = MARK if rules.add_dummy_prefix else ""
        pieces = [(p.piece, p.type) for p in proto.pieces]
        # No piece reaches beyond a marked word, and no symbol of the user's own may hold anything.
        self.by_word = not any(
            k == _OWN or k == _NORMAL and re.search(f"[^{MARK}]{MARK}", p) for p, k in pieces
        )

        self.by_line = self.by_word and not any("\n" in p and len(p) > 1 for p, _ in pieces)

    def __call__(self, text: str) -> str:
        clean = text.replace(" ", MARK) if self.plain else self.rules.normalize_str(text)
        return self.prefix + clean if clean else ""

    def words(self, clean: str) -> list[str]:
        """The marked words of a normalised text; the whole text if words can't be told apart."""
        if not self.by_word:
            return [clean] if clean else []
        if MARK * 2 in clean or not self.by_line:
            return (_WORDS if self.by_line else _MARKED).findall(clean)
        found = []
        for line in clean.split("\n"):
            first, *others = line.split(MARK)
            if first:
                found.append(first)
            found += [MARK + w for w in others]
            found.append("\n")
        return found[:-1]


_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Encoder and decoder rebuilt from a SentencePiece model."""

    def __init__(self, proto, verify: bool = True, threads: int = 2):
        import sentencepiece
        from tokenizers import AddedToken, Tokenizer, decoders, models

        self.threads = threads
        self.native = None
        if verify:
            self.native = sentencepiece.SentencePieceProcessor(
                model_proto=proto.SerializeToString()
            )

        pieces = [(p.piece, p.score) for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        special = (_UNKNOWN, _CONTROL, _BYTE)
        fallback = proto.trainer_spec.byte_fallback
        unknown = kinds.index(_UNKNOWN)
        if proto.trainer_spec.model_type == _UNIGRAM:
            lowest = min(s for (_, s), k in zip(pieces, kinds) if k not in special)
            # Bytes and control marks are never chosen by score.
            scored = [
                (p, lowest - 1e6 if k in special else s) for (p, s), k in zip(pieces, kinds)
            ]
            model = models.Unigram(scored, unk_id=unknown, byte_fallback=fallback)
        elif proto.trainer_spec.model_type == _BPE:
            model = models.BPE(
                {p: i for i, (p, _) in enumerate(pieces)},
                merges([x for x, k in zip(pieces, kinds) if k not in special]),
                unk_token=pieces[unknown][0],
                fuse_unk=True,
                byte_fallback=fallback,
            )
        else:
            raise ValueError("only unigram and merge models can be rebuilt")
        self.normaliser = Normaliser(proto)
        self.tokenizer = Tokenizer(model)
        own = [p for (p, _), k in zip(pieces, kinds) if k == _OWN]
        self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p in own])
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        )
        self.known: dict[str, bytes] = {}
        self.wrong: dict[str, tuple[bool, bool]] = {}

    def learn(self, words: set[str]) -> None:
        """Encode new words in one batch, on all threads, and verify them."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.wrong.clear()
        new = list(words.difference(self.known))
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.known.update(zip(new, [array("I", x).tobytes() for x in ids]))
        if self.native is not None:
            again = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            plain = [w.replace(MARK, " ") for w in new]
            theirs = self._theirs(new)
            if ids != theirs or again != plain:
                for word, *pairs in zip(new, zip(ids, theirs), zip(again, plain)):
                    same = tuple(a == b for a, b in pairs)
                    if not all(same):
                        self.wrong[word] = same

    def _theirs(self, words: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of words, each in a text of its own."""
        prefix = self.normaliser.prefix
        alone = [w[1:] if w.startswith(MARK) else None for w in words]
        if not self.normaliser.by_line or not prefix:
            return self.native.encode([w.removeprefix(prefix) for w in words])
        found = self.native.encode([t or "" for t in alone], num_threads=self.threads)
        # A word without a mark, or a mark without a word, needs line ends around it.
        others = [i for i, t in enumerate(alone) if not t]
        first = self.native.encode("\n")
        texts = ["\n" * (alone[i] is None) + (words[i] if alone[i] is None else "") + "\n" for i in others]
        for i, x in zip(others, self.native.encode(texts, num_threads=self.threads)):
            found[i] = x[len(first) if alone[i] is None else 0 : len(x) - len(first) + 1]
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, bool, bool]]:
        """Unsigned little-endian 32-bit ids of each text, words, parity, whether it decodes."""
        split = [self.normaliser.words(self.normaliser(t)) for t in texts]
        self.learn(set().union(*split))
        known, wrong = self.known.__getitem__, self.wrong
        out = []
        for words in split:
            bad = [wrong[w] for w in words if w in wrong] if wrong else []
            ids = b"".join(map(known, words))
            out.append((ids, len(words), all(a for a, _ in bad), all(b for _, b in bad)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t.removeprefix(" ") if self.normaliser.prefix else t for t in texts]


_ENCODED = (
    "doc_id long, ids binary, n_ids long, ids_crc32 long, n_words long, parity boolean, "
    "decodes boolean"
)


def encoded(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2
) -> DataFrame:
    """A row per document: its ids, their number and checksum, its words, both verdicts of parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = Codec(model_proto(model), True, threads)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = held = 0
            for i, text in enumerate(texts):
                held += len(text)
                if held < _SLICE and i + 1 < len(texts):
                    continue
                ids, words, parity, decodes = zip(*codec.encode(texts[start : i + 1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[start : i + 1], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(words, pa.int64()),
                        pa.array(parity, pa.bool_()),
                        pa.array(decodes, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_ids", "ids_crc32", "n_words", "parity", "decodes"],
                )
                start, held = i + 1, 0

    plain = documents(docs, id_col, text_col)
    return plain.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ENCODED)


def decoded(
    rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``doc_id`` and the text of its ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_proto(model), False)
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codec.decode(lists), pa.string())],
                names=["doc_id", "text"],
            )

    plain = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return plain.mapInArrow(run, "doc_id long, text string")
