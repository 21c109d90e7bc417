from __future__ import annotations

import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rideflow.llm import counts, pieces
from rideflow.llm.queries import vocabulary
from tests.llm.fixtures import FOLDER, no_documents, odd_documents

MODEL = vocabulary("piece_bpe_32k.model")
TEXTS = ["", " ", "  two", "a\nb \n c\n", "▁mark ▁", "日本語 🙂x", "tab\tand space", "don't. 12,5", "\n", "a  b   c "]


def native(proto=None):
    proto = proto or pieces.model_proto(MODEL)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def unigram():
    """The vocabulary read as a unigram model, runs of spaces at scores that floats can tell apart."""
    proto = pieces.model_proto(MODEL)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    return proto


def ids(codec, texts):
    return [np.frombuffer(x[0], "<u4").tolist() for x in codec.encode(texts)]


def test_merge_model_has_parity_text_by_text():
    codec = pieces.Codec(pieces.model_proto(MODEL))
    assert codec.normaliser.by_word and codec.normaliser.by_line
    got = codec.encode(TEXTS)
    assert ids(codec, TEXTS) == native().encode(TEXTS)
    assert all(parity and decodes for _, _, parity, decodes in got)
    assert codec.decode(ids(codec, TEXTS)) == [t.replace("▁", " ") for t in TEXTS]


def test_unigram_model_has_parity():
    proto = unigram()
    codec = pieces.Codec(proto)
    texts = ["the people of the country", "Erst nach und nach", "a b c", ""]
    assert ids(codec, texts) == native(proto).encode(texts)


def test_other_models_are_refused():
    proto = pieces.model_proto(MODEL)
    proto.trainer_spec.model_type = 4
    with pytest.raises(ValueError, match="unigram"):
        pieces.Codec(proto)


def test_white_space_rules_of_the_model_are_kept():
    proto = pieces.model_proto(MODEL)
    proto.normalizer_spec.remove_extra_whitespaces = True
    codec = pieces.Codec(proto)
    texts = ["  a   b ", "c", " ", ""]
    assert ids(codec, texts) == native(proto).encode(texts)


def test_wrong_words_are_told():
    codec = pieces.Codec(pieces.model_proto(MODEL))
    codec.encode(["good"])
    codec.known["▁bad"], codec.wrong["▁bad"] = b"\0\0\0\0", (False, True)
    assert [x[2:] for x in codec.encode(["good", "bad good"])] == [(True, True), (False, True)]


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_documents_and_back(spark, make):
    docs = make(spark)
    rows = pieces.encoded(docs, MODEL)
    back = pieces.decoded(rows, MODEL)
    want = sorted(((r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, back.collect()), key=repr) == want
    theirs = native().encode([r.text or "" for r in docs.collect()])
    got = sorted((r.ids_crc32, r.n_ids, r.parity, r.decodes) for r in rows.collect())
    assert got == sorted((zlib.crc32(np.array(x, "<u4").tobytes()), len(x), True, True) for x in theirs)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id")
    got = [(r.doc_id, r.n_ids) for r in pieces.encoded(docs, MODEL).orderBy("doc_id").collect()]
    rows = docs.collect()
    assert got == [(r.doc_id, len(x)) for r, x in zip(rows, native().encode([r.text for r in rows]))]


def best_count(text: str, scores: dict[str, float]) -> int:
    """Tokens of the best segmentation of a whole text, by the textbook recursion."""
    clean = "▁" + text.replace(" ", "▁") if text else ""
    longest = max(map(len, scores))
    best = [(0.0, 0)]
    lowest = min(scores.values()) - counts.PENALTY
    for end in range(1, len(clean) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            piece = clean[start:end]
            score, n = best[start]
            if piece in scores:
                options.append((score + scores[piece], -start, n + 1))
            elif end - start == 1:
                options.append((score + lowest, -start, n + len(piece.encode())))
        top = max(options)
        best.append((top[0], top[2]))
    return best[-1][1]


def unigram_scores():
    return {p.piece: p.score for p in pieces.model_proto(MODEL).pieces if p.type in (1, 4)}


def test_counts_are_those_of_the_whole_text(spark):
    scores = unigram_scores()
    docs = odd_documents(spark).where(F.length("text") < 1000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_tokens) for r in counts.token_counts(docs, MODEL).collect()), key=repr)
    assert got == sorted(((i, best_count(t, scores)) for i, t in rows), key=repr)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 1500")
    rows = {r.doc_id: best_count(r.text, scores) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(docs, MODEL).collect()} == rows


def test_counts_agree_with_the_library(spark):
    """On lines of known characters without runs of spaces."""
    proto = unigram()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    lines = lines.where(r"text rlike '^[A-Za-z,. ]+$' and not text like '%  %'").collect()
    df = spark.createDataFrame([(i, r.text) for i, r in enumerate(lines)], "doc_id long, text string")
    want = [len(x) for x in native(proto).encode([r.text for r in lines])]
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(df, MODEL).collect()}
    assert len(want) > 100 and [got[i] for i in range(len(want))] == want


def test_counts_of_odd_tables(spark):
    assert counts.token_counts(no_documents(spark), MODEL).count() == 0
    got = counts.token_counts(odd_documents(spark), MODEL)
    assert {r.n_tokens for r in got.where("doc_id in (1, 2)").collect()} == {0}
    assert got.count() == 12


def test_beginnings_are_scored_once():
    trie = counts.Trie({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0}, False)
    assert trie.insert("abc") == 2 and trie.insert("abab") == 2 and trie.insert("ab") == 1
    assert len(trie.best) == 6 and trie.insert("azc") == 3
