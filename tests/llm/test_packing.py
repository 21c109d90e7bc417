from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rideflow.llm import packing
from rideflow.llm.queries import vocabulary
from tests.llm.fixtures import FOLDER, no_documents, odd_documents

TOKENIZER = vocabulary("word_bpe_49k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 2], "<u4") for e in found]


def check(df, rows):
    """Every id lies in one piece, pieces lie end to end in windows, checksums and ids agree."""
    want = defaultdict(list)
    for (doc_id, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want[doc_id].append(ids)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc_id, mine in pieces.items():
        copies = len(want[doc_id])
        ids, at = want[doc_id][0], 0
        for i, r in enumerate(sorted(mine, key=lambda r: r.start)):
            assert r.start == at and r.doc_tokens == len(ids)
            part = ids[at : at + r.length].tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and (r.ids is None or bytes(r.ids) == part)
            if i % copies == copies - 1:
                at += r.length
        assert at == len(ids)
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return [sum(n for _, n in placed) for placed in windows.values()]


@pytest.mark.parametrize("with_ids", [False, True])
def test_odd_rows(spark, with_ids):
    docs = odd_documents(spark)
    check(packing.packed(docs, TOKENIZER, with_ids), [(r.doc_id, r.text) for r in docs.collect()])


def test_whole_table_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = check(packing.packed(docs, TOKENIZER), [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(packing.CAPACITY - s for s in sizes) < 0.02 * sum(sizes)


def test_several_groups_give_distinct_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    cut = packing.stage(packing.pieces(docs, TOKENIZER), "pieces-test")
    check(packing.pack(cut, group_windows=4), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert packing.packed(no_documents(spark), TOKENIZER).count() == 0


def test_differencing_balances_and_adds_windows_when_full():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 512, 3000)
    part = packing.balanced(sizes, 200)
    sums = np.bincount(part, sizes, minlength=200)
    assert sums.max() - sums.min() <= 64
    part = packing.windows(np.full(5, 60), 100)
    assert np.bincount(part, np.full(5, 60)).max() == 60 and part.max() == 4
    # The textbook case: 8 7 6 5 4 in two parts gives 16 and 14.
    assert sorted(np.bincount(packing.balanced(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert packing.windows(np.zeros(0, np.int64), 10).tolist() == []
    assert packing.balanced(np.array([7]), 3).tolist() == [0]


def test_ids_word_by_word_are_those_of_the_text():
    texts = [
        "The idiot's <|endoftext|> and <|ENDOFTEXT|> 3,5 İstanbul ΣΑΣ. x.y, ... naïve é ﬁ ㈱   a‍b",
        "don't WE'LL İ. ss. ßẞ, 日本語。 🙂🙂. à́b ½ ①. ,. . ,",
    ]
    encode = packing.WordEncoder(TOKENIZER)
    ids, edges = encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]
    assert got == [x[:-1].tolist() for x in ids_of(texts)]


def test_equal_pieces_are_spread_over_all_groups(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    cut = packing.stage(packing.pieces(docs.repartition(4), TOKENIZER), "pieces-test")
    placed = packing.pack(cut, group_windows=4).collect()
    total = sum(r.length for r in placed)
    groups = defaultdict(int)
    for r in placed:
        groups[r.sequence_id >> 24] += 1
    assert len(placed) == 20_000
    assert len(groups) == -(-total // (packing.CAPACITY * 4)) > 1
    assert max(groups.values()) < 1.2 * 20_000 / len(groups)
    windows = defaultdict(list)
    for r in placed:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
