from __future__ import annotations

import numpy as np
import pytest

from rideflow.llm import simhash
from tests.llm.fixtures import FOLDER, fingerprint, groups, no_documents, odd_documents


def expected(rows):
    fps = [fingerprint(t or "") for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if (fps[i] ^ fps[j]).bit_count() <= 3
    ]
    root = groups(links, range(len(rows)))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root[i], []).append(doc_id)
    least = {r: min((x for x in m if x is not None), default=None) for r, m in ids.items()}
    return sorted(((d, f"{fps[i]:016x}", least[root[i]]) for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    assert found(simhash.near_duplicates(docs)) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({r[2] for r in want}, key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.one_of_each(no_documents(spark)).count() == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_tiles_miss_no_link(spark, monkeypatch, tile):
    """Chains of fingerprints a few bits apart, of all populations, in small and large tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    fps = [0, 1, 2**64 - 1, 2**63]
    for _ in range(60):
        x = int(rng.integers(0, 2**63)) & int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 8))):
            fps.append(x)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(bit)
    fps = sorted({int(np.array(x, np.uint64).view(np.int64)) for x in fps})
    links = [
        (a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 3
    ]
    root = groups(links, fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert {x: got.get(x, x) for x in fps} == root


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(5000, 5000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_unlike_texts_of_null_or_repeated_ids_are_all_kept(spark):
    texts = [f"{w} alone stands number {i} with {w * 3} and nothing else like it {w[::-1]} at all"
             for i, w in enumerate(["apple", "river", "stone", "cloud", "tiger", "lemon"])]
    ids = [None, None, None, 7, 7, 8]
    rows = [*zip(ids, texts), (None, texts[0]), (9, texts[4]), (7, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [fingerprint(t) for t in texts]
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(fps) for b in fps[:i])
    kept = sorted((tuple(r) for r in simhash.one_of_each(docs).collect()), key=repr)
    assert kept == sorted(zip(ids, texts), key=repr)
