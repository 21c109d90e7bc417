from __future__ import annotations

import hashlib
import time

import duckdb
from pyspark.sql import functions as F

from rideflow.llm import exact
from rideflow.llm.queries import ORACLES
from tests.llm.fixtures import FOLDER, LONG, WORD, no_documents, odd_documents


def expected(rows):
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault("".join(WORD.findall(text or "")), []).append((doc_id, text or ""))
    out = []
    for clean, members in by_text.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(clean.encode()).hexdigest()
        seen = set()
        for doc_id, _ in sorted(members, key=lambda m: -len(m[1])):
            out.append((doc_id, keep, len(members), doc_id == keep and doc_id not in seen, sha))
            seen.add(doc_id)
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(exact.copies(docs)) == expected(rows)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in expected(rows) if r[3]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert LONG in {r.text for r in kept.collect()}


def test_empty_table(spark):
    assert exact.copies(no_documents(spark)).count() == 0
    assert exact.without_copies(no_documents(spark)).count() == 0


def test_whole_table_in_several_batches_and_with_clashing_digests(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert found(exact.copies(docs)) == want
    assert found(exact.copies(docs, bytes_per_trigger=1)) == want
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    assert found(exact.copies(docs, digest=weak)) == want


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "doc_id long, text string")
    assert {r.group_size for r in exact.copies(docs, bytes_per_trigger=1).collect()} == {10}


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    exact.copies(no_documents(spark))
    assert spark.conf.get(key, None) == before


def test_very_many_equal_rows_are_no_load(spark):
    """A third of all rows are one row, a third have no id: as fast as rows that all differ."""

    def timed(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        begun = time.monotonic()
        got = found(exact.copies(docs))
        return got, time.monotonic() - begun

    n = 32_000
    unlike, plain = timed([(i, f"text {i}") for i in range(n)])
    assert sum(r[3] for r in unlike) == n
    same, seconds = timed(
        [(7, "a b") if i % 3 == 0 else (None, "a b c") if i % 3 == 1 else (i, f"t {i}") for i in range(n)]
    )
    assert seconds < 2 * plain + 5
    sizes = {len(range(k, n, 3)) for k in (0, 1)}
    assert {r[2] for r in same} == sizes | {1}
    kept = [r[0] for r in same if r[3]]
    assert kept.count(7) == 1 and kept.count(None) == 1
    assert len(kept) == 2 + len(range(2, n, 3))


def test_equal_ids_with_longer_and_shorter_copies(spark):
    rows = [(1, "a b")] * 3 + [(1, "a  b")] * 2 + [(2, "ab")] * 2 + [(1, "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(exact.copies(docs)) == expected(rows)
    assert sorted(r.text for r in exact.without_copies(docs).collect()) == ["a  b", "c"]


def test_sql_twin_on_odd_rows(spark, tmp_path):
    odd_documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(ORACLES["op9_exact_dedup"]).fetchall()
    assert found(exact.copies(docs)) == sorted(want, key=repr)
