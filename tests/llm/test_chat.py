from __future__ import annotations

from collections import defaultdict
from hashlib import md5

import duckdb
import pytest

from rideflow.llm import chat
from rideflow.llm.queries import ORACLES
from tests.llm.fixtures import FOLDER

ODD = [
    (1, 0, "system", "rules <|im_end|>"), (1, 1, "user", None), (1, 2, "a b>c", "x\ny"),
    (1, 2, "user", "tie"), (1, 2, "user", "tie"), (1, None, "user", "first"), (1, 300, "user", "later"),
    (2, 5, None, ""), (None, 1, "user", "no id"), (3, -1, "solo", "neg"), (3, 0, "solo", "🙂 é"),
]
SCHEMA = "conv_id long, turn long, role string, text string, perspective string, part string, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def whole(rows):
    """Rendering of each conversation for each participant, as one text."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append(((turn is not None, turn or 0), role or "unknown", (text or "").replace("<|", "<||")))
    out = {}
    for conv, lines in convs.items():
        for me in {w for _, w, _ in lines}:
            text, learn = "", []
            for _, who, body in sorted(lines, key=lambda x: (*x[:2], md5(x[2].encode()).hexdigest())):
                name = "assistant" if who == me else "user name=" + who.replace(" ", "_").replace(">", "_")
                text += f"<|im_start|>{name}\n"
                start = len(text)
                text += f"{body}<|im_end|>\n"
                if who == me:
                    learn.append(text[start:])
            out[conv, me] = (text, learn, len(lines), len(learn))
    return out


def joined(df):
    parts = defaultdict(list)
    for r in df.collect():
        parts[r.conv_id, r.perspective].append(r)
    out = {}
    for key, rows in parts.items():
        rows.sort(key=lambda r: r.part)
        assert [r.part for r in rows] == list(range(len(rows)))
        learn = [r.text[s.a : s.b] for r in rows for s in r.learn]
        out[key] = ("".join(r.text for r in rows), learn, sum(r.n_turns for r in rows), sum(r.n_assistant for r in rows))
    return out


def test_odd_rows(spark):
    assert joined(chat.perspectives(frame(spark, ODD))) == whole(ODD)


def test_sql_twin_on_odd_rows(spark, tmp_path):
    rows = ODD + [(1, 2, "user", f"text {i % 7}") for i in range(600)] + [(None, None, None, None)] * 3
    frame(spark, rows).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    found = con.execute(ORACLES["op5_chat_perspectives"])
    names = [d[0] for d in found.description]
    want = sorted((dict(zip(names, r)) for r in found.fetchall()), key=repr)
    made = chat.perspectives(spark.read.parquet(str(tmp_path / "conversations")))
    got = [
        r.asDict() | {"learn": ",".join(f"{s.a}-{s.b}" for s in r.learn)} for r in made.collect()
    ]
    assert sorted(({n: g[n] for n in names} for g in got), key=repr) == want


@pytest.mark.parametrize("n", [4096, 4097])
def test_one_rule_at_every_size(spark, n):
    """One turn number with many rows: the same order, parts and offsets by rank."""
    rows = [(1, 7, "ab"[i % 2], f"t{i}") for i in range(n)]
    df = chat.perspectives(frame(spark, rows))
    assert joined(df) == whole(rows)
    sizes = sorted(r.n_turns for r in df.where("perspective = 'a'").collect())
    assert sizes == sorted([256] * 16 + [n - 4096] * (n > 4096))


def test_many_equal_turns_are_spread(spark):
    rows = [(1, 7, "a", "same")] * 10_000 + [(None, None, "b", None)] * 3_000
    df = chat.perspectives(frame(spark, rows).repartition(5))
    assert max(r.n_turns for r in df.collect()) == 256
    assert joined(df) == whole(rows)


def test_empty_table(spark):
    assert chat.perspectives(frame(spark, ODD).limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert joined(chat.perspectives(df)) == whole(rows)


def test_a_large_conversation_is_laid_out_in_many_parts(spark):
    rows = [(7, i, "abc"[i % 3], f"turn {i}") for i in range(2000)]
    df = chat.perspectives(frame(spark, rows))
    assert df.count() == 3 * 8 and max(r.n_turns for r in df.collect()) == 256
    assert joined(df) == whole(rows)
