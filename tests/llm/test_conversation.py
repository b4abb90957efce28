"""Operator 13 against dynamic programming over whole audits."""

import os
import random

import duckdb
import pytest
from brute import conversation as by_hand
from brute import damaged_rows
from pyspark.sql import functions as F

from runledger.llm import conversation, edit_search, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROW = "conv_id long, turn long, role string, text string"


def want(rows):
    return sorted(((c, *by_hand(r)) for c, r in damaged_rows(rows).items()), key=lambda r: (r[0] is None, r[0] or 0))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def drawn(rng, conv, n, roles=("system", "user", "assistant", "tool")):
    texts = ["yes.", "no", "", " \t", "What?", "go on!", "line one\nline two.", "é."]
    return [(conv, t, rng.choice(roles), rng.choice(texts) + rng.choice(["", str(t), f" {t}."])) for t in range(n) if rng.random() > 0.1]


def test_many_small_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(400) for r in drawn(rng, c, rng.randint(1, 9))]
    assert got(conversation.repair(spark.createDataFrame(rows, ROW))) == want(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(None, t, r, x) for t, r, x in [(None, "user", "a."), (None, "user", "a."), (3, None, None), (3, "assistant", "b"), (9, "", "c.")]]
    rows += [(7, 1, "user", "same."), (7, 1, "user", "same."), (7, 1, "assistant", "same."), (8, None, None, None), (9, 1, "system", "x" * 200_000 + ".")]
    rows += [(-1, -5, "user", "early."), (-1, 5, "assistant", "late.")] + drawn(rng, 10, 30)
    df = spark.createDataFrame(rows, ROW).select("*", *[F.lit(1).alias(n) for n in ("pos", "block", "known", "code", "cost", "seen")])
    assert got(conversation.repair(df)) == want(rows)
    assert conversation.repair(df.filter("false")).count() == 0


def test_all_rows_dropped(spark):
    lost = [c for c in range(400) if not damaged_rows([(c, 0, "user", "hello.")])[c]][:5]
    rows = [(c, 0, "user", "hello.") for c in lost]
    empty = by_hand([])
    assert got(conversation.repair(spark.createDataFrame(rows, ROW))) == [(c, *empty) for c in lost]


def test_long_conversations_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = drawn(rng, 1, 700) + drawn(rng, 2, 300, ("user", "assistant")) + drawn(rng, 3, 5)
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400)]
    df = spark.createDataFrame(rows, ROW)
    due = want(rows)
    assert got(conversation.repair(df)) == due
    monkeypatch.setattr(conversation, "BLOCK_ROWS", 100)
    assert got(conversation.repair(df)) == due


def test_segments_agree_with_one_search(monkeypatch):
    rng = random.Random(4)
    for n in range(60):
        code = "".join(rng.choice(edit_search.LETTERS) for _ in range(rng.randint(1, 40)))
        whole = edit_search.search(code, edit_search.START, edit_search.AT_END)
        monkeypatch.setattr(edit_search, "SEGMENT", 1 + n % 7)
        assert edit_search.solve(code, edit_search.START, edit_search.AT_END) == whole
        monkeypatch.undo()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert got(queries.op13_conversation_repair(spark, SF)) == want(rows)
