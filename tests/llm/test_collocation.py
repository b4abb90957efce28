"""Operator 11 against plain counting, and its automata on their own."""

import random

import numpy as np
import pytest
from brute import phrase_rows
from pyspark.sql import functions as F

from runledger.llm import collocation
from runledger.llm.automata import DEPTH, Automaton, starts_of
from runledger.llm.collocation import summed

DOC = "text string, lang string"


def corpus(seed, n, words=40, length=120):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["Über", "é", "漢字", "a'b"]
    weights = [1 / (i + 1) for i in range(len(names))]
    sets = [rng.sample(names, 3) for _ in range(8)]

    def text():
        out = []
        for _ in range(rng.randint(0, length)):
            out += rng.choice(sets) if rng.random() < 0.1 else rng.choices(names, weights)
            out[-1] += rng.choice(["", "", "", "", ".", ",", "\n", "!?"])
        return rng.choice([" ", " ", "\t "]).join(out)

    return [(text(), rng.choice(["aa", "aa", "aa", "bb", None, "und"])) for _ in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases(spark):
    rows = corpus(1, 200)
    df = spark.createDataFrame(rows, DOC)
    assert got(collocation.phrases(df)) == phrase_rows(rows)
    assert got(collocation.phrases(df, least=5, top=50)) == phrase_rows(rows, 5, 50)


def test_many_ranges_and_shards(spark, monkeypatch):
    rows = corpus(2, 150)
    monkeypatch.setattr(collocation, "SHARD_WORDS", 700)
    monkeypatch.setattr(collocation, "RANGE_WINDOWS", 400)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    assert len(collocation.range_bounds(df)) > 10
    assert got(collocation.phrases(df, least=4)) == phrase_rows(rows, 4)


def test_odd_rows(spark):
    rows = [(None, "aa"), ("", "aa"), (" \t ", None), ("...!?\n", "aa"), ("one two " * 60_000, "aa"), ("same line here\n" * 40, "aa"), ("same line here\n" * 40, "aa"), ("A a A a", "AA"), ("x\x1cy \x85z " * 40, "cc"), ("solo", "dd")]
    df = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(n) for n in ("phrase", "f", "words", "part", "a", "rank", "score")])
    assert got(collocation.phrases(df)) == phrase_rows(rows)
    assert collocation.phrases(df.filter("false")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(rng.choice([1, 30, 3000])):
        row = [rng.randint(1, rng.choice([2, 6, 20])) for _ in range(DEPTH)]
        row[rng.randint(1, DEPTH) :] = []
        rows[tuple(row + [0] * (DEPTH - len(row)))] = rng.choice([1, 1, 1, 7])
    keys = sorted(rows)
    columns, weights = [np.array(c) for c in zip(*keys)], np.array([rows[k] for k in keys])
    machine = Automaton.from_bytes(Automaton.of_sorted(columns, summed(weights)).to_bytes())
    back, found = machine.paths()
    assert [tuple(r) for r in zip(*[c.tolist() for c in back])] == keys and found.tolist() == weights.tolist()
    assert all(len(f) - 1 <= len(s) for f, s in zip(machine.first, starts_of(columns)))
    asked = keys[:50] + [(99, 0, 0, 0), (1, 99, 0, 0)]
    lengths = [rng.randint(1, sum(x > 0 for x in k)) for k in asked]
    due = [sum(w for k, w in rows.items() if k[:n] == a[:n]) for a, n in zip(asked, lengths)]
    assert machine.compose([np.array(c) for c in zip(*asked)], np.array(lengths)).tolist() == due


def test_states_are_shared():
    """Two heads with the same tails and counts lead to one state."""
    rows = [(h, 5, t, 0) for h in range(1, 9) for t in (6, 7)]
    machine = Automaton.of_sorted([np.array(c) for c in zip(*rows)], summed(np.ones(len(rows), dtype=np.int64)))
    assert [len(f) - 1 for f in machine.first] == [1, 1, 1, 1]
