"""Pairs from cells of blocks, against all pairs; what is shuffled follows the sets."""

import random

import pytest
from pyspark.sql import functions as F

from runledger.operators import cells, similarity


def rows(seed, jobs, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    out = []
    for job in range(jobs):
        base = [rng.choices(words, [1 / (i + 1) for i in range(80)], k=rng.choice([1, 4, 20, 60])) for _ in range(n // 4)]
        for b in base:
            for _ in range(4):
                out.append((job or None, len(out), sorted(set(b[rng.randint(0, len(b) // 3):] + rng.sample(words, rng.randint(0, 4))))))
    return out + [(1, len(out), []), (1, len(out) + 1, None)]


@pytest.mark.parametrize("load", [cells.BLOCK_NUMBERS, 6_000, 1_500])
def test_near_pairs_miss_none(spark, monkeypatch, load):
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", load)
    data = rows(1, 3, 60)
    sets = spark.createDataFrame(data, "job_id int, pos long, tokens array<string>")
    tokens = {p: (j, set(t)) for j, p, t in data if j is not None and t}
    alike = lambda a, b: len(a & b) / len(a | b)
    for t in (0.3, 0.5, 0.85):
        due = {(a, b) for a in tokens for b in tokens if a < b and tokens[a][0] == tokens[b][0] and alike(tokens[a][1], tokens[b][1]) >= t}
        found = [tuple(r) for r in cells.near_pairs(sets, F.transform("tokens", lambda w: F.hash(w)), t).collect()]
        assert len(found) == len(set(found)) and set(found) == due
        # numbers that several words share only add pairs, which the join then drops
        assert due <= {tuple(r) for r in cells.near_pairs(sets, F.transform("tokens", lambda w: F.hash(w) % 40), t).collect()}
        assert {(r.a, r.b) for r in similarity.similar_pairs(sets, t).collect()} == due


def test_unlike_sets_with_common_words_leave_no_candidates(spark):
    """Every two sets share words, none are alike: nothing but the sets goes to the cells."""
    rng = random.Random(2)
    data = [(1, i, [f"c{k}" for k in range(4)] + [f"u{i}_{k}" for k in range(rng.randint(20, 30))]) for i in range(300)]
    sets = spark.createDataFrame(data, "job_id int, pos long, tokens array<string>")
    assert cells.near_pairs(sets, F.transform("tokens", lambda w: F.hash(w)), 0.3).count() == 0
    plan = similarity.similar_pairs(sets, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "tok" not in plan.replace("tokens", "")  # no join on single words
