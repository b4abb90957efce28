"""Block-wise operators give what a plain window gives, however small the blocks."""

import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.operators import kv, leases, match, ordered, usage
from runledger.operators.ordered import Ordered, with_block


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 9), i, rng.randrange(100)) for i in range(600)]
    return spark.createDataFrame(data, "k INT, pos BIGINT, v BIGINT").cache()


def test_blocks_are_bounded(hot):
    blocked, n = with_block(hot, "pos", rows=50)
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert n == len(sizes) == 12 and max(sizes) <= 60


@pytest.mark.parametrize("back", [True, False])
def test_shift(hot, back):
    plain = W.partitionBy("k").orderBy("pos")
    want = hot.withColumn("p", (F.lag if back else F.lead)("v").over(plain))
    got = Ordered(hot, ["k"], "pos", rows=40).shift({"p": "v"}, back=back).done()
    assert rows(got.select("k", "pos", "v", "p")) == rows(want)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("size", [17, 40, 10_000])
def test_nulls_do_not_depend_on_blocks(hot, descending, size):
    """Null order values, null values, and both at once."""
    odd = hot.select(
        "k", "pos", F.when(F.col("pos") % 7 != 0, F.col("pos")).alias("o"),
        F.when((F.col("pos") % 3 != 0) & ((F.col("k") > 2) | (F.col("pos") > 300)), F.col("v")).alias("v"),
    )
    way = F.desc if descending else F.asc
    order = W.partitionBy("k").orderBy(way("o"), way("pos"))
    w = order.rowsBetween(W.unboundedPreceding, 0)
    want = odd.select(
        "k", "pos", F.sum("v").over(w).alias("s"), (F.sum("v").over(w) - F.coalesce("v", F.lit(0))).alias("e"),
        F.max("v").over(w).alias("m"), F.row_number().over(order).cast("bigint").alias("n"), F.lag("v").over(order).alias("p"),
    )
    got = Ordered(odd, ["k"], "o", ["pos"], descending=descending, rows=size)
    got = got.running_sum(F.col("v"), "s").running_sum(F.col("v"), "e", inclusive=False).running_max(F.col("v"), "m")
    assert rows(got.row_number("n").shift({"p": "v"}).done().select("k", "pos", "s", "e", "m", "n", "p")) == rows(want)


@pytest.mark.parametrize("size", [100, 250])
def test_latency_ewma_with_zeros(spark, size):
    rng = random.Random(11)
    data = [(1, i, rng.choice([0, 0, 1, 2, 5, 40, 100_000]) if i % 90 > 20 else 0) for i in range(700)]
    mean = 0
    for _, _, x in data:
        mean = x if mean == 0 else (4 * mean + x) // 5
    df = spark.createDataFrame(data, "agent_id BIGINT, pos BIGINT, latency_ms BIGINT")
    assert [tuple(r) for r in match.latency_ewma(df, rows=size).collect()] == [(1, mean)]


@pytest.mark.parametrize("descending", [True, False])
def test_running(hot, descending):
    order = F.desc("pos") if descending else F.asc("pos")
    w = W.partitionBy("k").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    want = hot.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w)).withColumn(
        "n", F.row_number().over(W.partitionBy("k").orderBy(order)).cast("bigint")
    )
    got = Ordered(hot, ["k"], "pos", descending=descending, rows=40)
    got = got.running_sum(F.col("v"), "s").running_max(F.col("v"), "m").row_number("n").done()
    assert rows(got.select("k", "pos", "v", "s", "m", "n")) == rows(want)


def test_success_ewma(spark, hot):
    attempts = hot.select(F.col("k").alias("agent_id"), "pos", (F.col("v") > 30).alias("ok"))
    want = {}
    for k, _, ok in sorted(rows(attempts), key=lambda r: r[1]):
        want[k] = 0.8 * want.get(k, 1.0) + 0.2 * ok
    for size in (30, 10_000):
        got = {r.agent_id: r.success_rate for r in match.success_ewma(attempts, ["agent_id"], rows=size).collect()}
        assert got == pytest.approx(want)


def test_ewma_recovers(spark):
    data = [(1, i, i > 0) for i in range(51)]
    rate = match.success_ewma(spark.createDataFrame(data, "agent_id INT, pos BIGINT, ok BOOLEAN"), ["agent_id"]).first()[1]
    assert 0.99 < rate < 1.0


def test_latency_ewma_blocks_and_early_stop(spark):
    rng = random.Random(3)
    data = [(a, i, rng.randrange(5 if a else 0, 900)) for i in range(1500) for a in (0, 1)]
    df = spark.createDataFrame(data, "agent_id BIGINT, pos BIGINT, latency_ms BIGINT")
    want = {}
    for a, _, x in data:
        m = want.get(a, 0)
        want[a] = x if m == 0 else (4 * m + x) // 5
    for size in (200, 100_000):
        assert {r[0]: r[1] for r in match.latency_ewma(df, rows=size).collect()} == want


def brute_breaker(calls, threshold, reset_us):
    out, fails, opened = [], 0, None
    for pos, at, ok in calls:
        if opened is not None and at < opened + reset_us:
            out.append((pos, True, False))
            continue
        if opened is not None:
            opened, fails = None, 0
        if ok:
            fails = 0
            out.append((pos, False, False))
            continue
        fails += 1
        trips = fails >= threshold
        if trips:
            opened = at
        out.append((pos, False, trips))
    return out


@pytest.mark.parametrize("size", [37, 10_000])
def test_breaker(spark, size):
    rng = random.Random(11)
    at, calls = 0, []
    for i in range(800):
        at += rng.randrange(1, 4000)
        calls.append((i, at, rng.random() < 0.45))
    data = [("p", *c) for c in calls] + [("q", i + 1000, i, True) for i in range(20)]
    df = spark.createDataFrame(data, "provider STRING, pos BIGINT, at_us BIGINT, ok BOOLEAN")
    got = usage.breaker_calls(df, threshold=3, reset_ms=10, rows=size).filter("provider = 'p'").drop("provider")
    assert rows(got) == sorted(brute_breaker(calls, 3, 10_000), key=lambda r: str(r[0]))


def test_kv_and_lease_folds_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    ops = ["put", "cas", "claim", "delete", "compact"]
    data = [
        ("n", str(0 if rng.random() < 0.5 else rng.randrange(4)), i, i * 1000, rng.choice(ops), i, rng.randrange(4),
         rng.choice([-1, -1, 30]), rng.choice([-1, 3]), "a")
        for i in range(400)
    ]
    schema = ("namespace STRING, key STRING, pos BIGINT, at_us BIGINT, op STRING, value BIGINT, expected BIGINT, "
              "ttl_ms BIGINT, job_id BIGINT, actor STRING")
    writes = spark.createDataFrame(data, schema)
    assert rows(kv.write_outcomes(writes, rows=60)) == rows(kv.write_outcomes(writes))
    moves = ["grant", "ack", "reject", "release", "extend", "sweep"]
    data = [(0 if rng.random() < 0.5 else 1, i, i * 10**6, rng.choice(moves), rng.choice([500, 4000]), 9) for i in range(300)]
    events = spark.createDataFrame(data, "task_id BIGINT, pos BIGINT, at_us BIGINT, op STRING, duration_ms BIGINT, max_attempts INT")
    assert rows(leases.lease_outcomes(events, rows=50)) == rows(leases.lease_outcomes(events))


def test_fold_orders_rows():
    frame = pd.DataFrame({"key": ["a"] * 2, "namespace": ["n"] * 2, "pos": [1, 2], "at_us": [1, 2], "op": ["put", "put"],
                          "value": [1, 2], "expected": [0, 0], "ttl_ms": [-1, -1], "job_id": [-1, -1], "actor": ["x", "x"]})
    out, state = kv.apply_writes(frame, None)
    assert out["version"].tolist() == [1, 2] and state["created_us"] == 1


@pytest.mark.parametrize("kind", ["fold", "scan"])
def test_folds_keep_rows_without_order(spark, kind):
    """Null order values come first, and no row is lost, with one block or many."""
    data = [("k", i, None if i % 10 == 0 else 5000 - i) for i in range(1000)] + [("q", 2000 + i, None) for i in range(5)]
    df = spark.createDataFrame(data, "key STRING, id BIGINT, pos BIGINT")

    def number(pdf, state):
        before = int(state["n"]) if state else 0
        return pd.DataFrame({"id": pdf["id"], "n": range(before + 1, before + len(pdf) + 1)}), {"n": before + len(pdf)}

    def run(size):
        if kind == "fold":
            found = ordered.fold_by_key(df, ["key"], "pos", ["id"], number, "id BIGINT, n BIGINT", "n BIGINT", size)
        else:
            count = lambda pdf: {"rows": len(pdf)}
            add = lambda summary, state: {"n": summary["rows"] + (state["n"] if state else 0)}
            found = ordered.scan_by_key(df, ["key"], "pos", number, count, add, "id BIGINT, n BIGINT", "n BIGINT", "rows BIGINT", size)
        return {r.id: r.n for r in found.collect()}

    whole = run(100_000)
    assert len(whole) == 1005 and {whole[i] for i in range(0, 1000, 10)} == set(range(1, 101))
    for size in (200, 60):
        parts = run(size)
        assert parts.keys() == whole.keys()
        assert {i: n for i, n in parts.items() if i % 10 and i < 1000} == {i: n for i, n in whole.items() if i % 10 and i < 1000}
        assert {parts[i] for i in range(0, 1000, 10)} == set(range(1, 101))
