"""Silences by event-time timers against all gaps of the beats."""

import random

from conftest import rows
from pyspark.sql import functions as F

from runledger.streaming import processors

SECOND = 1_000_000
BEAT = "node_id BIGINT, at_us BIGINT"


def drained(spark, path, parts, delay="60 seconds", interval=10 * SECOND):
    source = str(path / "in")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, BEAT).coalesce(1).write.parquet(f"{source}/{n:03d}")
    stream = spark.readStream.schema(BEAT).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", delay)
    return rows(processors.drain(processors.silence_stream(timed, interval), "silences"))


def gaps(beats, limit, now):
    want = []
    for node in {n for n, at in beats if n is not None and at is not None}:
        times = sorted({at for n, at in beats if n == node and at is not None})
        for at, after in zip(times, [*times[1:], None]):
            if after is None or after - at > limit:
                if at + limit <= now:
                    want.append((node, "lost", at, None))
                if after is not None and after <= now:
                    want.append((node, "back", at, after))
    return sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_runs_join_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        beats = [rng.randrange(400) for _ in range(rng.randrange(1, 30))]
        whole = processors.joined_runs([(b, b) for b in beats], 9)
        some = []
        for b in beats:
            some = processors.joined_runs([*some, (b, b)], 9)
        assert some == whole
        assert all(b[0] - a[1] > 9 for a, b in zip(whole, whole[1:]))


def test_beats_out_of_order_within_the_delay(spark, tmp_path):
    rng = random.Random(11)
    beats, at = [], 0
    for _ in range(400):
        at += rng.choice([SECOND, 3 * SECOND, 9 * SECOND + rng.randrange(999_999)])
        beats.append((rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 9)]), at + 1))
    beats += rng.sample(beats, 20)  # repeats
    seen = sorted(beats, key=lambda b: b[1] + rng.randrange(25 * SECOND))  # late by less than the delay
    parts = [seen[i:i + 70] for i in range(0, len(seen), 70)]
    now = (max(b[1] for b in beats) // 1000 - 60_000) * 1000
    want = gaps(beats, 30 * SECOND, now)
    assert {r[1] for r in want} == {"lost", "back"} and len(want) > 40
    assert drained(spark, tmp_path, parts) == want


def test_a_node_that_never_comes_back_nulls_and_the_border(spark, tmp_path):
    first = [(1, 1 * SECOND), (2, 1 * SECOND), (None, 5 * SECOND), (1, None), (3, 2 * SECOND)]
    second = [(2, 31 * SECOND), (3, 32 * SECOND + 1), (4, 500 * SECOND)]  # 2: just within the limit
    got = drained(spark, tmp_path, [first, second])
    assert got == gaps(first + second, 30 * SECOND, 440 * SECOND)
    assert (1, "lost", 1 * SECOND, None) in got and (2, "lost", 1 * SECOND, None) not in got
    assert (3, "back", 2 * SECOND, 32 * SECOND + 1) in got


def test_no_beats(spark, tmp_path):
    assert drained(spark, tmp_path, [[]]) == []
