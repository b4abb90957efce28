import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from runledger.operators import kv, leases, lifecycle
from runledger.sources import journal, tables
from runledger.streaming import processors


def writes(*items):
    """(op, at_ms, value, expected, ttl_ms)"""
    data = [("n", "k", i, at * 1000, op, value, expected, ttl, -1, "w") for i, (op, at, value, expected, ttl) in enumerate(items)]
    return pd.DataFrame(data, columns=kv.WRITE_COLUMNS)


def fold(*items):
    out, state = kv.apply_writes(writes(*items), None)
    return out.to_dict("records"), state


def test_versions_keep_identity():
    out, state = fold(("put", 1, 1, 0, -1), ("put", 2, 2, 0, -1))
    assert [r["version"] for r in out] == [1, 2] and state["created_us"] == 1000 and state["updated_us"] == 2000


def test_one_writer_wins():
    out, _ = fold(("put", 1, 0, 0, -1), ("cas", 2, 1, 1, -1), ("cas", 3, 2, 1, -1))
    assert [r["accepted"] for r in out] == [True, True, False] and out[2]["actual_version"] == 2


def test_expired_claim_starts_over_and_keeps_cas_label():
    out, _ = fold(("put", 1, 0, 0, 5), ("claim", 3, 1, 0, -1), ("claim", 20, 2, 0, -1))
    assert [r["accepted"] for r in out] == [True, False, True]
    assert out[2]["version"] == 1 and out[2]["operation"] == "compare_and_swap" and out[2]["expires_us"] == -1


def test_expiry_is_inherited_within_a_lineage():
    out, _ = fold(("put", 1, 0, 0, 10), ("put", 5, 1, 0, -1), ("compact", 12, 0, 0, -1), ("delete", 13, 0, 0, -1))
    assert out[1]["expires_us"] == 11_000
    assert [r["operation"] for r in out] == ["create", "put", "expire", ""] and out[2]["audit_us"] == 5_000


def test_audit_names():
    out, _ = fold(("put", 1, 0, 0, -1), ("cas", 2, 1, 1, -1), ("delete", 3, 0, 0, -1))
    assert [(r["operation"], r["version"]) for r in out] == [("create", 1), ("compare_and_swap", 2), ("delete", 2)]


def test_contended_counter():
    """100 writers re-reading after a conflict: nothing is lost."""
    rng, items, seen, done = random.Random(1), [("put", 0, 0, 0, -1)], {}, set()
    version, value, at = 1, 0, 1
    while len(done) < 100:
        who = rng.randrange(100)
        if who in done:
            continue
        expected, base = seen.get(who, (1, 0))
        items.append(("cas", at, base + 1, expected, -1))
        if expected == version:
            version, value = version + 1, base + 1
            done.add(who)
        else:
            seen[who] = (version, value)
        at += 1
    _, state = fold(*items)
    assert (state["value"], state["version"]) == (100, 101)


def lease_fold(*items):
    data = [(1, i, at * 1000, op, ms, 3) for i, (op, at, ms) in enumerate(items)]
    out, _ = leases.apply_lease_events(pd.DataFrame(data, columns=leases.NEED), None)
    return list(zip(out["outcome"], out["place"], out["attempt"]))


def test_expired_lease_is_redelivered_and_late_ack_refused():
    got = lease_fold(("grant", 0, 0), ("sweep", 1, 0), ("grant", 9999, 5), ("ack", 20000, 0), ("extend", 20001, 1))
    assert got == [("granted", "leased", 1), ("requeued", "ready", 1), ("granted", "leased", 2), ("requeued", "ready", 2),
                   ("unknown_lease", "ready", 2)]


def test_third_failure_parks_and_release_gives_back():
    step = 10**6
    got = lease_fold(*[x for i in range(3) for x in (("grant", i * step, 9), ("reject", i * step + 1, 0))])
    assert got[-1] == ("parked", "dead", 3)
    assert lease_fold(("grant", 0, 9), ("release", 1, 0), ("grant", 2, 9), ("extend", 3, 50), ("ack", 40, 0))[1:] == [
        ("released", "ready", 0), ("granted", "leased", 1), ("extended", "leased", 1), ("acknowledged", "done", 1)]


GOOD = '{"record": "job_status_changed", "job_id": "j", "status": "running"}'


def journal_file(tmp_path, *lines, end="\n"):
    path = tmp_path / "run.journal"
    path.write_text("\n".join(lines) + end)
    return str(path)


def test_torn_tail_is_dropped_and_blank_lines_skipped(spark, tmp_path):
    path = journal_file(tmp_path, GOOD, "", '{"record": "job_stat', end="")
    assert rows(journal.read_journal(spark, path).select("job_id", "kind", "status")) == [("j", "job_status_changed", "running")]


def test_corruption_in_the_middle_fails(spark, tmp_path):
    path = journal_file(tmp_path, GOOD, "not json at all", GOOD)
    with pytest.raises(Exception, match="corrupt"):
        journal.read_journal(spark, path).collect()
    assert journal.read_journal(spark, path, on_corrupt="report").count() == 1


def test_lines_keep_order_across_splits(spark, tmp_path):
    path = journal_file(tmp_path, *[GOOD.replace('"j"', f'"{i:05d}"') for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = journal.read_journal(spark, path)
        assert df.rdd.getNumPartitions() > 1
        got = [r.job_id for r in df.orderBy("file", "split_start", "line_order").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i:05d}" for i in range(3000)]


def test_replay(spark):
    moves = spark.createDataFrame(
        [("j", "plan", "running", 1, 1), ("j", "plan", "completed", 1, 2), ("j", "work", "running", 2, 3)],
        "job_id STRING, task_id STRING, to_state STRING, attempt INT, pos BIGINT",
    )
    got = {r.task_id: (r.resume_state, r.attempt) for r in lifecycle.latest_state(moves).collect()}
    assert got == {"plan": ("completed", 1), "work": ("created", 2)}
    changes = spark.createDataFrame([("j", "running", 1), ("lost", "running", 1)], "job_id STRING, status STRING, pos BIGINT")
    planned = spark.createDataFrame([("j", "planning")], "job_id STRING, status STRING")
    resumed = spark.createDataFrame([("j", 1)], "job_id STRING, n BIGINT")
    out = {r.job_id: r for r in lifecycle.job_status(changes, planned, resumed).collect()}
    assert out["j"].status == "planning" and "1 tasks" in out["j"].status_reason
    assert out["lost"].status is None and "never planned" in out["lost"].error


def test_declared_tables_round_trip(spark, tmp_path):
    assert len(tables.DECLARED) == 26
    df = spark.createDataFrame([("a", "b")], "task_id STRING, depends_on STRING")
    tables.write_table(df, str(tmp_path), "task_dependencies")
    assert rows(tables.read_table(spark, str(tmp_path), "task_dependencies")) == [("a", "b")]
    assert tables.conform(df, "tasks").schema == tables.schema("tasks")


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    data = [("n", str(rng.randrange(3)), i, i * 1000, rng.choice(["put", "cas", "delete"]), i, rng.randrange(3), -1, -1, "a")
            for i in range(120)]
    schema = ("namespace STRING, key STRING, pos BIGINT, at_us BIGINT, op STRING, value BIGINT, expected BIGINT, "
              "ttl_ms BIGINT, job_id BIGINT, actor STRING")
    df = spark.createDataFrame(data, schema)
    source = str(tmp_path / "in")
    for n in range(3):
        df.filter(f"pos >= {n * 40} AND pos < {n * 40 + 40}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert rows(processors.drain(processors.kv_stream(stream), "kv")) == rows(kv.write_outcomes(df))


def test_lease_timer_sweeps(spark, tmp_path):
    early = [(1, 0, 10_000_000, "grant", 1000, 3)]
    late = [(2, 1, 9_000_000_000, "grant", 1000, 3)]
    source, ddl = str(tmp_path / "in"), "task_id BIGINT, pos BIGINT, at_us BIGINT, op STRING, duration_ms BIGINT, max_attempts INT"
    for part in (early, late):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "1 minute")
    got = processors.drain(processors.lease_stream_with_expiry(timed), "leases").filter("task_id = 1")
    assert sorted((r.outcome, r.cause) for r in got.collect()) == [("granted", ""), ("requeued", "lease expired")]


def test_lease_timer_waits_for_the_last_microsecond(spark, tmp_path):
    source, ddl = str(tmp_path / "in"), "task_id BIGINT, pos BIGINT, at_us BIGINT, op STRING, duration_ms BIGINT, max_attempts INT"
    for part in ([(1, 0, 10_000_007, "grant", 1000, 3)], [(2, 1, 9_000_000_000, "grant", 1000, 3)]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "1 minute")
    got = processors.drain(processors.lease_stream_with_expiry(timed), "leases").filter("task_id = 1")
    assert sorted((r.outcome, r.cause) for r in got.collect()) == [("granted", ""), ("requeued", "lease expired")]


def test_wrongly_typed_or_missing_fields_are_corrupt(spark, tmp_path):
    typed = '{"record": "task_transitioned", "seq": 1, "job_id": "j", "task_id": "t", "attempt": "two", "transition": {"to": "queued"}}'
    missing = '{"record": "task_completed", "job_id": "j", "result": {"title": "x"}}'
    for bad in (typed, missing):
        path = journal_file(tmp_path, GOOD, bad, GOOD)
        with pytest.raises(Exception, match="corrupt"):
            journal.read_journal(spark, path).collect()
        assert journal.read_journal(spark, path, on_corrupt="report").count() == 1


def test_seq_orders_records_of_several_appends(spark, tmp_path):
    path = str(tmp_path / "many.journal")
    for seq, status in ((3, "completed"), (1, "planning"), (2, "running")):
        df = spark.createDataFrame([("job_status_changed", seq, "j", status)], "record STRING, seq BIGINT, job_id STRING, status STRING")
        journal.append_journal(df, path)
    found = journal.read_journal(spark, path)
    assert [r.status for r in found.orderBy("seq").collect()] == ["planning", "running", "completed"]


def test_plan_records_give_the_graph_back(spark, tmp_path):
    from runledger.plans.records import plan_records

    tasks = spark.createDataFrame([(0, i, f"t{i}", "work", i % 3, "created") for i in range(1200)], "job_id INT, task_id BIGINT, title STRING, kind STRING, stage INT, state STRING")
    edges = spark.createDataFrame([(0, i, i - 1) for i in range(1, 1200)], "job_id INT, child BIGINT, parent BIGINT")
    path = str(tmp_path / "plan.journal")
    journal.append_journal(plan_records(tasks, edges), path)
    records = journal.read_journal(spark, path)
    back = journal.planned_tasks(records)
    assert records.count() == 3 and back.count() == 1200
    assert sorted((int(r.child), int(r.parent)) for r in journal.planned_edges(back).collect()) == [(i, i - 1) for i in range(1, 1200)]
