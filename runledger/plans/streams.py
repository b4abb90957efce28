"""Streaming queries: each drains the events table as a stream and returns its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import monitor, queueing
from runledger.plans import match  # noqa: F401 - registers the SQL reused below
from runledger.plans.records import APPENDS, KV, LEASES, WAIT, appended_moves, journal_records
from runledger.plans.registry import SQL, query, with_views
from runledger.session import cut, scratch_path
from runledger.sources import journal, ordered_journal
from runledger.streaming import processors as op


@query("stream_dedup", "O-STM1", "SELECT user_id, event_type, value FROM events")
def stream_dedup(t):
    events = t.stream("events")
    twice = events.unionByName(events).withColumn("at", F.col("ts").cast("timestamp"))
    key = F.concat_ws("#", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    first = op.dedup_stream(twice.withColumn("attempt_key", key), "attempt_key", "at")
    return op.drain(first.select("user_id", "event_type", "value"), "dedup")


@query(
    "stream_leases", "O-STM2",
    LEASES + " SELECT task_id, pos, outcome, cause, place, attempt, due AS due_us FROM st WHERE n > 0",
)
def stream_leases(t):
    return op.drain(op.lease_stream(t.stream_view("v_lease_events")), "leases")


_SWEPT = "((due + 999) // 1000 * 1000)"


@query(
    "stream_lease_expiry", "O-STM2 with timers",
    # the lease log without sweeps, then a sweep of each lease that has lapsed by the last watermark
    LEASES.replace("FROM v_lease_events)", "FROM v_lease_events WHERE op <> 'sweep')", 1)
    + f""", w AS (SELECT (max(at_us) // 1000 - 600000) * 1000 AS now FROM v_lease_events WHERE op <> 'sweep'),
    e AS (SELECT task_id, attempt, {_SWEPT} AS at_us FROM st, w WHERE place = 'leased' AND {_SWEPT} <= now
      AND (task_id, n) IN (SELECT task_id, max(n) FROM st GROUP BY task_id))
    SELECT task_id, pos, outcome, cause, place, attempt, due AS due_us FROM st WHERE n > 0
    UNION ALL SELECT task_id, -1, CASE WHEN attempt < 3 THEN 'requeued' ELSE 'parked' END, 'lease expired',
      CASE WHEN attempt < 3 THEN 'ready' ELSE 'dead' END, attempt, CASE WHEN attempt < 3 THEN at_us + ({WAIT} // 2
        + (at_us % 1000000 * 1000) % ({WAIT} - {WAIT} // 2 + 1)) * 1000 ELSE 0 END FROM e""",
)
def stream_lease_expiry(t):
    events = t.stream_view("v_lease_events").filter("op <> 'sweep'")
    timed = events.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "10 minutes")
    return op.drain(op.lease_stream_with_expiry(timed), "lease-expiry")


_DAY = 86_400_000_000
_QUIET = _DAY // 3


@query(
    "stream_silences", "O-DCL8 O-STM2 with timers",
    f"""WITH w AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS now FROM events),
    b AS (SELECT user_id AS node_id, epoch_us(ts) AS at_us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next_us FROM events),
    g AS (SELECT * FROM b WHERE (next_us IS NULL OR next_us - at_us > 3 * {_QUIET}::BIGINT))
    SELECT node_id, 'lost' AS change, at_us AS lost_us, cast(NULL AS bigint) AS back_us FROM g, w WHERE at_us + 3 * {_QUIET}::BIGINT <= now
    UNION ALL SELECT node_id, 'back', at_us, next_us FROM g, w WHERE next_us <= now""",
)
def stream_silences(t):
    """Users without an event for a day, found by timers, and their returns."""
    beats = t.stream_view("v_attempts").select(F.col("task_id").alias("node_id"), "at_us", F.timestamp_micros("at_us").alias("at"))
    return op.drain(op.silence_stream(beats.withWatermark("at", "10 minutes"), _QUIET), "silences")


@query("stream_kv", "O-STM5 O-STM6", KV + " SELECT key, pos, accepted, actual AS actual_version FROM st WHERE n > 0")
def stream_kv(t):
    out = op.kv_stream(t.stream_view("v_kv_writes"))
    return op.drain(out, "kv").select("key", "pos", "accepted", "actual_version")


@query(
    "stream_retry_routing", "O-STM3",
    with_views("v_attempts")
    + """SELECT CASE WHEN pos % 5 < 3 THEN 'retry' ELSE 'park' END AS decision, count(*) AS n FROM v_attempts WHERE NOT ok GROUP BY 1""",
)
def stream_retry_routing(t):
    failed = t.stream_view("v_attempts").filter("NOT ok").select(
        "pos", (F.col("pos") % 5).alias("attempt"), F.col("at_us").alias("failed_us"), F.lit("failed").alias("reason")
    )
    base = scratch_path(t.spark, "routing")
    retry, park = f"{base}/retry", f"{base}/park"
    op.drain_writer(op.route_failures(failed, queueing.retry_or_park, retry, park), "routing", t.spark)
    both = t.spark.read.parquet(retry).unionByName(t.spark.read.parquet(park))
    return both.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_job_view", "O-STM9",
    with_views("v_transitions")
    + """SELECT job_id, state, count(*) AS n FROM (SELECT job_id, task_id, arg_max(to_state, pos) AS state FROM v_transitions GROUP BY 1, 2) x
    GROUP BY 1, 2""",
)
def stream_job_view(t):
    deltas = op.drain(op.state_delta_stream(t.stream_view("v_transitions")), "job-view")
    return deltas.groupBy("job_id", "state").agg(F.sum("delta").alias("n")).filter("n <> 0")


@query(
    "stream_event_tail", "O-STM10",
    with_views("v_job_events")
    + "SELECT job_id, seq, kind FROM v_job_events WHERE seq > 5000 AND kind IN ('task_completed', 'task_failed')",
)
def stream_event_tail(t):
    tail = monitor.events_after(t.stream_view("v_job_events"), 5000, ["task_completed", "task_failed"])
    return op.drain(tail.select("job_id", "seq", "kind"), "tail")


@query("stream_reliability", "O-STM11", SQL["agent_reliability"])
def stream_reliability(t):
    rows = op.drain(op.reliability_stream(t.stream_view("v_attempts")), "reliability")
    last = rows.groupBy("agent_id").agg(F.max_by(F.struct("success_rate", "average_latency_ms"), "pos").alias("r"))
    return last.select("agent_id", F.round("r.success_rate", 6).alias("success_rate"), "r.average_latency_ms")


@query(
    "stream_window_counts", "O-STM12",
    with_views("v_job_events")
    + """, w AS (SELECT at_us // 3600000000 * 3600000000 AS from_us, kind, count(*) AS n FROM v_job_events GROUP BY 1, 2)
  SELECT from_us, kind, n FROM w WHERE from_us + 3600000000 <= (SELECT max(at_us) // 1000 * 1000 - 600000000 FROM v_job_events)""",
)
def stream_window_counts(t):
    events = t.stream_view("v_job_events").withColumn("at", F.timestamp_micros("at_us"))
    return op.drain(op.windowed_counts(events, "at", "1 hour"), "windows")


@query(
    "stream_prefix_watch", "O-DCL9",
    with_views("v_kv_writes") + "SELECT key, pos, op FROM v_kv_writes WHERE namespace = 'users' AND starts_with(key, '1')",
)
def stream_prefix_watch(t):
    return op.drain(op.watch_prefix(t.stream_view("v_kv_writes"), "users", "1").select("key", "pos", "op"), "watch")


@query("live_after_replay", "O-SET2 O-STM9", SQL["stream_job_view"])
def live_after_replay(t):
    """Job views of a stream that starts from the replayed first half and overlaps it by a tenth."""
    end = t.v_transitions.agg(F.max("pos")).first()[0] or 0
    replayed = cut(op.replayed_states(t.v_transitions.filter(F.col("pos") < end // 2)), "replayed")
    tail = t.stream_view("v_transitions").filter(F.col("pos") >= end * 4 // 10)
    deltas = op.drain(op.state_delta_stream(tail, replayed), "live")
    before = replayed.select("job_id", "state", F.lit(1).cast("bigint").alias("delta"))
    return before.unionByName(deltas).groupBy("job_id", "state").agg(F.sum("delta").alias("n")).filter("n <> 0")


@query(
    "stream_journal_tail", "O-SRC3 O-SNK1",
    with_views("v_transitions")
    + "SELECT cast(job_id AS string) AS job_id, to_state, count(*) AS n FROM v_transitions GROUP BY 1, 2",
)
def stream_journal_tail(t):
    path = scratch_path(t.spark, "journal")
    journal.append_journal(journal_records(t)[0], path)
    tail = journal.tail_journal(t.spark, path).select("job_id", F.col("transition.to").alias("to_state"))
    return op.drain(tail, "journal-tail").groupBy("job_id", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_journal_order", "O-SRC3 O-SNK1 O-UDF6",
    with_views("v_transitions")
    + f"""SELECT cast(job_id AS string) AS job_id, pos * {APPENDS} // (SELECT max(pos) + 1 FROM v_transitions) + 1 AS append, count(*) AS n
    FROM v_transitions GROUP BY ALL""",
)
def stream_journal_order(t):
    """Whole appends in their order, from the journal as a stream."""
    tail = ordered_journal.tail(t.spark, appended_moves(t)).select("job_id", "append")
    return op.drain(tail, "journal-order").groupBy("job_id", "append").agg(F.count(F.lit(1)).alias("n"))
