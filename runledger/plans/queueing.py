"""Queue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import queueing as op
from runledger.plans.registry import query, with_views

AS_OF = 883612800000000  # 1998-01-01
Q = with_views("v_queue")


@query(
    "priority_top_k",
    "O-WIN4",
    Q + f"""SELECT * FROM (SELECT queue, task_id, priority, cast(row_number() OVER (PARTITION BY queue
    ORDER BY priority DESC, enqueued_us, task_id) AS int) AS rank FROM v_queue
    WHERE available_us <= {AS_OF}) x WHERE rank <= 10""",
)
def priority_top_k(t):
    return op.top_k(t.v_queue, 10, AS_OF).select("queue", "task_id", "priority", "rank")


@query(
    "eligible_top_k",
    "O-WIN4 O-PRJ7",
    Q + f"""SELECT * FROM (SELECT queue, task_id, required, cast(row_number() OVER (PARTITION BY queue
    ORDER BY priority DESC, enqueued_us, task_id) AS int) AS rank FROM v_queue
    WHERE available_us <= {AS_OF} AND required IN ('research', 'review') AND queue IN ('O', 'F')) x
    WHERE rank <= 5""",
)
def eligible_top_k(t):
    return op.top_k(t.v_queue, 5, AS_OF, ["research", "review"], ["O", "F"]).select(
        "queue", "task_id", "required", "rank"
    )


@query(
    "rank_pairing",
    "O-JN8",
    with_views("v_queue", "v_agents")
    + f""", w AS (SELECT agent_id AS worker, queue, row_number() OVER (PARTITION BY queue ORDER BY agent_id) AS rank
      FROM (SELECT agent_id, CASE agent_id % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS queue
            FROM v_agents WHERE status = 'idle') a),
  e AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, enqueued_us, task_id) AS rank
      FROM v_queue WHERE available_us <= {AS_OF})
  SELECT w.queue, w.worker, e.task_id FROM w JOIN e ON w.queue = e.queue AND w.rank = e.rank""",
)
def rank_pairing(t):
    queue = F.when(F.col("agent_id") % 3 == 0, "O").when(F.col("agent_id") % 3 == 1, "F").otherwise("P")
    idle = t.v_agents.filter("status = 'idle'").select(F.col("agent_id").alias("worker"), queue.alias("queue"))
    return op.pair_with_workers(t.v_queue, idle, AS_OF).select("queue", "worker", "task_id")


@query(
    "enqueue_dedup",
    "O-SET1",
    Q + """SELECT job_id, min_by(task_id, task_id) AS task_id, idempotency_key,
    arg_min(priority, task_id) AS priority FROM v_queue GROUP BY job_id, idempotency_key""",
)
def enqueue_dedup(t):
    rows = t.v_queue.select("job_id", "idempotency_key", "task_id", "priority")
    return op.first_per_key(rows, ["job_id", "idempotency_key"], "task_id")


@query(
    "enqueue_counts",
    "O-SET1",
    Q + """SELECT queue, count(*) AS enqueued, cast(sum(n - 1) AS bigint) AS deduplicated FROM (
    SELECT queue, idempotency_key, count(*) AS n FROM v_queue GROUP BY 1, 2) x GROUP BY queue""",
)
def enqueue_counts(t):
    return op.enqueue_counts(t.v_queue, "idempotency_key", ["queue"])


_SHIFT = "least(20, greatest(a - 1, 0))"


@query(
    "retry_backoff",
    "O-PRJ10",
    f"""WITH x AS (SELECT l_orderkey AS task_id, l_linenumber AS line, l_partkey % 25 AS a,
      l_suppkey % 3 * 250 AS base, cast(60000 AS bigint) AS cap, l_partkey AS nonce, l_linenumber % 2 = 0 AS jitter
      FROM lineitem),
    c AS (SELECT *, least(base * (1::BIGINT << {_SHIFT}::INT), cap) AS capped,
      CASE WHEN a > 20 THEN least(base * (1::BIGINT << 20), cap)
           ELSE least(base * (1::BIGINT << {_SHIFT}::INT), cap) END AS k FROM x)
    SELECT a AS attempt, base, jitter, count(*) AS n, cast(sum(w) AS bigint) AS total_wait_ms, max(w) AS longest_ms,
      a < 3 AS may_retry FROM (
      SELECT *, CASE WHEN base = 0 THEN 0 WHEN jitter AND k > 0
        THEN k // 2 + nonce % (k - k // 2 + 1) ELSE k END AS w FROM c) y
    GROUP BY a, base, jitter""",
)
def retry_backoff(t):
    x = t.lineitem.select(
        (F.col("l_partkey") % 25).alias("attempt"),
        (F.col("l_suppkey") % 3 * 250).alias("base"),
        (F.col("l_linenumber") % 2 == 0).alias("jitter"),
        F.col("l_partkey").alias("nonce"),
    )
    wait = op.backoff_ms(
        F.col("attempt"), F.col("base"), F.lit(60000).cast("bigint"), F.col("jitter"), F.col("nonce")
    )
    return (
        x.withColumn("w", wait)
        .groupBy("attempt", "base", "jitter")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("w").alias("total_wait_ms"),
            F.max("w").alias("longest_ms"),
        )
        .withColumn("may_retry", F.col("attempt") < fixed.RETRY_MAX_ATTEMPTS)
    )


@query(
    "retry_or_park",
    "O-STM3",
    with_views("v_attempts")
    + """, f AS (SELECT *, pos % 5 AS attempt FROM v_attempts WHERE NOT ok),
  b AS (SELECT *, least(500 * (1::BIGINT << greatest(attempt - 1, 0)::INT), 60000) AS k FROM f),
  w AS (SELECT *, CASE WHEN attempt < 3 THEN k // 2 + (at_us % 1000000) % (k - k // 2 + 1) ELSE 0 END AS wait_ms FROM b)
  SELECT pos, CASE WHEN attempt < 3 THEN 'retry' ELSE 'park' END AS decision, wait_ms,
    CASE WHEN attempt < 3 THEN at_us + wait_ms * 1000 ELSE 0 END AS due_us,
    CASE WHEN attempt < 3 THEN '' ELSE 'failure ' || cast(attempt AS string) END AS last_error FROM w""",
)
def retry_or_park(t):
    failed = t.v_attempts.filter(~F.col("ok")).select(
        "pos", (F.col("pos") % 5).alias("attempt"), F.col("at_us").alias("failed_us"),
        F.concat(F.lit("failure "), (F.col("pos") % 5).cast("string")).alias("reason"),
    )
    return op.retry_or_park(failed).select("pos", "decision", "wait_ms", "due_us", "last_error")


@query(
    "dead_letter_replay",
    "O-STM4",
    Q + """, d AS (SELECT * FROM v_queue WHERE attempt = 3),
  c AS (SELECT * FROM d WHERE priority >= 2)
  SELECT 'queue' AS place, queue, count(*) AS n, cast(sum(attempt) AS bigint) AS attempts,
    count(*) FILTER (WHERE available_us = 900000000000000) AS available_now FROM (
    SELECT queue, attempt, available_us FROM v_queue WHERE attempt < 3
    UNION ALL SELECT queue, attempt, 900000000000000 FROM c) x GROUP BY queue
  UNION ALL SELECT 'dead', queue, count(*), cast(sum(attempt) AS bigint), cast(0 AS bigint)
  FROM d WHERE priority < 2 GROUP BY queue""",
)
def dead_letter_replay(t):
    dead, live = t.v_queue.filter("attempt = 3"), t.v_queue.filter("attempt < 3")
    queue, left = op.replay_dead_letters(live, dead, dead.filter("priority >= 2"), 900_000_000_000_000)
    both = queue.withColumn("place", F.lit("queue")).unionByName(left.withColumn("place", F.lit("dead")))
    now = F.count_if((F.col("place") == "queue") & (F.col("available_us") == 900_000_000_000_000))
    return both.groupBy("place", "queue").agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempt").alias("attempts"), now.alias("available_now")
    )


PLACE = "CASE attempt WHEN 3 THEN 'dead' WHEN 2 THEN 'leased' ELSE 'ready' END"


def tagged_queue(t):
    return t.v_queue.withColumn("place", F.expr(PLACE))


QUEUE_STATS = f"""count(*) FILTER (WHERE p = 'ready' AND available_us <= {AS_OF}) AS ready,
    count(*) FILTER (WHERE p = 'ready' AND available_us > {AS_OF}) AS delayed,
    count(*) FILTER (WHERE p = 'leased') AS leased, count(*) FILTER (WHERE p = 'dead') AS dead_lettered,
    count(*) AS enqueued_total, count(*) FILTER (WHERE p <> 'dead') AS depth"""


@query(
    "queue_statistics",
    "O-AGG7",
    Q + f"SELECT queue, {QUEUE_STATS} FROM (SELECT *, {PLACE} AS p FROM v_queue) x GROUP BY queue",
)
def queue_statistics(t):
    return op.queue_statistics(tagged_queue(t), ["queue"], AS_OF)


@query(
    "job_purge",
    "O-JN9",
    Q + """, d AS (SELECT c_custkey AS job_id FROM customer WHERE c_acctbal < 0)
  SELECT job_id, count(*) AS purged FROM v_queue WHERE job_id IN (SELECT job_id FROM d) GROUP BY job_id""",
)
def job_purge(t):
    doomed = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("job_id"))
    return op.purge_counts(t.v_queue, doomed)


@query(
    "after_purge",
    "O-JN9",
    Q + """SELECT queue, count(*) AS n FROM v_queue WHERE job_id NOT IN (SELECT c_custkey FROM customer
    WHERE c_acctbal < 0) GROUP BY queue""",
)
def after_purge(t):
    doomed = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("job_id"))
    return op.purge_jobs(t.v_queue, doomed).groupBy("queue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "leasable_deliveries",
    "O-JN11",
    with_views("v_lease_events", "v_transitions")
    + """, s AS (SELECT task_id, arg_max(to_state, pos) AS state FROM v_transitions GROUP BY task_id)
  SELECT task_id, pos, op FROM v_lease_events WHERE task_id IN (
    SELECT task_id FROM s WHERE state IN ('queued', 'retry_scheduled'))""",
)
def leasable_deliveries(t):
    states = t.v_transitions.groupBy("task_id").agg(F.max_by("to_state", "pos").alias("state"))
    return op.leasable(t.v_lease_events, states).select("task_id", "pos", "op")


@query(
    "stored_results",
    "O-JN10",
    with_views("v_attempts")
    + """, f AS (SELECT task_id, arg_min(pos, pos) AS stored FROM v_attempts WHERE ok GROUP BY task_id)
  SELECT a.task_id, a.pos, coalesce(stored, -1) AS stored_result, stored IS NOT NULL AS deduplicated
  FROM v_attempts a LEFT JOIN f ON a.task_id = f.task_id WHERE NOT ok""",
)
def stored_results(t):
    published = t.v_attempts.filter("ok").withColumn("result_id", F.col("pos"))
    out = op.serve_stored(t.v_attempts.filter("NOT ok").select("task_id", "pos"), published)
    return out.withColumn("stored_result", F.coalesce("stored_result", F.lit(-1)))


@query(
    "time_predicates",
    "O-PRJ8",
    Q + f""", x AS (SELECT queue, available_us <= {AS_OF} AS visible,
      available_us + priority * 86400000000 <= {AS_OF} AS expired,
      CASE WHEN attempt = 0 THEN NULL ELSE enqueued_us + 30 * 86400000000 END AS deadline_us,
      enqueued_us, priority FROM v_queue)
  SELECT queue, count(*) FILTER (WHERE visible) AS visible, count(*) FILTER (WHERE expired) AS expired,
    count(*) FILTER (WHERE coalesce(deadline_us <= {AS_OF}, false) OR (enqueued_us <= {AS_OF}
      AND ({AS_OF} - enqueued_us) // 1000000 >= priority * 10000000)) AS overdue
  FROM x GROUP BY queue""",
)
def time_predicates(t):
    deadline = F.when(F.col("attempt") != 0, F.col("enqueued_us") + 30 * 86_400_000_000)
    overdue = op.past_deadline(deadline, F.col("enqueued_us"), F.col("priority") * 10_000_000, AS_OF)
    expires = F.col("available_us") + F.col("priority").cast("bigint") * 86_400_000_000
    return t.v_queue.groupBy("queue").agg(
        F.count_if(op.is_visible(AS_OF)).alias("visible"),
        F.count_if(op.is_past(expires, AS_OF)).alias("expired"),
        F.count_if(overdue).alias("overdue"),
    )


@query(
    "idle_agents",
    "O-WIN15",
    with_views("v_agents")
    + """, s AS (SELECT *, status IN ('idle', 'registered') AND last_active_us < 1700000090000000 AS stale
      FROM v_agents WHERE pool < 2 OR status IN ('idle', 'registered')),
  p AS (SELECT *, count(*) OVER (PARTITION BY pool) AS size,
      count(*) FILTER (WHERE stale) OVER (PARTITION BY pool) AS n_stale,
      max(CASE WHEN stale THEN agent_id END) OVER (PARTITION BY pool) AS last_stale FROM s)
  SELECT pool, agent_id FROM p WHERE stale AND NOT (size = n_stale AND agent_id = last_stale)""",
)
def idle_agents(t):
    pools = t.v_agents.filter((F.col("pool") < 2) | F.col("status").isin(fixed.AGENT_AVAILABLE))
    return op.idle_agents(pools, 1_700_000_090_000_000, F.lit(0))
