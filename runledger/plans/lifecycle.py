"""Lifecycle reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import lifecycle as op
from runledger.operators import usage
from runledger.plans.registry import query, with_views


def _in(states: list[str]) -> str:
    return "(" + ", ".join(f"'{s}'" for s in states) + ")"


def group_case(state: str = "state") -> str:
    whens = " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in fixed.TASK_GROUP.items())
    return f"CASE {state} {whens} END"


LAST = """last AS (
  SELECT job_id, task_id, to_state AS state, attempt FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, task_id ORDER BY pos DESC) AS rn
    FROM v_transitions) r WHERE rn = 1)"""

COUNTS = """SELECT job_id,
  count(*) FILTER (WHERE g = 'pending') AS pending, count(*) FILTER (WHERE g = 'queued') AS queued,
  count(*) FILTER (WHERE g = 'in_flight') AS in_flight,
  count(*) FILTER (WHERE g = 'completed') AS completed,
  count(*) FILTER (WHERE g = 'retrying') AS retrying,
  count(*) FILTER (WHERE g = 'abandoned') AS abandoned, count(*) AS total"""

COUNTS_SQL = (
    with_views("v_transitions")
    + f", {LAST}, c AS ({COUNTS} FROM (SELECT *, {group_case()} AS g FROM last) x GROUP BY job_id) "
)


@query(
    "latest_state",
    "O-WIN1",
    with_views("v_transitions")
    + f", {LAST} SELECT job_id, task_id, state, attempt, CASE WHEN state IN "
    f"{_in(fixed.TASK_TERMINAL)} THEN state ELSE 'created' END AS resume_state FROM last",
)
def latest_state(t):
    return op.latest_state(t.v_transitions)


AS_OF_US = 1705276800000000  # 2024-01-15


@query(
    "state_as_of",
    "O-WIN1 bounded by time",
    with_views("v_transitions")
    + f""", last AS (
  SELECT job_id, task_id, to_state AS state, attempt FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, task_id ORDER BY pos DESC) AS rn
    FROM v_transitions WHERE at_us <= {AS_OF_US}) r WHERE rn = 1)
  SELECT job_id, task_id, state, attempt FROM last""",
)
def state_as_of(t):
    return op.latest_state(t.v_transitions, AS_OF_US).drop("resume_state")


@query(
    "lifecycle_counts",
    "O-AGG1 O-AGG2 O-AGG11",
    COUNTS_SQL
    + """SELECT *, (completed + abandoned) / total AS progress,
  completed + abandoned = total AS is_complete,
  CASE WHEN abandoned = 0 AND completed = total THEN 'completed'
       WHEN completed > 0 THEN 'partially_completed' ELSE 'failed' END AS verdict FROM c""",
)
def lifecycle_counts(t):
    return op.job_verdict(op.lifecycle_counts(op.latest_state(t.v_transitions)), F.lit(False))


@query(
    "run_overview",
    "O-WIN1 O-AGG1 O-AGG2 O-AGG3",
    COUNTS_SQL
    + """, p AS (SELECT job_id, quantile_disc(latency_ms, 0.5) AS p50_ms,
    quantile_disc(latency_ms, 0.95) AS p95_ms, quantile_disc(latency_ms, 0.99) AS p99_ms
  FROM (SELECT user_id % 20 AS job_id, cast(floor(value * 10) AS bigint) AS latency_ms FROM events)
  GROUP BY job_id)
  SELECT c.*, (completed + abandoned) / total AS progress,
    completed + abandoned = total AS is_complete, p50_ms, p95_ms, p99_ms
  FROM c JOIN p ON c.job_id = p.job_id""",
)
def run_overview(t):
    counts = op.lifecycle_counts(op.latest_state(t.v_transitions))
    return counts.join(usage.latency_percentiles(t.v_attempts, ["job_id"]), "job_id")


_EDGE_ROWS = ", ".join(
    f"('{e}', '{a}', '{b}')" for e, m in fixed.STATE_EDGES.items() for a, bs in m.items() for b in bs
)


@query(
    "transition_audit",
    "O-WIN2 O-UDF5",
    with_views("v_transitions")
    + f""", edge(entity, a, b) AS (VALUES {_EDGE_ROWS}),
  w AS (SELECT *, lag(to_state) OVER (PARTITION BY task_id ORDER BY pos) AS previous_state
        FROM v_transitions)
  SELECT task_id, pos, coalesce(previous_state, '') AS previous_state, to_state,
    previous_state IS NULL OR EXISTS (SELECT 1 FROM edge WHERE entity = 'task'
      AND a = previous_state AND b = to_state) AS legal,
    previous_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge WHERE entity = 'task'
      AND a = previous_state) AS after_terminal,
    from_state IS NOT DISTINCT FROM previous_state AS continuous FROM w""",
)
def transition_audit(t):
    out = op.audit_transitions(t.v_transitions, fixed.state_edges(t.spark), ["task_id"])
    return out.select(
        "task_id", "pos", F.coalesce("previous_state", F.lit("")).alias("previous_state"),
        "to_state", "legal", "after_terminal", "continuous",
    )


@query(
    "state_dwell",
    "O-WIN3",
    with_views("v_transitions")
    + """, w AS (SELECT *, lead(at_us) OVER (PARTITION BY task_id ORDER BY pos) AS left_us
         FROM v_transitions)
  SELECT to_state AS state, count(left_us) AS visits,
    cast(sum(greatest(0, (left_us - at_us) // 1000)) AS bigint) AS total_ms,
    cast(max(greatest(0, (left_us - at_us) // 1000)) AS bigint) AS longest_ms
  FROM w WHERE left_us IS NOT NULL GROUP BY to_state""",
)
def state_dwell(t):
    return (
        op.dwell(t.v_transitions, ["task_id"])
        .filter(F.col("left_us").isNotNull())
        .groupBy(F.col("to_state").alias("state"))
        .agg(
            F.count("left_us").alias("visits"),
            F.sum("dwell_ms").alias("total_ms"),
            F.max("dwell_ms").alias("longest_ms"),
        )
    )


@query(
    "queue_waits",
    "O-WIN3",
    with_views("v_queue")
    + """SELECT queue, count(*) AS n, cast(sum(greatest(0, (available_us - enqueued_us) // 1000)) AS bigint) AS wait_ms,
    cast(max(3600 * attempt * 1000) AS bigint) AS longest_held_ms FROM v_queue GROUP BY queue""",
)
def queue_waits(t):
    leases = t.v_queue.withColumn("granted_us", F.col("available_us")).withColumn(
        "released_us", F.col("available_us") + F.col("attempt").cast("bigint") * 3_600_000_000
    )
    return op.queue_waits(leases).groupBy("queue").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("queue_wait_ms").alias("wait_ms"),
        F.max("held_ms").alias("longest_held_ms"),
    )


@query(
    "state_classes",
    "O-PRJ9",
    with_views("v_tasks")
    + f"""SELECT job_id, {group_case()} AS state_group, state IN {_in(fixed.TASK_TERMINAL)} AS terminal,
    state IN ('leased', 'running') AS in_flight,
    kind IN {_in([k[0] for k in fixed.KINDS if k[4]])} AS reportable, count(*) AS n
    FROM v_tasks GROUP BY ALL""",
)
def state_classes(t):
    flagged = op.classify_states(t.v_tasks, fixed.kinds(t.spark))
    return flagged.groupBy("job_id", "state_group", "terminal", "in_flight", "reportable").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "cancellation_steps",
    "O-PRJ17",
    with_views("v_tasks")
    + f""", o AS (SELECT * FROM v_tasks WHERE state NOT IN {_in(fixed.TASK_TERMINAL)})
  SELECT job_id, task_id, cast(1 AS int) AS step, state AS from_state,
    CASE WHEN state = 'running' THEN 'failed' ELSE 'cancelled' END AS to_state,
    'job_cancelled' AS reason FROM o
  UNION ALL SELECT job_id, task_id, cast(2 AS int), 'failed', 'dead_lettered', 'job_cancelled'
  FROM o WHERE state = 'running'""",
)
def cancellation_steps(t):
    return op.cancellation_steps(t.v_tasks)
