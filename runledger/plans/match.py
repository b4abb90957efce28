"""Placement and reliability reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import match as op
from runledger.plans.registry import query, with_views

_TASKS = (
    with_views("v_dag_tasks", "v_agents")
    + ", k(kind, required) AS (VALUES " + ", ".join(f"('{k[0]}', {k[1]})" for k in fixed.KINDS)
    + """), t AS (SELECT task_id, CASE WHEN p_size % 10 = 0 THEN [] ELSE required END AS required
      FROM v_dag_tasks d JOIN k ON d.kind = k.kind),
  a AS (SELECT * FROM v_agents WHERE status IN ('idle', 'registered')),
  c AS (SELECT t.task_id, len(required) AS n_required, a.* FROM t JOIN a ON list_has_all(a.capabilities, t.required)) """
)


def tasks(t):
    kinds = fixed.kinds(t.spark).select("kind", F.col("required").alias("base"))
    empty = F.array().cast("array<string>")
    return t.v_dag_tasks.join(F.broadcast(kinds), "kind").select(
        "task_id", F.when(F.col("p_size") % 10 == 0, empty).otherwise(F.col("base")).alias("required")
    )


def pairs(t):
    return op.candidates(op.requirement_classes(tasks(t)), t.v_agents)


@query("candidate_counts", "O-JN2 O-PRJ7", _TASKS + "SELECT task_id, count(*) AS candidates FROM c GROUP BY task_id")
def candidate_counts(t):
    sizes = pairs(t).groupBy("class").agg(F.count(F.lit(1)).alias("candidates"))
    return op.place(tasks(t), sizes).filter("candidates > 0").select("task_id", "candidates")


@query(
    "candidate_agents",
    "O-JN2",
    _TASKS
    + """SELECT DISTINCT array_to_string(list_sort(required), ',') AS class, a.agent_id
    FROM t JOIN a ON list_has_all(a.capabilities, t.required)""",
)
def candidate_agents(t):
    return pairs(t).select("class", "agent_id")


@query(
    "least_loaded_pick",
    "O-WIN6",
    _TASKS
    + """SELECT task_id, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY current_load, latency_ms, agent_id) AS rn FROM c) x WHERE rn = 1""",
)
def least_loaded_pick(t):
    out = op.place(tasks(t), op.pick_least_loaded(pairs(t)))
    return out.filter("agent_id IS NOT NULL").select("task_id", "agent_id")


@query(
    "weighted_pick",
    "O-WIN7 O-UDF2",
    _TASKS
    + """SELECT task_id, agent_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY score DESC, agent_id DESC) AS rn FROM (SELECT *, 1.0::DOUBLE * (1.0::DOUBLE - greatest(0, least(1, current_load)))
      + 1.0::DOUBLE * greatest(0, least(1, success_rate)) + 0.5::DOUBLE * (1000.0::DOUBLE / (1000.0::DOUBLE + latency_ms))
      + 0.5::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + greatest(len(capabilities) - n_required, 0))) AS score FROM c) s) x
    WHERE rn = 1""",
)
def weighted_pick(t):
    scored = pairs(t).withColumn("score", op.score())
    picks = scored.groupBy("class").agg(
        F.max(F.struct("score", "agent_id")).alias("b")
    ).select("class", "b.agent_id", F.round("b.score", 6).alias("score"))
    return op.place(tasks(t), picks).filter("agent_id IS NOT NULL").select("task_id", "agent_id", "score")


@query(
    "round_robin",
    "O-WIN5",
    _TASKS
    + """, n AS (SELECT task_id, agent_id, row_number() OVER (PARTITION BY task_id ORDER BY agent_id) - 1 AS slot,
      count(*) OVER (PARTITION BY task_id) AS size, dense_rank() OVER (ORDER BY task_id) - 1 AS i FROM c)
  SELECT task_id, agent_id FROM n WHERE slot = i % size""",
)
def round_robin(t):
    return op.round_robin(tasks(t), pairs(t)).select("task_id", "agent_id")


@query(
    "agent_totals",
    "O-AGG15",
    with_views("v_attempts")
    + """SELECT agent_id, count(*) FILTER (WHERE ok) AS tasks_completed, count(*) FILTER (WHERE NOT ok) AS tasks_failed
    FROM v_attempts GROUP BY agent_id""",
)
def agent_totals(t):
    return op.agent_totals(t.v_attempts)


@query(
    "agent_reliability",
    "O-WIN8",
    with_views("v_attempts")
    + """SELECT agent_id, round(list_reduce(list(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY pos),
      lambda a, x: 0.8::DOUBLE * a + 0.2::DOUBLE * x, 1.0::DOUBLE), 6) AS success_rate,
    list_reduce(list(latency_ms ORDER BY pos), lambda a, x: CASE WHEN a = 0 THEN x ELSE (4 * a + x) // 5 END, 0::BIGINT)
      AS average_latency_ms FROM v_attempts GROUP BY agent_id""",
)
def agent_reliability(t):
    rate = op.success_ewma(t.v_attempts, ["agent_id"])
    both = rate.join(op.latency_ewma(t.v_attempts), "agent_id")
    return both.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "adaptive_weights",
    "O-WIN8",
    with_views("v_attempts")
    + """, s AS (SELECT job_id, list_reduce(list(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY pos),
      lambda a, x: 0.8::DOUBLE * a + 0.2::DOUBLE * x, 1.0::DOUBLE) AS s,
    list_reduce(list(latency_ms::DOUBLE ORDER BY pos), lambda a, x: 0.8::DOUBLE * a + 0.2::DOUBLE * x, 0.0::DOUBLE) AS w
    FROM v_attempts GROUP BY job_id)
  SELECT job_id, round(1 + (1 - s) * 3, 6) AS reliability, round(1 + least(w / 1000, 2), 6) AS load,
    round(0.5 + least(1 - s, 0.5), 6) AS latency FROM s""",
)
def adaptive_weights(t):
    out = op.adaptive_weights(t.v_attempts.withColumn("queue_wait_ms", F.col("latency_ms")), ["job_id"])
    return out.select("job_id", *[F.round(c, 6).alias(c) for c in ("reliability", "load", "latency")])
