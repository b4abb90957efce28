"""Monitoring, constraint audit and inference queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions import text as tx
from runledger.functions.text import SPACE_RE2
from runledger.operators import audit, inference, lifecycle, queueing, usage
from runledger.operators import monitor as op
from runledger.plans.lifecycle import COUNTS, group_case
from runledger.plans.queueing import AS_OF, PLACE, QUEUE_STATS, tagged_queue
from runledger.plans.registry import query, with_views
from runledger.plans.usage import _USAGE

_FIN = "('completed', 'partially_completed', 'failed', 'cancelled', 'rejected')"


def _queue_row(t):
    rows = tagged_queue(t).withColumn("_all", F.lit(1))
    return queueing.queue_statistics(rows, ["_all"], AS_OF).drop("_all")


def _usage_row(t):
    return usage.usage_rollup(t.v_model_calls.withColumn("_all", F.lit(1)), ["_all"]).filter("level = 1").drop("_all", "level")


@query(
    "metrics_snapshot",
    "O-AGG8",
    with_views("v_queue", "v_model_calls", "v_jobs", "v_agents")
    + f""", q AS (SELECT {QUEUE_STATS} FROM (SELECT *, {PLACE} AS p FROM v_queue) x), u AS (SELECT {_USAGE} FROM v_model_calls),
  s(status) AS (VALUES """ + ", ".join(f"('{s}')" for s in fixed.JOB_STATUS_SHOWN) + f""")
  SELECT metric, type, '' AS label, cast(value AS double) AS value FROM (
    SELECT 'jobs_active' AS metric, 'gauge' AS type, (SELECT count(*) FROM v_jobs WHERE status NOT IN {_FIN}) AS value
    UNION ALL SELECT 'queue_ready', 'gauge', ready FROM q UNION ALL SELECT 'queue_delayed', 'gauge', delayed FROM q
    UNION ALL SELECT 'queue_leased', 'gauge', leased FROM q UNION ALL SELECT 'dead_letter_depth', 'gauge', dead_lettered FROM q
    UNION ALL SELECT 'cluster_agents', 'gauge', (SELECT count(*) FROM v_agents)
    UNION ALL SELECT 'tasks_enqueued_total', 'counter', enqueued_total FROM q
    UNION ALL SELECT 'tasks_acknowledged_total', 'counter', 0 UNION ALL SELECT 'tasks_retried_total', 'counter', 0
    UNION ALL SELECT 'leases_expired_total', 'counter', 0
    UNION ALL SELECT 'model_requests_total', 'counter', requests FROM u
    UNION ALL SELECT 'model_cache_hits_total', 'counter', cache_hits FROM u
    UNION ALL SELECT 'model_failures_total', 'counter', failures FROM u
    UNION ALL SELECT 'tokens_in_total', 'counter', tokens_in FROM u UNION ALL SELECT 'tokens_out_total', 'counter', tokens_out FROM u
    UNION ALL SELECT 'cost_usd_total', 'counter', cost_micro_usd::DOUBLE / 1000000 FROM u) m
  UNION ALL SELECT 'jobs_total', 'gauge', 'status=' || s.status, cast(count(j.job_id) AS double)
    FROM s LEFT JOIN v_jobs j ON j.status = s.status GROUP BY s.status""",
)
def metrics_snapshot(t):
    queue, used = _queue_row(t), _usage_row(t)
    sources = {
        "jobs": t.v_jobs.agg(F.count_if(op.active(F.col("status"))).alias("jobs_active")),
        "agents": t.v_agents.agg(F.count(F.lit(1)).alias("cluster_agents")),
        "queue": queue.selectExpr(
            "ready AS queue_ready", "delayed AS queue_delayed", "leased AS queue_leased",
            "dead_lettered AS dead_letter_depth", "enqueued_total AS tasks_enqueued_total",
        ),
        "usage": used.selectExpr(
            "requests AS model_requests_total", "cache_hits AS model_cache_hits_total", "failures AS model_failures_total",
            "tokens_in AS tokens_in_total", "tokens_out AS tokens_out_total", "cost_micro_usd / 1000000D AS cost_usd_total",
        ),
    }
    return op.metrics_snapshot(t.spark, sources, t.v_jobs)


@query(
    "job_views",
    "O-AGG9 O-SRT4",
    with_views("v_jobs", "v_tasks", "v_results")
    + f""", ct AS ({COUNTS} FROM (SELECT *, {group_case()} AS g FROM v_tasks) x GROUP BY job_id),
  s AS (SELECT job_id, cast(sum(tokens_in + tokens_out) AS bigint) AS tokens_used,
    cast(sum(tokens_in * 3 + tokens_out * 15) AS bigint) AS cost_micro_usd, count(DISTINCT agent_id) AS active_agents
    FROM v_results GROUP BY job_id)
  SELECT j.job_id, strategy, status, completed, abandoned, total, (completed + abandoned) / total AS progress,
    tokens_used, cost_micro_usd, active_agents FROM v_jobs j JOIN ct ON ct.job_id = j.job_id JOIN s ON s.job_id = j.job_id""",
)
def job_views(t):
    stats = usage.execution_statistics(t.v_results, t.v_failures, t.v_tasks)
    agents = t.v_results.select("job_id", "agent_id").distinct()
    out = op.job_views(t.v_jobs, lifecycle.lifecycle_counts(t.v_tasks), stats, agents)
    return out.select(
        "job_id", "strategy", "status", "completed", "abandoned", "total", "progress", "tokens_used", "cost_micro_usd",
        "active_agents",
    )


@query(
    "cluster_view",
    "O-AGG10",
    with_views("v_jobs", "v_queue", "v_model_calls", "v_agents")
    + f""", q AS (SELECT {QUEUE_STATS} FROM (SELECT *, {PLACE} AS p FROM v_queue) x),
  u AS (SELECT {_USAGE} FROM v_model_calls)
  SELECT (SELECT count(*) FROM v_jobs WHERE status NOT IN {_FIN}) AS jobs_active, (SELECT count(*) FROM v_jobs) AS jobs_total,
    q.*, u.*, (SELECT count(*) FROM v_agents) AS cluster_agents FROM q, u""",
)
def cluster_view(t):
    return op.cluster_view(t.v_jobs, _queue_row(t), _usage_row(t), t.v_agents)


@query(
    "event_gaps",
    "O-WIN13",
    with_views("v_job_events")
    + """SELECT job_id, prev + 1 AS from_seq, seq - 1 AS to_seq FROM (SELECT job_id, seq,
    lag(seq) OVER (PARTITION BY job_id ORDER BY seq) AS prev FROM v_job_events) x WHERE seq - prev > 1""",
)
def event_gaps(t):
    return op.event_gaps(t.v_job_events)


@query(
    "live_and_replayed",
    "O-SET2",
    with_views("v_job_events") + "SELECT job_id, seq, kind FROM v_job_events",
)
def live_and_replayed(t):
    e = t.v_job_events.select("job_id", "seq", "kind")
    return op.union_once(e.filter("kind <> 'task_failed'"), e)


@query(
    "events_after",
    "O-STM10 batch replay",
    with_views("v_job_events")
    + """SELECT job_id, seq, kind FROM v_job_events WHERE seq > 5000 AND kind IN ('task_completed', 'task_failed')""",
)
def events_after(t):
    return op.events_after(t.v_job_events, 5000, ["task_completed", "task_failed"]).select("job_id", "seq", "kind")


@query(
    "artifact_index",
    "O-SRC6",
    with_views("v_tasks", "v_results", "v_failures")
    + """SELECT job_id, count(*) AS n, 'graph' AS artifact FROM v_tasks GROUP BY job_id
  UNION ALL SELECT job_id, count(*), 'results' FROM v_results GROUP BY job_id
  UNION ALL SELECT job_id, count(*), 'failures' FROM v_failures GROUP BY job_id""",
)
def artifact_index(t):
    return op.artifact_index(graph=t.v_tasks, results=t.v_results, failures=t.v_failures)


@query(
    "constraint_audit",
    "O-AGG14",
    with_views("v_queue", "v_attempts", "v_edges")
    + """SELECT 'jobs' AS table_name, 'unique job_id,idempotency_key' AS rule, job_id || '/' || idempotency_key AS key, count(*) AS n
    FROM v_queue GROUP BY job_id, idempotency_key HAVING count(*) > 1
  UNION ALL SELECT 'task_attempts', 'unique task_id,attempt', task_id || '/' || (pos % 64), count(*) FROM v_attempts
    GROUP BY task_id, pos % 64 HAVING count(*) > 1
  UNION ALL SELECT 'tasks', 'attempt <= max_attempts + 1', cast(task_id AS string), 1 FROM v_queue WHERE attempt > 2
  UNION ALL SELECT 'jobs', 'priority between 0 and 2', cast(task_id AS string), 1 FROM v_queue WHERE priority > 2
  UNION ALL SELECT 'votes', 'confidence between 0 and 1', cast(l_orderkey * 10 + l_linenumber AS string), 1 FROM lineitem
    WHERE l_quantity / 40 > 1
  UNION ALL SELECT 'task_dependencies', 'child <> parent', cast(child AS string), 1 FROM v_edges WHERE child = parent
  UNION ALL SELECT 'tasks', 'references o_custkey', cast(o_custkey AS string), count(*) FROM orders WHERE o_custkey NOT IN
    (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
)
def constraint_audit(t):
    votes = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 40).alias("c"))
    attempts = t.v_attempts.select("task_id", (F.col("pos") % 64).alias("attempt"))
    return audit.violations(
        audit.unique(t.v_queue, "jobs", ["job_id", "idempotency_key"]),
        audit.unique(attempts, "task_attempts", ["task_id", "attempt"]),
        audit.check(t.v_queue, "tasks", "attempt <= max_attempts + 1", F.col("attempt") <= 2, "task_id"),
        audit.check(t.v_queue, "jobs", "priority between 0 and 2", F.col("priority").between(0, 2), "task_id"),
        audit.check(votes, "votes", "confidence between 0 and 1", F.col("c").between(0, 1), "id"),
        audit.check(t.v_edges, "task_dependencies", "child <> parent", F.col("child") != F.col("parent"), "child"),
        audit.references(t.orders, "tasks", "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"),
    )


# --- requests and inference ------------------------------------------------------------

_LANE = "('0x' || substr(md5(said), {0}, 15))::BIGINT"
_PRINTS = f"""WITH m AS (SELECT conv_id AS request_id, 'm' || cast(conv_id % 3 AS string) AS model, conv_id % 2 = 0 AS json_mode,
      cast(turn AS string) || chr(31) || role || chr(31) || text AS said, text FROM conversations),
  g AS (SELECT request_id, model, json_mode, bit_xor({_LANE.format(1)}) AS h1, bit_xor({_LANE.format(16)}) AS h2, count(*) AS n
      FROM m GROUP BY request_id, model, json_mode),
  f AS (SELECT request_id, model, json_mode, md5(model || chr(31) || cast(json_mode AS string) || chr(31)
      || h1 || chr(31) || h2 || chr(31) || n) AS fingerprint FROM g) """


def _params(t):
    return t.conversations.select(
        F.col("conv_id").alias("request_id"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        (F.col("conv_id") % 2 == 0).alias("json_mode"),
    ).distinct()


@query("request_fingerprints", "O-PRJ6", _PRINTS + "SELECT * FROM f")
def request_fingerprints(t):
    return inference.fingerprints(t.v_messages, _params(t))


def _answer(prompts: pd.Series) -> pd.Series:
    """Stand-in for a model call: a deterministic function of the prompt."""
    return "answer to " + prompts.str.len().astype(str) + " characters"


@query(
    "batch_inference",
    "O-UDF1 O-PRJ6 O-PRJ11",
    rf"""WITH p AS (SELECT doc_id AS request_id, text AS prompt, md5(text) AS fingerprint,
      len(list_filter(regexp_split_to_array(text, '{SPACE_RE2}'), lambda w: w <> '')) AS tokens_in FROM documents),
    f AS (SELECT fingerprint, min(request_id) AS first FROM p GROUP BY 1)
    SELECT request_id, 'answer to ' || length(prompt) || ' characters' AS answer, request_id <> first AS cached,
      CASE WHEN request_id <> first THEN 0 ELSE tokens_in * 3 + 4 * 15 END AS cost_micro_usd
    FROM p JOIN f ON p.fingerprint = f.fingerprint""",
)
def batch_inference(t):
    requests = t.documents.select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"), F.md5("text").alias("fingerprint")
    )
    answered = inference.answer_batch(requests, _answer)
    counted = answered.withColumn("tokens_in", tx.word_count(F.col("prompt")).cast("bigint")).withColumn(
        "tokens_out", tx.word_count(F.col("answer")).cast("bigint")
    )
    return inference.priced(counted).select("request_id", "answer", "cached", "cost_micro_usd")


_PROVIDERS = [("east", 1, "m0"), ("west", 2, "m0"), ("west", 2, "m1")]


@query(
    "model_routes",
    "O-JN12",
    with_views("v_model_calls")
    + """SELECT model, CASE model WHEN 'm0' THEN 'east' WHEN 'm1' THEN 'west' ELSE '' END AS provider,
    CASE model WHEN 'm2' THEN 'no provider serves model `m2`' ELSE '' END AS error, count(*) AS n FROM v_model_calls GROUP BY model""",
)
def model_routes(t):
    providers = fixed.values_table(t.spark, "provider, ord, model", _PROVIDERS)
    routed = inference.route_models(t.v_model_calls.select("model"), providers)
    return routed.groupBy("model", F.coalesce("provider", F.lit("")).alias("provider"), "error").agg(
        F.count(F.lit(1)).alias("n")
    )
