"""Key/value, lease, journal and typed-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import graph, kv, leases, lifecycle, usage
from runledger.plans import graph as _graph_queries  # noqa: F401  (registered first)
from runledger.plans import usage as _usage_queries  # noqa: F401
from runledger.plans.registry import SQL, query, with_views
from runledger.session import cut, scratch_path
from runledger.sources import journal, ordered_journal, tables

AS_OF = 1706000000000000

FOLD = """, nx AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM v_kv_writes),
  st(key, n, pos, at_us, accepted, operation, actual, actor, audit_us, present, version, value, created, updated, exp, job) AS (
    SELECT key, 0::BIGINT, -1::BIGINT, 0::BIGINT, false, '', 0::BIGINT, '', 0::BIGINT, false, 0::BIGINT, 0::BIGINT, 0::BIGINT,
      0::BIGINT, -1::BIGINT, -1::BIGINT FROM (SELECT DISTINCT key FROM v_kv_writes) k
    UNION ALL
    SELECT key, n, pos, at_us, wr OR gone, CASE WHEN wr AND op = 'put' THEN CASE WHEN live THEN 'put' ELSE 'create' END
        WHEN wr THEN CASE WHEN present THEN 'compare_and_swap' ELSE 'create' END
        WHEN gone THEN CASE op WHEN 'delete' THEN 'delete' ELSE 'expire' END ELSE '' END,
      cur, CASE WHEN gone THEN CASE op WHEN 'delete' THEN 'unknown' ELSE 'system' END ELSE w_actor END,
      CASE WHEN gone THEN updated ELSE at_us END,
      CASE WHEN wr THEN true WHEN gone THEN false ELSE present END,
      CASE WHEN wr THEN cur + 1 ELSE version END, CASE WHEN wr THEN w_value ELSE value END,
      CASE WHEN wr THEN CASE WHEN live THEN created ELSE at_us END ELSE created END,
      CASE WHEN wr THEN at_us ELSE updated END,
      CASE WHEN wr THEN CASE WHEN ttl_ms >= 0 THEN at_us + ttl_ms * 1000 WHEN live THEN exp ELSE -1 END ELSE exp END,
      CASE WHEN wr THEN CASE WHEN w_job >= 0 THEN w_job WHEN live THEN job ELSE -1 END ELSE job END
    FROM (SELECT *, op = 'put' OR (op = 'cas' AND cur = expected) AS wr,
        (op = 'delete' AND present) OR (op = 'compact' AND present AND NOT live) AS gone FROM (
      SELECT *, CASE WHEN live THEN version ELSE 0 END AS cur FROM (
        SELECT st.key, nx.n, nx.pos, nx.at_us, nx.op, nx.expected, nx.ttl_ms, nx.value AS w_value, nx.job_id AS w_job,
          nx.actor AS w_actor, st.present, st.version, st.value, st.created, st.updated, st.exp, st.job,
          st.present AND (st.exp < 0 OR st.exp > nx.at_us) AS live
        FROM st JOIN nx ON nx.key = st.key AND nx.n = st.n + 1) a) b) c)"""
KV = with_views("v_kv_writes", recursive=True) + FOLD


def outcomes(t):
    return kv.write_outcomes(t.v_kv_writes)


@query(
    "kv_write_outcomes",
    "O-STM5 O-STM6",
    KV + " SELECT key, pos, accepted, actual AS actual_version FROM st WHERE n > 0",
)
def kv_write_outcomes(t):
    return outcomes(t).select("key", "pos", "accepted", "actual_version")


@query(
    "kv_records",
    "O-STM5",
    KV + """ SELECT key, version, value, created AS created_us, updated AS updated_us, exp AS expires_us, job AS job_id FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rn FROM st) x WHERE rn = 1 AND present""",
)
def kv_records(t):
    return kv.current_records(outcomes(t)).drop("namespace")


@query(
    "kv_audit",
    "O-STM7",
    KV + " SELECT key, pos, version, operation, actor, audit_us AS at_us FROM st WHERE accepted",
)
def kv_audit(t):
    return kv.audit_trail(outcomes(t)).drop("namespace")


@query(
    "kv_as_of",
    "O-STM8",
    KV + f""" SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rn FROM st
    WHERE at_us <= {AS_OF}) x WHERE rn = 1 AND present AND (exp < 0 OR exp > {AS_OF})""",
)
def kv_as_of(t):
    timed = outcomes(t).join(t.v_kv_writes.select("key", "pos", F.col("at_us").alias("event_us")), ["key", "pos"])
    return kv.read_as_of(timed, AS_OF).select("key", "version", "value")


@query(
    "kv_prefix_scan",
    "O-SRC5",
    """SELECT c_name AS key, cast(c_custkey AS bigint) AS version FROM customer WHERE c_mktsegment = 'BUILDING'
    AND starts_with(c_name, 'Customer#0000000') AND (c_acctbal < 0 OR c_acctbal > 1000)""",
)
def kv_prefix_scan(t):
    records = t.customer.select(
        F.col("c_mktsegment").alias("namespace"), F.col("c_name").alias("key"), F.col("c_custkey").alias("version"),
        F.col("c_acctbal").alias("expires_us"),
    )
    return kv.list_prefix(records, "BUILDING", "Customer#0000000", 1000).select("key", "version")


WAIT = "CASE WHEN attempt <= 1 THEN 500 WHEN attempt = 2 THEN 1000 ELSE 2000 END"
LEASES = with_views("v_lease_events", recursive=True) + f""", nx AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS n
      FROM v_lease_events),
  st(task_id, n, pos, outcome, cause, place, attempt, due) AS (
    SELECT task_id, 0::BIGINT, -1::BIGINT, '', '', 'ready', 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT task_id FROM v_lease_events) t
    UNION ALL
    SELECT task_id, n, pos, CASE WHEN raw <> 'failed' THEN raw WHEN attempt < max_attempts THEN 'requeued' ELSE 'parked' END,
      CASE WHEN raw <> 'failed' THEN '' WHEN op = 'sweep' THEN 'lease expired' WHEN op = 'ack' THEN 'lease expired before acknowledgement'
        ELSE 'rejected' END,
      CASE raw WHEN 'granted' THEN 'leased' WHEN 'acknowledged' THEN 'done' WHEN 'released' THEN 'ready'
        WHEN 'failed' THEN CASE WHEN attempt < max_attempts THEN 'ready' ELSE 'dead' END ELSE place END,
      CASE raw WHEN 'granted' THEN attempt + 1 WHEN 'released' THEN greatest(attempt - 1, 0) ELSE attempt END,
      CASE raw WHEN 'granted' THEN at_us + duration_ms * 1000 WHEN 'extended' THEN at_us + duration_ms * 1000
        WHEN 'acknowledged' THEN 0 WHEN 'released' THEN at_us
        WHEN 'failed' THEN CASE WHEN attempt < max_attempts THEN at_us + ({WAIT} // 2 + (at_us % 1000000 * 1000)
          % ({WAIT} - {WAIT} // 2 + 1)) * 1000 ELSE 0 END ELSE due END
    FROM (SELECT st.task_id, nx.n, nx.pos, nx.op, nx.at_us, nx.duration_ms, nx.max_attempts, st.place, st.attempt, st.due,
        CASE WHEN op = 'grant' THEN CASE WHEN place = 'ready' AND due <= at_us THEN 'granted' ELSE 'unavailable' END
          WHEN op = 'sweep' THEN CASE WHEN place = 'leased' AND due <= at_us THEN 'failed' ELSE 'nothing' END
          WHEN place <> 'leased' THEN 'unknown_lease'
          WHEN op = 'ack' THEN CASE WHEN due > at_us THEN 'acknowledged' ELSE 'failed' END
          WHEN op = 'reject' THEN 'failed' WHEN op = 'release' THEN 'released'
          WHEN op = 'extend' THEN CASE WHEN due <= at_us THEN 'extend_refused' ELSE 'extended' END END AS raw
      FROM st JOIN nx ON nx.task_id = st.task_id AND nx.n = st.n + 1) x)"""


@query(
    "lease_outcomes",
    "O-STM2",
    LEASES + " SELECT task_id, pos, outcome, cause, place, attempt, due AS due_us FROM st WHERE n > 0",
)
def lease_outcomes(t):
    return leases.lease_outcomes(t.v_lease_events)


@query(
    "lease_totals",
    "O-STM2 O-AGG7 totals",
    LEASES + " SELECT outcome, cause, count(*) AS n FROM st WHERE n > 0 GROUP BY ALL",
)
def lease_totals(t):
    return leases.lease_totals(leases.lease_outcomes(t.v_lease_events))


@query(
    "latest_checkpoint",
    "O-WIN9",
    with_views("v_attempts")
    + """SELECT task_id, attempt, seq, pos AS state FROM (SELECT *, row_number() OVER (PARTITION BY task_id
      ORDER BY attempt DESC, seq DESC) AS rn FROM (SELECT task_id, pos % 12 AS attempt, pos AS seq, pos FROM v_attempts) a) x
    WHERE rn = 1""",
)
def latest_checkpoint(t):
    points = t.v_attempts.select("task_id", (F.col("pos") % 12).alias("attempt"), F.col("pos").alias("seq"), "pos")
    last = points.groupBy("task_id").agg(F.max(F.struct("attempt", "seq", "pos")).alias("c"))
    return last.select("task_id", "c.attempt", "c.seq", F.col("c.pos").alias("state"))


# --- journal ------------------------------------------------------------------------


def _micros(column: str):
    return F.timestamp_micros(F.col(column))


def journal_records(t):
    """Journal lines derived from the tables: transitions, plans, status changes,
    results and failures."""
    moves = t.v_transitions.select(
        F.lit("task_transitioned").alias("record"), (F.col("pos") * 2).alias("seq"), F.col("job_id").cast("string").alias("job_id"),
        F.col("task_id").cast("string").alias("task_id"), "attempt",
        F.struct(
            F.lit("task").alias("entity"), F.col("from_state").alias("from"), F.col("to_state").alias("to"),
            F.lit("system").alias("actor"), _micros("at_us").alias("at"),
        ).alias("transition"),
    )
    plans = t.v_transitions.filter("job_id % 4 <> 3").select(F.col("job_id").cast("string").alias("id")).distinct()
    plans = plans.select(
        F.lit("job_planned").alias("record"),
        F.struct("id", F.lit("planning").alias("status"), F.struct(F.lit("parallel").alias("execution_strategy")).alias("request")).alias("job"),
    )
    changes = t.v_transitions.select(
        F.lit("job_status_changed").alias("record"), (F.col("pos") * 2 + 1).alias("seq"), F.col("job_id").cast("string").alias("job_id"),
        F.when(F.col("to_state") == "completed", "completed").otherwise("running").alias("status"), _micros("at_us").alias("at"),
    )
    done = t.v_results.select(
        F.lit("task_completed").alias("record"), "job_id",
        F.struct(
            F.col("task_id").cast("string").alias("task_id"), "kind", "title", "confidence", "tokens_in", "tokens_out",
            "duration_ms", "deduplicated",
        ).alias("result"),
    )
    failed = t.v_failures.select(
        F.lit("task_failed").alias("record"), "job_id",
        F.struct(F.col("task_id").cast("string").alias("task_id"), "attempt", "error_kind", "dead_lettered").alias("failure"),
    )
    return [moves, plans, changes, done, failed]


def written_journal(t):
    path = scratch_path(t.spark, "journal")
    for part in journal_records(t):
        journal.append_journal(part, path)
    return journal.read_journal(t.spark, path)


@query(
    "journal_kinds",
    "O-SRC1 O-SRC2 O-SNK1",
    with_views("v_transitions", "v_results", "v_failures")
    + """SELECT cast(job_id AS string) AS job_id, 'task_transitioned' AS kind, count(*) AS n FROM v_transitions GROUP BY 1
  UNION ALL SELECT cast(job_id AS string), 'job_planned', 1 FROM v_transitions WHERE job_id % 4 <> 3 GROUP BY 1
  UNION ALL SELECT cast(job_id AS string), 'job_status_changed', count(*) FROM v_transitions GROUP BY 1
  UNION ALL SELECT job_id, 'task_completed', count(*) FROM v_results GROUP BY 1
  UNION ALL SELECT job_id, 'task_failed', count(*) FROM v_failures GROUP BY 1""",
)
def journal_kinds(t):
    return written_journal(t).groupBy("job_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "journal_replay",
    "O-SRC1 O-SRC2 O-SNK1 O-WIN1",
    with_views("v_transitions")
    + """SELECT cast(job_id AS string) AS job_id, cast(task_id AS string) AS task_id, to_state AS state, attempt,
    CASE WHEN to_state IN ('completed', 'cancelled', 'dead_lettered') THEN to_state ELSE 'created' END AS resume_state FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id, task_id ORDER BY pos DESC) AS rn FROM v_transitions) x WHERE rn = 1""",
)
def journal_replay(t):
    moves = written_journal(t).filter("kind = 'task_transitioned'").select(
        "job_id", "task_id", F.col("transition.to").alias("to_state"), "attempt",
        F.col("seq").alias("pos"),
    )
    return lifecycle.latest_state(moves)


APPENDS = 3


def appended_moves(t):
    """A journal of all transitions in ``APPENDS`` appends, in order, with no sequence number in any record."""
    path = scratch_path(t.spark, "ordered-journal")
    end = F.broadcast(t.v_transitions.agg((F.max("pos") + 1).alias("end")))
    moves = t.v_transitions.join(end).withColumn("append", F.floor(F.col("pos") * APPENDS / F.col("end")))
    record = [
        F.lit("task_transitioned").alias("record"), F.col("job_id").cast("string").alias("job_id"), F.col("task_id").cast("string").alias("task_id"),
        "attempt", F.struct(F.lit("task").alias("entity"), F.col("from_state").alias("from"), F.col("to_state").alias("to"), F.lit("system").alias("actor")).alias("transition"),
    ]
    for k in range(APPENDS):
        ordered_journal.append(moves.filter(F.col("append") == k).orderBy("pos").select(*record), path)
    return path


@query(
    "journal_order",
    "O-SRC1 O-SNK1 O-UDF6",
    with_views("v_transitions")
    + """SELECT cast(job_id AS string) AS job_id, cast(task_id AS string) AS task_id, arg_max(to_state, pos) AS state, count(*) AS moves
    FROM v_transitions GROUP BY 1, 2""",
)
def journal_order(t):
    records = ordered_journal.read(t.spark, appended_moves(t))
    place = F.struct(*ordered_journal.PLACE)
    return records.groupBy("job_id", "task_id").agg(F.max_by("transition.to", place).alias("state"), F.count(F.lit(1)).alias("moves"))


@query(
    "journal_jobs",
    "O-WIN1 O-GRF10",
    with_views("v_transitions")
    + """, c AS (SELECT job_id, arg_max(CASE WHEN to_state = 'completed' THEN 'completed' ELSE 'running' END, pos) AS s
      FROM v_transitions GROUP BY job_id),
  l AS (SELECT job_id, task_id, arg_max(to_state, pos) AS state FROM v_transitions GROUP BY 1, 2),
  n AS (SELECT job_id, count(*) FILTER (WHERE state NOT IN ('completed', 'cancelled', 'dead_lettered')) AS n FROM l GROUP BY 1),
  j AS (SELECT DISTINCT job_id FROM v_transitions)
  SELECT cast(j.job_id AS string) AS job_id,
    CASE WHEN j.job_id % 4 = 3 THEN NULL WHEN s = 'completed' THEN s ELSE 'planning' END AS status,
    CASE WHEN j.job_id % 4 = 3 OR s = 'completed' THEN NULL ELSE 'recovered from journal, ' || n || ' tasks re-queued' END AS status_reason,
    CASE WHEN j.job_id % 4 = 3 THEN 'records for a job it never planned' END AS error
  FROM j LEFT JOIN c ON j.job_id = c.job_id JOIN n ON n.job_id = j.job_id WHERE j.job_id % 4 <> 3 OR c.job_id IS NOT NULL""",
)
def journal_jobs(t):
    records = written_journal(t)
    last = lifecycle.latest_state(
        records.filter("kind = 'task_transitioned'").select(
            "job_id", "task_id", F.col("transition.to").alias("to_state"), "attempt", F.col("seq").alias("pos")
        )
    )
    resumed = last.groupBy("job_id").agg(F.count_if(~lifecycle.is_terminal(F.col("state"))).alias("n"))
    changes = records.filter("kind = 'job_status_changed'").select("job_id", "status", F.col("seq").alias("pos"))
    planned = records.filter("kind = 'job_planned'").select("job_id", "job.status")
    return lifecycle.job_status(changes, planned, resumed)


PLAN_TASKS = 500


def plan_records(tasks, edges=None):
    """Plan records of at most ``PLAN_TASKS`` tasks each, so that no line holds a whole large job."""
    rows = tasks.select(
        F.col("job_id").cast("string").alias("job_id"), F.floor(F.col("task_id") / PLAN_TASKS).alias("part"), "task_id", "title", "kind", "stage", "state"
    )
    if edges is None:
        rows = rows.withColumn("dependencies", F.array().cast("array<string>"))
    else:
        parents = edges.groupBy(F.col("child").alias("task_id")).agg(F.collect_list(F.col("parent").cast("string")).alias("dependencies"))
        rows = rows.join(parents, "task_id", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    task = F.struct(F.col("task_id").cast("string").alias("id"), "title", "kind", "stage", "state", "dependencies")
    return rows.groupBy("job_id", "part").agg(F.collect_list(task).alias("tasks")).select(
        F.lit("job_planned").alias("record"), F.struct(F.col("job_id").alias("id"), F.lit("planning").alias("status")).alias("job"), "tasks"
    )


@query(
    "journal_graph",
    "O-GRF10 O-GRF4 O-SRC1",
    SQL["ready_tasks"].replace("SELECT stage, task_id, title FROM", "SELECT stage, cast(task_id AS string) AS task_id, title FROM"),
)
def journal_graph(t):
    """The graph of a job rebuilt from its plan records alone, and what is ready in it."""
    path = scratch_path(t.spark, "journal")
    journal.append_journal(plan_records(t.v_dag_tasks, t.v_edges), path)
    tasks = cut(journal.planned_tasks(journal.read_journal(t.spark, path)), "planned")
    return graph.ready(tasks.drop("dependencies"), journal.planned_edges(tasks)).select("stage", "task_id", "title")


@query("journal_statistics", "O-AGG4 O-GRF10 O-SRC1", SQL["execution_statistics"])
def journal_statistics(t):
    """The statistics of all jobs from plan, result and failure records alone."""
    path = scratch_path(t.spark, "journal")
    for part in [plan_records(t.v_tasks), *journal_records(t)[3:]]:
        journal.append_journal(part, path)
    records = journal.read_journal(t.spark, path)
    results = records.filter("kind = 'task_completed'").select("job_id", "result.*")
    failures = records.filter("kind = 'task_failed'").select("job_id", "failure.*")
    return usage.execution_statistics(results, failures, journal.planned_tasks(records))


@query(
    "typed_scan",
    "O-SRC4",
    """SELECT cast(conv_id AS string) AS correlation_id, sender, count(*) AS n, max(sequence_number) AS last_seq FROM (
    SELECT conv_id, role AS sender, turn AS sequence_number FROM conversations) x WHERE sender <> 'system' GROUP BY ALL""",
)
def typed_scan(t):
    base = scratch_path(t.spark, "tables")
    said = t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("correlation_id"), F.col("role").alias("sender"),
        F.lit("all").alias("topic"), F.col("turn").alias("sequence_number"),
    )
    tables.write_table(said, base, "messages")
    read = tables.read_table(t.spark, base, "messages")
    return read.filter("sender <> 'system'").groupBy("correlation_id", "sender").agg(
        F.count(F.lit(1)).alias("n"), F.max("sequence_number").alias("last_seq")
    )
