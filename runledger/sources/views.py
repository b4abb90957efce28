"""Run-history views over the given tables.

Each view is one SELECT in the common subset of Spark SQL and ANSI SQL; the few
dialect gaps are macros (``@name(...)``). The same text therefore serves the Spark
queries and the SQL they are checked against.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

#: Files of a stream that one micro-batch takes in.
FILES_PER_TRIGGER = 64

_SPARK_MACROS = {
    "us": r"unix_micros(cast(\1 as timestamp))",
    "idiv": r"(\1)",
    "caps": r"filter(array(\1), x -> x is not null)",
    "list": r"array(\1)",
}
_ANSI_MACROS = {
    "us": r"epoch_us(\1)",
    "idiv": r"(\1)",
    "caps": r"list_filter([\1], lambda x: x is not null)",
    "list": r"[\1]",
}

VIEWS: dict[str, str] = {
    "v_transitions": """
        SELECT 'task' AS entity, user_id AS task_id, user_id % 20 AS job_id, event_id AS pos,
               @us(ts) AS at_us, cast(event_id % 4 AS int) AS attempt,
               CASE event_id % 6 WHEN 0 THEN cast(NULL AS string) WHEN 1 THEN 'created'
                    WHEN 2 THEN 'queued' WHEN 3 THEN 'leased' WHEN 4 THEN 'running'
                    ELSE 'failed' END AS from_state,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'queued'
                    WHEN 'click' THEN 'leased' WHEN 'purchase' THEN 'completed'
                    ELSE 'failed' END AS to_state
        FROM {events}""",
    "v_attempts": """
        SELECT user_id AS task_id, user_id % 20 AS job_id, event_id AS pos, @us(ts) AS at_us,
               event_id % 16 AS agent_id, 'p' || cast(user_id % 3 AS string) AS provider,
               event_type <> 'error' AS ok, cast(floor(value * 10) AS bigint) AS latency_ms
        FROM {events}""",
    "v_job_events": """
        SELECT user_id % 20 AS job_id, event_id AS seq, user_id AS task_id, @us(ts) AS at_us,
               CASE event_type WHEN 'signup' THEN 'agent_spawned' WHEN 'view' THEN 'task_queued'
                    WHEN 'click' THEN 'task_started' WHEN 'purchase' THEN 'task_completed'
                    ELSE 'task_failed' END AS kind
        FROM {events}""",
    "v_kv_writes": """
        SELECT 'users' AS namespace, cast(user_id AS string) AS key, event_id AS pos,
               @us(ts) AS at_us, cast(floor(value * 100) AS bigint) AS value,
               CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'click' THEN 'cas'
                    WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'compact'
                    ELSE 'put' END AS op,
               event_id % 4 AS expected,
               cast(CASE WHEN event_type = 'view' THEN 86400000 ELSE -1 END AS bigint) AS ttl_ms,
               CASE WHEN event_id % 3 = 0 THEN user_id % 20 ELSE -1 END AS job_id,
               'agent-' || cast(event_id % 16 AS string) AS actor
        FROM {events}""",
    "v_lease_events": """
        SELECT user_id AS task_id, event_id AS pos, @us(ts) AS at_us,
               CASE event_type WHEN 'view' THEN 'grant' WHEN 'click' THEN 'extend'
                    WHEN 'purchase' THEN 'ack' WHEN 'error' THEN 'reject'
                    ELSE CASE WHEN event_id % 2 = 0 THEN 'release' ELSE 'sweep' END END AS op,
               cast(43200000 + (event_id % 5) * 43200000 AS bigint) AS duration_ms,
               3 AS max_attempts
        FROM {events}""",
    "v_results": """
        SELECT source AS job_id, doc_id AS task_id, cast(doc_id % 5 AS int) AS stage,
               'doc-' || lpad(cast(doc_id AS string), 8, '0') AS title,
               CASE doc_id % 4 WHEN 0 THEN 'work' WHEN 1 THEN 'answer' WHEN 2 THEN 'merge'
                    ELSE 'map' END AS kind,
               text AS output, cast(n_chars % 100 AS double) / 100 AS confidence,
               n_chars AS duration_ms, n_chars % 400 AS tokens_in, n_chars % 90 AS tokens_out,
               doc_id % 7 = 0 AS deduplicated, n_chars % 11 <> 0 AS passed,
               doc_id % 16 AS agent_id
        FROM {documents}""",
    "v_failures": """
        SELECT d.source AS job_id, l.doc_id AS task_id, cast(l.doc_id % 3 AS int) AS attempt,
               CASE l.doc_id % 6 WHEN 0 THEN 'validation' WHEN 1 THEN 'timeout'
                    WHEN 2 THEN 'provider' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'cancelled'
                    ELSE 'unheard_of' END AS error_kind,
               l.toxic = 1 AS dead_lettered
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.quality = 0""",
    "v_tasks": """
        SELECT source AS job_id, doc_id AS task_id, cast(doc_id % 5 AS int) AS stage,
               'doc-' || lpad(cast(doc_id AS string), 8, '0') AS title,
               CASE doc_id % 4 WHEN 0 THEN 'work' WHEN 1 THEN 'answer' WHEN 2 THEN 'merge'
                    ELSE 'map' END AS kind,
               CASE (doc_id * 7 + n_chars) % 12 WHEN 0 THEN 'created'
                    WHEN 1 THEN 'waiting_for_dependency' WHEN 2 THEN 'queued' WHEN 3 THEN 'leased'
                    WHEN 4 THEN 'running' WHEN 5 THEN 'completed' WHEN 6 THEN 'failed'
                    WHEN 7 THEN 'timed_out' WHEN 8 THEN 'retry_scheduled' WHEN 9 THEN 'preempted'
                    WHEN 10 THEN 'cancelled' ELSE 'dead_lettered' END AS state,
               cast(n_chars % 5 AS int) AS attempt
        FROM {documents}""",
    "v_jobs": """
        SELECT source AS job_id, 'Objective of ' || source AS objective,
               CASE max(doc_id) % 9 WHEN 0 THEN 'sequential' WHEN 1 THEN 'debate'
                    WHEN 2 THEN 'hierarchical' WHEN 3 THEN 'parallel' WHEN 4 THEN 'map_reduce'
                    WHEN 5 THEN 'consensus' WHEN 6 THEN 'supervisor_worker'
                    WHEN 7 THEN 'planner_executor' ELSE 'adaptive' END AS strategy,
               CASE max(n_chars) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'paused'
                    WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
               max(n_chars) * 3 AS wall_clock_ms, cast(4 AS bigint) AS parallelism
        FROM {documents} GROUP BY source""",
    "v_dag_tasks": """
        SELECT p_partkey AS task_id, 0 AS job_id, p_name AS title, p_size % 5 AS stage,
               CASE p_partkey % 13 WHEN 0 THEN 'plan' WHEN 1 THEN 'subplan' WHEN 2 THEN 'work'
                    WHEN 3 THEN 'map' WHEN 4 THEN 'reduce' WHEN 5 THEN 'answer'
                    WHEN 6 THEN 'critique' WHEN 7 THEN 'verify' WHEN 8 THEN 'judge'
                    WHEN 9 THEN 'vote' WHEN 10 THEN 'merge' WHEN 11 THEN 'summarize'
                    ELSE 'supervise' END AS kind,
               CASE p_size % 12 WHEN 0 THEN 'created' WHEN 1 THEN 'waiting_for_dependency'
                    WHEN 2 THEN 'queued' WHEN 3 THEN 'completed' WHEN 4 THEN 'running'
                    WHEN 5 THEN 'completed' WHEN 6 THEN 'created' WHEN 7 THEN 'completed'
                    WHEN 8 THEN 'retry_scheduled' WHEN 9 THEN 'completed'
                    WHEN 10 THEN CASE WHEN p_retailprice > 910 THEN 'cancelled' ELSE 'created' END
                    ELSE CASE WHEN p_retailprice > 912 THEN 'dead_lettered' ELSE 'leased' END
                    END AS state,
               p_name || ' ' || p_brand || ' ' || p_type AS output, p_size
        FROM {part}""",
    "v_edges": """
        SELECT DISTINCT child, parent FROM (
          SELECT p_partkey AS child, cast(floor(p_partkey / 2) AS bigint) AS parent FROM {part}
          UNION ALL
          SELECT p_partkey, cast(floor(p_partkey / 3) AS bigint) FROM {part}) e
        WHERE parent > 0 AND parent < child""",
    "v_queue": """
        SELECT o_orderkey AS task_id, o_custkey AS job_id, o_orderstatus AS queue,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2
                    WHEN '3' THEN 1 ELSE 0 END AS priority,
               @us(o_orderdate) AS enqueued_us,
               @us(o_orderdate) + (o_orderkey % 5) * 86400000000 AS available_us,
               cast(o_custkey AS string) || ':' || o_orderpriority AS idempotency_key,
               cast(o_orderkey % 4 AS int) AS attempt,
               CASE o_orderkey % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'planning'
                    WHEN 2 THEN 'review' ELSE 'merging' END AS required
        FROM {orders}""",
    "v_agents": """
        SELECT s_suppkey AS agent_id, s_nationkey % 4 AS pool,
               cast(cast(floor(abs(s_acctbal)) AS bigint) % 100 AS double) / 100 AS current_load,
               (s_suppkey * 37) % 5000 AS latency_ms,
               1 - cast(s_suppkey % 7 AS double) / 20 AS success_rate,
               CASE s_suppkey % 5 WHEN 0 THEN 'idle' WHEN 1 THEN 'registered'
                    WHEN 2 THEN 'running' WHEN 3 THEN 'idle' ELSE 'terminated' END AS status,
               @caps(CASE WHEN s_nationkey % 2 = 1 THEN 'research' END,
                     CASE WHEN floor(s_nationkey / 2) % 2 = 1 THEN 'planning' END,
                     CASE WHEN floor(s_nationkey / 4) % 2 = 1 THEN 'review' END,
                     CASE WHEN floor(s_nationkey / 8) % 2 = 1 THEN 'verification' END,
                     CASE WHEN floor(s_nationkey / 16) % 2 = 1 THEN 'merging' END,
                     'general') AS capabilities,
               1700000000000000 + s_suppkey * 1000000 AS last_active_us
        FROM {supplier}""",
    "v_messages": "SELECT conv_id AS request_id, turn, role, text AS content FROM {conversations}",
    "v_model_calls": """
        SELECT event_id AS request_id, user_id % 20 AS job_id, user_id % 4 AS tenant_id,
               'p' || cast(user_id % 3 AS string) AS provider,
               'm' || cast(event_id % 3 AS string) AS model, event_id AS pos, @us(ts) AS at_us,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cached'
                    WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'circuit_open' ELSE 'ok' END
                    ELSE 'ok' END AS status,
               cast(floor(value * 10) AS bigint) AS tokens_in,
               cast(floor(value * 4) AS bigint) AS tokens_out,
               event_id % 9 = 0 AS fell_back,
               cast(floor(value * 10) AS bigint) AS latency_ms,
               cast(floor(value) AS string) || ':' || cast(event_id % 3 AS string) AS fingerprint,
               event_id % 10 = 0 AS bypass_cache
        FROM {events}""",
}


def _expand(text: str, macros: dict[str, str]) -> str:
    for name, body in macros.items():
        pattern = re.compile(rf"@{name}\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)")
        text = pattern.sub(body, text)
    return text


def ansi_view(name: str) -> str:
    text = _expand(VIEWS[name], _ANSI_MACROS)
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text


class Tables:
    """Lazy access to the given tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream over its files."""
        schema = self.table(name).schema
        source = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        return source.parquet(f"{self.sf_dir}/{name}*.parquet")

    def stream_view(self, name: str) -> DataFrame:
        return self._view(name, self.stream)

    def _view(self, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
        text = _expand(VIEWS[name], _SPARK_MACROS)
        used = {t: read(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self._view(name, self.table)
        raise AttributeError(name)
