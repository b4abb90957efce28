"""The declared constraints on all 26 declared tables, filled from the given tables."""

from __future__ import annotations

from runledger.operators import constraints as op
from runledger.plans.registry import query
from runledger.sources import tables

RULES = op.parse_rules(tables.CONSTRAINTS)
IDS = {name: tables.ROW_IDS.get(name, "id") for name in tables.DECLARED}

#: declared table: given table, columns, rows. One text for Spark and for the SQL.
FILLED = {
    "tenants": ("nation", "n_nationkey AS id, n_name AS name", "true"),
    "leadership_terms": (
        "region", """r_regionkey AS term, CASE WHEN r_regionkey = 3 THEN 2 ELSE r_regionkey END AS fencing_token,
        cast(NULL AS timestamp) AS released_at""", "true"),
    "nodes": ("nation", "n_nationkey AS id", "n_nationkey % 5 <> 4"),
    "node_state_transitions": ("events", "event_id AS id, event_id % 25 AS node_id", "true"),
    "jobs": (
        "customer", """c_custkey AS id, c_nationkey + CASE WHEN c_custkey % 97 = 0 THEN 100 ELSE 0 END AS tenant_id,
        c_custkey % 5 AS priority, c_custkey % 50 AS max_agents,
        CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || cast(c_custkey % 40 AS string) END AS idempotency_key""",
        "c_acctbal > 0"),
    "job_state_transitions": ("events", "event_id AS id, user_id AS job_id", "true"),
    "job_events": ("events", "event_id AS seq, user_id AS job_id", "true"),
    "tasks": (
        "orders", """o_orderkey AS id, o_custkey AS job_id, o_orderkey % 6 AS attempt, 3 AS max_attempts,
        cast(o_custkey AS string) || ':' || o_orderpriority AS idempotency_key""", "true"),
    "task_dependencies": ("lineitem", "l_orderkey AS task_id, l_partkey AS depends_on", "true"),
    "task_state_transitions": ("events", "event_id AS id, user_id * 97 AS task_id", "true"),
    "agents": (
        "supplier", "s_suppkey AS id, s_nationkey AS node_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS job_id",
        "s_acctbal > 0"),
    "agent_capabilities": ("lineitem", "l_suppkey AS agent_id, l_returnflag AS capability", "true"),
    "agent_state_transitions": ("events", "event_id AS id, event_id % 16 AS agent_id", "true"),
    "task_assignments": (
        "lineitem", """l_orderkey * 10 + l_linenumber AS id, l_orderkey AS task_id, l_suppkey AS agent_id,
        l_linenumber * 4 AS node_id, l_orderkey * 100000 + l_partkey AS lease_id""", "true"),
    "task_attempts": (
        "events", """event_id AS id, user_id AS task_id, event_id % 64 AS attempt, event_id % 16 AS agent_id,
        event_id % 25 AS node_id""", "true"),
    "checkpoints": (
        "conversations", "conv_id * 1000 + turn AS id, conv_id AS task_id, 0 AS attempt, turn % 4 AS seq", "true"),
    "dead_letters": ("labels", "doc_id AS id, doc_id AS job_id, doc_id * 9 AS task_id", "quality = 0"),
    "messages": (
        "conversations", """conv_id * 1000 + turn AS id, conv_id AS job_id, conv_id * 3 AS task_id,
        CASE WHEN role <> 'user' THEN role END AS receiver, CASE WHEN turn % 3 = 0 THEN 'all' END AS topic,
        md5(text) AS idempotency_key""", "true"),
    "memory_records": (
        "events", """event_id AS id, user_id AS job_id, event_id % 16 AS agent_id, 'users' AS namespace,
        cast(user_id AS string) AS key""", "true"),
    "memory_audit": ("events", "event_id AS id", "true"),
    "artifacts": ("pages", "page_id AS id, page_id AS job_id, page_id * 64 AS task_id", "true"),
    "consensus_rounds": (
        "part", "p_partkey AS id, p_partkey AS job_id, p_partkey * 8 AS task_id, p_size AS judge_agent_id", "p_partkey % 50 > 0"),
    "consensus_votes": (
        "lineitem", """l_orderkey * 10 + l_linenumber AS id, l_partkey AS round_id, l_suppkey AS agent_id,
        l_quantity / 40 AS confidence""", "true"),
    "model_requests": (
        "events", "event_id AS id, user_id AS job_id, user_id AS task_id, event_id % 16 AS agent_id", "true"),
    "cost_records": ("orders", "o_orderkey AS id, o_custkey % 30 AS tenant_id, o_custkey AS job_id", "true"),
    "audit_log": ("events", "event_id AS id, user_id % 30 AS tenant_id", "true"),
}


def _rule_sql(rule: op.Rule) -> str:
    """The rule by itself, as one would write it by hand."""
    table, head = rule.table_name, f"SELECT '{rule.table_name}' AS table_name, '{rule.rule}' AS rule, "
    some = " AND ".join(f"{c} IS NOT NULL" for c in rule.columns)
    key = " || '/' || ".join(f"cast({c} AS string)" for c in rule.columns)
    if rule.kind == "check":
        return head + f"cast({IDS[table]} AS string) AS key, count(*) AS n FROM d_{table} WHERE NOT ({rule.predicate}) GROUP BY {IDS[table]}"
    if rule.kind == "unique":
        where = f"{some} AND ({rule.predicate or 'true'})"
        return head + f"{key} AS key, count(*) AS n FROM d_{table} WHERE {where} GROUP BY {', '.join(rule.columns)} HAVING count(*) > 1"
    column = rule.columns[0]
    return head + f"""{key} AS key, count(*) AS n FROM d_{table} c WHERE {some}
      AND NOT EXISTS (SELECT 1 FROM d_{rule.target} p WHERE p.{IDS[rule.target]} = c.{column}) GROUP BY {column}"""


def _sql() -> str:
    filled = ", ".join(f"d_{name} AS (SELECT {cols} FROM {given} WHERE {rows})" for name, (given, cols, rows) in FILLED.items())
    return f"WITH {filled} " + "\nUNION ALL ".join(map(_rule_sql, RULES))


@query("declared_constraints", "O-AGG14", _sql())
def declared_constraints(t):
    return op.audit(
        {
            name: tables.conform(t.spark.sql(f"SELECT {cols} FROM {{given}} WHERE {rows}", given=t.table(given)), name)
            for name, (given, cols, rows) in FILLED.items()
        },
        RULES,
        IDS,
    )


_LISTED = ", ".join(f"('{r.table_name}', '{r.rule}', '{r.kind}')" for r in RULES)


@query(
    "constraint_counts",
    "O-AGG14",
    f"""SELECT r.table_name, r.rule, r.kind, count(v.n) AS broken_keys, cast(coalesce(sum(v.n), 0) AS bigint) AS rows_held
    FROM (VALUES {_LISTED}) r(table_name, rule, kind) LEFT JOIN ({_sql()}) v ON v.table_name = r.table_name AND v.rule = r.rule
    GROUP BY r.table_name, r.rule, r.kind""",
)
def constraint_counts(t):
    """Every rule with how many keys break it and how many rows those hold."""
    return op.rule_counts(declared_constraints(t), RULES)
