"""Dependency graph reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import graph as op
from runledger.plans.registry import query, with_views

_TERMINAL = "('completed', 'cancelled', 'dead_lettered')"
TE = with_views("v_dag_tasks", "v_edges")
TE_REC = with_views("v_dag_tasks", "v_edges", recursive=True)


def dag(t):
    return t.v_dag_tasks, t.v_edges.withColumn("job_id", F.lit(0))


WAVES = """, w AS (SELECT task_id, 0 AS d FROM v_dag_tasks WHERE task_id NOT IN (SELECT child FROM v_edges)
    UNION SELECT e.child, w.d + 1 FROM w JOIN v_edges e ON e.parent = w.task_id),
  wave AS (SELECT task_id, cast(max(d) AS int) AS wave FROM w GROUP BY task_id) """


@query("dag_waves", "O-GRF2 O-GRF3", TE_REC + WAVES + "SELECT task_id, wave FROM wave")
def dag_waves(t):
    return op.waves(*dag(t)).select("task_id", "wave")


@query(
    "dag_shape",
    "O-SRT5 O-GRF3",
    TE_REC + WAVES
    + """, s AS (SELECT wave, count(*) AS n FROM wave GROUP BY wave)
  SELECT cast(0 AS int) AS job_id, count(*) AS critical_path, max(n) AS widest_wave, cast(sum(n) AS bigint) AS tasks FROM s""",
)
def dag_shape(t):
    return op.graph_shape(op.waves(*dag(t)))


_BACK = """back AS (SELECT cast(floor(p_partkey / 3) AS bigint) AS child, p_partkey AS parent FROM part
    WHERE p_size = 1 AND p_partkey >= 3)"""


def looped(t):
    tasks, edges = dag(t)
    back = t.part.filter("p_size = 1 AND p_partkey >= 3").select(
        F.floor(F.col("p_partkey") / 3).alias("child"), F.col("p_partkey").alias("parent"), F.lit(0).alias("job_id")
    )
    lost = t.part.filter("p_size = 2").select(
        F.col("p_partkey").alias("child"), (-F.col("p_partkey") - 1).alias("parent"), F.lit(0).alias("job_id")
    )
    return tasks, edges.unionByName(back), lost


@query(
    "graph_errors",
    "O-GRF1 O-GRF10 O-JN4",
    TE_REC + f""", {_BACK}, e2 AS (SELECT child, parent FROM v_edges UNION SELECT child, parent FROM back),
  w AS (SELECT task_id, 0 AS d FROM v_dag_tasks
    UNION SELECT e.child, w.d + 1 FROM w JOIN e2 e ON e.parent = w.task_id WHERE w.d < 80)
  SELECT cast(0 AS int) AS job_id, (SELECT count(*) FROM part WHERE p_size = 2) AS missing,
    count(DISTINCT task_id) AS stuck FROM w WHERE d = 80""",
)
def graph_errors(t):
    tasks, edges, lost = looped(t)
    return op.graph_errors(tasks, edges.unionByName(lost)).drop("cyclic_task")


@query(
    "unknown_dependencies",
    "O-JN4",
    "SELECT p_partkey AS child, -p_partkey - 1 AS parent FROM part WHERE p_size = 2",
)
def unknown_dependencies(t):
    tasks, edges, lost = looped(t)
    return op.unknown_dependencies(tasks, edges.unionByName(lost)).select("child", "parent")


@query(
    "ready_tasks",
    "O-JN3 O-GRF4",
    TE + """SELECT stage, task_id, title FROM v_dag_tasks t WHERE state IN ('created', 'waiting_for_dependency')
    AND NOT EXISTS (SELECT 1 FROM v_edges e JOIN v_dag_tasks p ON e.parent = p.task_id
      WHERE e.child = t.task_id AND p.state <> 'completed')""",
)
def ready_tasks(t):
    return op.ready(*dag(t)).select("stage", "task_id", "title").orderBy("stage", "task_id")


STRANDED = f""", r AS (SELECT task_id FROM v_dag_tasks WHERE state IN ('dead_lettered', 'cancelled')
    UNION SELECT e.child FROM r JOIN v_edges e ON e.parent = r.task_id JOIN v_dag_tasks c ON c.task_id = e.child
      WHERE c.state NOT IN {_TERMINAL}) """


@query(
    "stranded_tasks",
    "O-GRF5",
    TE_REC + STRANDED + f"SELECT t.task_id FROM r JOIN v_dag_tasks t ON r.task_id = t.task_id WHERE state NOT IN {_TERMINAL}",
)
def stranded_tasks(t):
    return op.stranded(*dag(t)).select("task_id")


@query(
    "stranded_cancelled",
    "O-GRF6",
    TE_REC + STRANDED + f"""SELECT 0 AS job_id, CASE WHEN r.task_id IS NOT NULL AND state NOT IN {_TERMINAL} THEN 'cancelled' ELSE state END
    AS new_state, count(*) AS n FROM v_dag_tasks t LEFT JOIN r ON r.task_id = t.task_id GROUP BY 2
    UNION ALL SELECT 1, state, count(*) FROM v_dag_tasks GROUP BY 2""",
)
def stranded_cancelled(t):
    # the same graph as two jobs, of which one still has its queued tasks in the queue
    tasks, edges = (df.withColumn("job_id", F.explode(F.array(F.lit(0), F.lit(1)))) for df in dag(t))
    depth = tasks.filter("state = 'queued' AND job_id = 1").groupBy("job_id").agg(F.count(F.lit(1)).alias("depth"))
    return op.cancel_stranded(tasks, edges, depth).groupBy("job_id", "new_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "neighbour_counts",
    "O-GRF7",
    TE + """SELECT task_id, cast(sum(i) AS bigint) AS dependencies, cast(sum(o) AS bigint) AS dependents FROM (
    SELECT child AS task_id, 1 AS i, 0 AS o FROM v_edges UNION ALL SELECT parent, 0, 1 FROM v_edges) x GROUP BY task_id""",
)
def neighbour_counts(t):
    return op.degrees(dag(t)[1]).drop("job_id")


@query(
    "upstream_context",
    "O-JN1",
    TE + """SELECT e.child, e.parent, p.stage, chr(10) || '## ' || p.title || chr(10) || substr(p.output, 1, 1200) || chr(10) AS block
    FROM v_edges e JOIN v_dag_tasks p ON e.parent = p.task_id WHERE p.state = 'completed'""",
)
def upstream_context(t):
    tasks, edges = dag(t)
    done = tasks.filter("state = 'completed'")
    return op.upstream_context(tasks, edges, done).select("child", "parent", "stage", "block")


@query(
    "split_tasks",
    "O-GRF9",
    TE + """, s AS (SELECT p_partkey AS task_id, p_partkey * 10 + 1000000 + k AS sub FROM part, (VALUES (1), (2), (3)) v(k)
      WHERE p_size = 7)
  SELECT child, parent FROM v_edges WHERE child NOT IN (SELECT task_id FROM s)
  UNION ALL SELECT s.sub, e.parent FROM v_edges e JOIN s ON e.child = s.task_id
  UNION ALL SELECT task_id, sub FROM s""",
)
def split_tasks(t):
    parts = t.part.filter("p_size = 7").select(
        F.lit(0).alias("job_id"), F.col("p_partkey").alias("task_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")
    )
    parts = parts.select("job_id", "task_id", (F.col("task_id") * 10 + 1000000 + F.col("k")).alias("part"))
    return op.split_tasks(dag(t)[1], parts).drop("job_id")


@query(
    "edge_rollback",
    "O-SET5",
    TE + "SELECT child, parent FROM v_edges WHERE NOT child IN (SELECT p_partkey FROM part WHERE p_size = 9)",
)
def edge_rollback(t):
    edges = dag(t)[1]
    undone = edges.join(t.part.filter("p_size = 9").select(F.col("p_partkey").alias("child")), "child", "left_semi")
    return op.without_edges(edges, undone.select("job_id", "child", "parent")).drop("job_id")


_TREE = """n AS (SELECT s_nationkey AS job_id, s_suppkey AS child, s_acctbal,
      row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier),
  c AS (SELECT n.*, p.child AS parent, r.child AS root FROM n LEFT JOIN n p ON p.job_id = n.job_id AND p.rn = n.rn // 2
    JOIN n r ON r.job_id = n.job_id AND r.rn = 1)"""


@query(
    "edge_admission",
    "O-GRF8",
    f"""WITH {_TREE}
  SELECT job_id, child AS pos, parent AS child, child AS parent, 'cycle' AS decision FROM c
    WHERE parent IS NOT NULL AND s_acctbal < 2000
  UNION ALL SELECT job_id, child, child, root, CASE WHEN child = root THEN 'self' WHEN parent = root THEN 'exists'
    ELSE 'added' END FROM c WHERE s_acctbal >= 2000 AND s_acctbal < 8000
  UNION ALL SELECT job_id, child, child, -1, 'unknown_task' FROM c WHERE s_acctbal >= 8000""",
)
def edge_admission(t):
    w = W.partitionBy("job_id").orderBy("child")
    n = t.supplier.select(F.col("s_nationkey").alias("job_id"), F.col("s_suppkey").alias("child"), "s_acctbal")
    n = n.withColumn("rn", F.row_number().over(w))
    up = n.select("job_id", F.col("child").alias("parent"), F.col("rn").alias("half"))
    c = n.withColumn("half", F.floor(F.col("rn") / 2)).join(up, ["job_id", "half"], "left")
    c = c.join(n.filter("rn = 1").select("job_id", F.col("child").alias("root")), "job_id")
    edges = c.filter("parent IS NOT NULL").select("job_id", "child", "parent")
    back = F.col("s_acctbal") < 2000
    proposals = c.filter("parent IS NOT NULL OR s_acctbal >= 2000").select(
        "job_id",
        F.col("child").alias("pos"),
        F.when(back, F.col("parent")).otherwise(F.col("child")).alias("child"),
        F.when(back, F.col("child")).when(F.col("s_acctbal") < 8000, F.col("root")).otherwise(F.lit(-1)).alias("parent"),
    )
    return op.admit_edges(c.select("job_id", F.col("child").alias("task_id")), edges, proposals)


@query(
    "agent_demand",
    "O-AGG13",
    TE_REC + WAVES
    + ", k(kind, agent_type) AS (VALUES " + ", ".join(f"('{k[0]}', '{k[2]}')" for k in fixed.KINDS)
    + """), d AS (SELECT agent_type, count(*) AS tasks, count(*) FILTER (WHERE state IN ('queued', 'retry_scheduled')) AS waiting
      FROM v_dag_tasks t JOIN k ON t.kind = k.kind GROUP BY agent_type),
  x AS (SELECT * FROM d UNION ALL SELECT v.agent_type, 1, 0 FROM (VALUES ('coding'), ('research')) v(agent_type)
      WHERE v.agent_type NOT IN (SELECT agent_type FROM d)),
  s AS (SELECT max(n) AS widest FROM (SELECT count(*) AS n FROM wave GROUP BY wave) y)
  SELECT agent_type, tasks, waiting, cast(row_number() OVER (ORDER BY tasks DESC, agent_type) AS int) AS rank,
    greatest(1, least(greatest(widest, count(*) OVER ()), 500)) AS pool_size FROM x, s""",
)
def agent_demand(t):
    from runledger.operators import match

    tasks, edges = dag(t)
    shape = op.graph_shape(op.waves(tasks, edges))
    wanted = fixed.values_table(t.spark, "job_id, capability, max_agents", [(0, "coding", 500), (0, "research", 500)])
    return match.agent_demand(tasks, fixed.kinds(t.spark), wanted, shape, fixed.cheapest_types(t.spark)).drop("job_id")
