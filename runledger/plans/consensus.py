"""Similarity, consensus and final report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators import consensus as op
from runledger.operators import lifecycle
from runledger.operators import quality as quality_op
from runledger.operators import similarity as sim
from runledger.operators.ordered import Ordered
from runledger.plans import quality
from runledger.plans.lifecycle import COUNTS, group_case
from runledger.plans.quality import headline_sql
from runledger.plans.registry import SQL, query, with_views
from runledger.session import cut

TOKENS = r"""list_distinct(list_transform(list_filter(regexp_split_to_array(output, '[^\p{L}\p{N}]'),
      lambda w: strlen(w) > 3), lambda w: lower(w)))"""
JACC = """CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.s, b.s))
      / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END"""


def rows_sql(where: str, *views: str) -> str:
    """Token sets and positions per job, and all pairs, by brute force."""
    return with_views("v_results", *views, recursive=True) + f""", r AS (SELECT *, {TOKENS} AS s,
      row_number() OVER (PARTITION BY job_id ORDER BY stage, title, task_id) AS pos FROM v_results WHERE passed AND {where}),
  pr AS (SELECT a.job_id, a.pos AS ap, b.pos AS bp, a.task_id AS lt, b.task_id AS rt, {JACC} AS sim
      FROM r a JOIN r b ON a.job_id = b.job_id AND a.pos < b.pos)"""


def clusters_sql(rows: str = "r", pairs: str = "pr", p: str = "") -> str:
    return f""", {p}rc(job_id, pos, label) AS (SELECT job_id, pos, pos FROM {rows}
    UNION SELECT q.job_id, q.bp, c.label FROM {p}rc c JOIN {pairs} q ON q.job_id = c.job_id AND q.ap = c.pos AND sim >= 0.6),
  {p}cl AS (SELECT job_id, pos, min(label) AS label FROM {p}rc GROUP BY job_id, pos)"""


KEPT = """, nb AS (SELECT r.job_id, r.pos, coalesce(list(ap) FILTER (WHERE ap IS NOT NULL), []) AS near FROM r
    LEFT JOIN pr ON pr.job_id = r.job_id AND pr.bp = r.pos AND sim >= 0.85 GROUP BY r.job_id, r.pos),
  kp(job_id, pos, kept) AS (SELECT job_id, 1::BIGINT, [1::BIGINT] FROM r WHERE pos = 1
    UNION ALL SELECT kp.job_id, kp.pos + 1, CASE WHEN list_has_any(nb.near, kept) THEN kept ELSE list_append(kept, kp.pos + 1) END
      FROM kp JOIN nb ON nb.job_id = kp.job_id AND nb.pos = kp.pos + 1),
  kl AS (SELECT job_id, arg_max(kept, pos) AS kept FROM kp GROUP BY job_id),
  k AS (SELECT r.* FROM r JOIN kl ON r.job_id = kl.job_id AND list_contains(kl.kept, r.pos))"""


def results(t):
    return op.reportable(t.v_results, fixed.kinds(t.spark), texts=False)


def answers(t, texts):
    return sim.positioned(t.v_results.filter("passed AND kind = 'answer'"), op.report_order(), texts)


def clustered(t):
    return cut(sim.greedy_clusters(answers(t, True), fixed.SAME_ANSWER), "clustered")


def labels(rows):
    """Clusters of rows without their words."""
    return cut(sim.greedy_clusters(rows, fixed.SAME_ANSWER).drop("tokens", "set_key"), "clustered")


@query(
    "similar_pairs",
    "O-JN5 O-TXT2",
    rows_sql("true")
    + """, f AS (SELECT job_id, md5(array_to_string(list_sort(s), ' ')) AS k, min(pos) AS pos FROM r GROUP BY 1, 2)
  SELECT pr.job_id, lt AS left_task, rt AS right_task, round(sim, 6) AS similarity FROM pr
    JOIN f a ON a.job_id = pr.job_id AND a.pos = ap JOIN f b ON b.job_id = pr.job_id AND b.pos = bp WHERE sim >= 0.5""",
)
def similar_pairs(t):
    rows = results(t)
    ids = rows.select("pos", "task_id")
    pairs = sim.similar_pairs(sim.classes(rows), 0.5)
    for side, name in (("a", "left_task"), ("b", "right_task")):
        pairs = pairs.join(ids.withColumnsRenamed({"pos": side, "task_id": name}), side)
    return pairs.select("job_id", "left_task", "right_task", F.round("similarity", 6).alias("similarity"))


@query(
    "answer_clusters",
    "O-TXT3",
    rows_sql("kind = 'answer'") + clusters_sql()
    + """ SELECT r.job_id, r.task_id, h.task_id AS founder FROM cl JOIN r ON r.job_id = cl.job_id AND r.pos = cl.pos
    JOIN r h ON h.job_id = cl.job_id AND h.pos = cl.label""",
)
def answer_clusters(t):
    c = labels(answers(t, False))
    heads = op.representatives(c).select("job_id", "label", F.col("task_id").alias("founder"))
    return c.join(heads, ["job_id", "label"]).select("job_id", "task_id", "founder")


@query(
    "result_clusters",
    "O-TXT3",
    rows_sql("true") + clusters_sql()
    + """ SELECT r.job_id, r.task_id, h.task_id AS founder FROM cl JOIN r ON r.job_id = cl.job_id AND r.pos = cl.pos
    JOIN r h ON h.job_id = cl.job_id AND h.pos = cl.label""",
)
def result_clusters(t):
    c = labels(results(t))
    heads = op.representatives(c).select("job_id", "label", F.col("task_id").alias("founder"))
    return c.join(heads, ["job_id", "label"]).select("job_id", "task_id", "founder")


def decide_sql(by: str, share: str) -> str:
    return f""", c AS (SELECT cl.job_id, cl.label, count(*) AS size, sum(cast(confidence AS decimal(12,6))) AS weight,
      arg_max(r.task_id, confidence * 1000000000 + r.pos) AS winning_task
      FROM cl JOIN r ON r.job_id = cl.job_id AND r.pos = cl.pos GROUP BY cl.job_id, cl.label),
  n AS (SELECT job_id, cast(sum(size) AS bigint) AS votes, sum(weight) AS total, count(*) AS distinct_positions FROM c GROUP BY job_id),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {by} DESC, label DESC) AS rn FROM c) x WHERE rn = 1),
  agreement AS (SELECT n.job_id, winning_task, {share} AS agreement_rate, votes, distinct_positions
    FROM n JOIN b ON n.job_id = b.job_id WHERE votes >= 2)"""


BY_WEIGHT = decide_sql("weight", "CASE WHEN total > 0 THEN weight::DOUBLE / total::DOUBLE ELSE 0 END")
_AGREED = " SELECT job_id, winning_task, round(agreement_rate, 6) AS agreement_rate, votes, distinct_positions FROM agreement"


@query(
    "majority_consensus",
    "O-TXT4",
    rows_sql("kind = 'answer'") + clusters_sql() + decide_sql("size", "size / votes") + _AGREED,
)
def majority_consensus(t):
    return op.decide(labels(answers(t, False)), weighted=False).withColumn("agreement_rate", F.round("agreement_rate", 6))


@query(
    "weighted_consensus",
    "O-TXT5",
    rows_sql("kind = 'answer'") + clusters_sql() + BY_WEIGHT + _AGREED,
)
def weighted_consensus(t):
    return op.decide(labels(answers(t, False)), weighted=True).withColumn("agreement_rate", F.round("agreement_rate", 6))


@query("redundancy_drop", "O-TXT6", rows_sql("true") + KEPT + " SELECT job_id, task_id FROM k")
def redundancy_drop(t):
    return sim.drop_redundant(results(t), fixed.REDUNDANT).select("job_id", "task_id")


CONFLICTS = """, hd AS (SELECT r.* FROM cl JOIN r ON r.job_id = cl.job_id AND r.pos = cl.pos WHERE cl.pos = cl.label),
  cf AS (SELECT h.job_id, h.task_id, h.title, h.output, count(o.task_id) AS conflicts FROM hd h
    LEFT JOIN hd o ON o.job_id = h.job_id AND o.pos <> h.pos AND EXISTS (SELECT 1 FROM pr WHERE pr.job_id = h.job_id
      AND ap = least(h.pos, o.pos) AND bp = greatest(h.pos, o.pos) AND sim <= 0.3) GROUP BY ALL)"""


@query(
    "conflict_counts",
    "O-TXT7",
    rows_sql("kind = 'answer'") + clusters_sql() + CONFLICTS
    + f" SELECT job_id, task_id, title, {headline_sql('output')} AS claim, conflicts FROM cf",
)
def conflict_counts(t):
    return op.conflict_counts(clustered(t))


PAGE = 40


@query(
    "final_conflicts",
    "O-TXT7 O-TXT9",
    rows_sql("kind = 'answer'") + clusters_sql() + CONFLICTS
    + f""", nb AS (SELECT *, {headline_sql('output')} AS claim, row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1 AS place FROM hd),
  pg AS (SELECT a.job_id, b.place * (b.place - 1) // 2 + a.place AS number, a.task_id AS left_task, b.task_id AS right_task,
      '`' || a.title || '` and `' || b.title || '` reached materially different conclusions' AS description, a.claim AS left_claim, b.claim AS right_claim,
      a.pos AS ap, b.pos AS bp FROM nb a JOIN nb b ON a.job_id = b.job_id AND a.place < b.place)
  SELECT pg.job_id, number, left_task, right_task, description, left_claim, right_claim FROM pg WHERE number < {PAGE}
    AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.job_id = pg.job_id AND pr.ap = pg.ap AND pr.bp = pg.bp AND sim > 0.3)""",
)
def final_conflicts(t):
    """The first page of every job's conflicts, both claims of each."""
    c = clustered(t)
    founders = cut(op.conflict_founders(c), "founders")
    return op.conflict_page(founders, op.conflict_exceptions(c), 0, PAGE)


@query(
    "report_order",
    "O-JN6 O-SRT3",
    with_views("v_results", "v_tasks")
    + """SELECT r.job_id, r.task_id, row_number() OVER (PARTITION BY r.job_id ORDER BY t.stage NULLS FIRST, r.title, r.task_id)
    AS position FROM v_results r LEFT JOIN (SELECT * FROM v_tasks WHERE state <> 'cancelled') t ON r.task_id = t.task_id
      AND r.job_id = t.job_id""",
)
def report_order(t):
    staged = op.with_stage(t.v_results.drop("stage"), t.v_tasks.filter("state <> 'cancelled'"))
    staged = staged.select("job_id", "task_id", "stage", "title").orderBy(*op.report_order())
    placed = cut(staged.withColumn("pos", F.monotonically_increasing_id()), "report")
    return Ordered(placed, ["job_id"], "pos").row_number("position").done().select("job_id", "task_id", "position")


def evidence(t):
    """Evidence items that the outputs themselves carry."""
    jobs = t.documents.select(F.col("doc_id").alias("task_id"), F.col("source").alias("job_id"))
    return quality_op.evidence_rows(quality.raw_outputs(t)).join(jobs, "task_id")


MERGED = f""", ev AS (SELECT d.source AS job_id, i.task_id, i.position, i.source, i.claim, i.support
      FROM ({SQL["evidence_rows"]}) i JOIN documents d ON d.doc_id = i.task_id),
  e1 AS (SELECT ev.job_id, source, claim, support, pos, position, row_number() OVER (PARTITION BY ev.job_id, source, claim
      ORDER BY pos, position) AS rn FROM ev JOIN k ON ev.job_id = k.job_id AND ev.task_id = k.task_id),
  me AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY support DESC, pos, position) AS rank
      FROM e1 WHERE rn = 1) x WHERE rank <= 20)"""


@query(
    "merged_evidence",
    "O-SRT1",
    rows_sql("true") + KEPT + MERGED
    + " SELECT job_id, cast(rank AS int) AS rank, source, claim, support FROM me",
)
def merged_evidence(t):
    kept = sim.drop_redundant(results(t), fixed.REDUNDANT)
    return op.merge_evidence(evidence(t).join(kept.select("job_id", "task_id", "pos"), ["job_id", "task_id"]))


@query(
    "top_findings",
    "O-SRT2",
    rows_sql("true") + KEPT
    + """ SELECT job_id, task_id, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY confidence DESC, pos) AS rank FROM k) x WHERE rank <= 3""",
)
def top_findings(t):
    kept = sim.drop_redundant(results(t), fixed.REDUNDANT)
    return op.top_findings(kept).select("job_id", "task_id", "rank")


_FINAL = (
    rows_sql("true", "v_jobs", "v_tasks")
    + KEPT + MERGED
    + f""", ra AS (SELECT * FROM r WHERE kind = 'answer'),
  pa AS (SELECT pr.* FROM pr JOIN ra a ON a.job_id = pr.job_id AND a.pos = ap JOIN ra b ON b.job_id = pr.job_id AND b.pos = bp)"""
    + clusters_sql("ra", "pa", "a")
    + BY_WEIGHT.replace("FROM cl JOIN r ON", "FROM acl cl JOIN ra r ON")
    + CONFLICTS.replace("FROM cl JOIN r ON", "FROM acl cl JOIN ra r ON")
    + f""", cn AS (SELECT job_id, cast(sum(conflicts) / 2 AS bigint) AS conflicts FROM cf GROUP BY job_id),
  ct AS ({COUNTS} FROM (SELECT *, {group_case()} AS g FROM v_tasks) x GROUP BY job_id),
  ks AS (SELECT job_id, count(*) AS outputs, cast(sum(cast(confidence AS decimal(12,6))) AS double) AS s,
    arg_max(output, pos) FILTER (WHERE kind IN ('merge', 'summarize', 'reduce', 'judge')) AS concluded FROM k GROUP BY job_id),
  ag AS (SELECT a.job_id, 'Consensus (' || cast(round_even(agreement_rate * 100, 0) AS int) || '% agreement across ' || votes
    || ' answers): ' || r.output AS agreed FROM agreement a JOIN r ON r.job_id = a.job_id AND r.task_id = a.winning_task
    JOIN v_jobs j ON j.job_id = a.job_id AND j.strategy IN ('debate', 'consensus')),
  fl AS (SELECT job_id, string_agg(chr(10) || '- ' || title || ': ' || {headline_sql('output')}, '' ORDER BY rank) AS lines
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, pos) AS rank FROM k) x WHERE rank <= 3 GROUP BY job_id),
  ec AS (SELECT job_id, count(*) AS evidence FROM me GROUP BY job_id)
  SELECT j.job_id, j.strategy, coalesce(concluded, agreed, 'Findings for: ' || objective || chr(10) || lines,
      'No validated output was produced for: ' || objective) AS summary,
    coalesce(outputs, 0) AS outputs, coalesce(conflicts, 0) AS conflicts, coalesce(evidence, 0) AS evidence,
    round(CASE WHEN coalesce(outputs, 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
      s / outputs * (ct.completed / ct.total) - 0.1::DOUBLE * coalesce(conflicts, 0))) END, 6) AS confidence_score
  FROM v_jobs j LEFT JOIN ks ON ks.job_id = j.job_id LEFT JOIN ag ON ag.job_id = j.job_id LEFT JOIN fl ON fl.job_id = j.job_id
    LEFT JOIN ec ON ec.job_id = j.job_id LEFT JOIN cn ON cn.job_id = j.job_id JOIN ct ON ct.job_id = j.job_id"""
)


@query("final_results", "O-TXT8 O-TXT9 O-AGG12", _FINAL)
def final_results(t):
    counts = lifecycle.lifecycle_counts(t.v_tasks)
    out = op.final_results(t.v_jobs, t.v_results, counts, fixed.kinds(t.spark), evidence(t))
    return out.withColumn("confidence_score", F.round("confidence_score", 6))
