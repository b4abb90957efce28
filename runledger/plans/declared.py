"""Queries over what is declared in tables but computed nowhere else."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import declared as op
from runledger.plans.registry import query, with_views


@query(
    "vote_rounds",
    "O-DCL1",
    """WITH v AS (SELECT d.source AS round_id, l.quality AS answer, l.doc_id % 3 + 1 AS weight FROM labels l
      JOIN documents d ON l.doc_id = d.doc_id),
  t AS (SELECT round_id, answer, sum(weight) AS w FROM v GROUP BY 1, 2),
  s AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY w DESC, answer) AS rn, sum(w) OVER (PARTITION BY round_id) AS total,
    count(*) OVER (PARTITION BY round_id) AS positions FROM t)
  SELECT round_id, answer AS decision, w / total AS agreement_rate, positions,
    CASE WHEN w >= 25 THEN 'decided' ELSE 'open' END AS status FROM s WHERE rn = 1""",
)
def vote_rounds(t):
    votes = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("round_id"), F.col("quality").alias("answer"), (F.col("doc_id") % 3 + 1).alias("weight")
    )
    rounds = votes.select("round_id").distinct().withColumn("quorum", F.lit(25))
    return op.vote_rounds(votes, rounds)


def _ranked_choice_sql(choices: int) -> str:
    """The elimination rounds written out, as many as there can be choices."""
    steps = ["""b AS (SELECT user_id % 5 AS round_id, user_id AS ballot, event_type AS choice, count(*) AS n FROM events GROUP BY 1, 2, 3),
  a0 AS (SELECT DISTINCT round_id, choice FROM b)"""]
    for k in range(choices):
        steps.append(f"""f{k} AS (SELECT round_id, choice, count(*) AS n FROM (SELECT b.round_id, b.choice, row_number() OVER
    (PARTITION BY b.round_id, ballot ORDER BY n DESC, b.choice) AS rn FROM b JOIN a{k} a ON a.round_id = b.round_id AND a.choice = b.choice) x
    WHERE rn = 1 GROUP BY 1, 2),
  t{k} AS (SELECT round_id, choice, n, sum(n) OVER (PARTITION BY round_id) AS total, count(*) OVER (PARTITION BY round_id) AS remain,
    row_number() OVER (PARTITION BY round_id ORDER BY n DESC, choice DESC) AS best, row_number() OVER (PARTITION BY round_id ORDER BY n, choice DESC) AS worst
    FROM (SELECT a.round_id, a.choice, coalesce(n, 0) AS n FROM a{k} a LEFT JOIN f{k} f ON a.round_id = f.round_id AND a.choice = f.choice) y),
  w{k} AS (SELECT round_id, choice AS winner, {k} AS eliminations FROM t{k} WHERE best = 1 AND (n * 2 > total OR remain = 1)),
  a{k + 1} AS (SELECT round_id, choice FROM t{k} WHERE worst > 1 AND round_id NOT IN (SELECT round_id FROM w{k}))""")
    return "WITH " + ", ".join(steps) + " UNION ALL ".join(f" SELECT * FROM w{k}" for k in range(choices))


@query("ranked_choice", "O-DCL2", _ranked_choice_sql(5))
def ranked_choice(t):
    share = t.events.groupBy((F.col("user_id") % 5).alias("round_id"), F.col("user_id").alias("ballot"),
                             F.col("event_type").alias("choice")).agg(F.count(F.lit(1)).alias("n"))
    return op.ranked_choice(
        share.select("round_id", "ballot", "choice", F.struct((-F.col("n")).alias("n"), "choice").alias("rank"))
    )


@query(
    "semantic_top_k",
    "O-DCL3",
    """WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label),
  s AS (SELECT q.query_id, e.vec_id AS record_id, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS score
    FROM q JOIN embeddings x ON x.vec_id = q.query_id JOIN embeddings e ON e.label = q.label)
  SELECT query_id, record_id, cast(rank AS int) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s WHERE score >= 0.1 AND record_id <> query_id) x WHERE rank <= 5""",
)
def semantic_top_k(t):
    e = t.embeddings
    queries = e.groupBy(F.col("label").alias("namespace")).agg(F.min(F.struct("vec_id", "embedding")).alias("q")).select(
        "namespace", F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("query")
    )
    records = e.select(F.col("label").alias("namespace"), F.col("vec_id").alias("record_id"), "embedding")
    own = queries.select(F.col("query_id").alias("record_id"))
    found = op.semantic_top_k(records.join(own, "record_id", "left_anti"), queries, 5, 0.1)
    return found.withColumn("score", F.round("score", 6))


_TERM = "cast(floor(event_id / 500) AS bigint) - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END"


@query(
    "fencing_breaches",
    "O-DCL4",
    f"""SELECT job_id, pos, term, highest_term FROM (SELECT *, max(term) OVER (PARTITION BY job_id ORDER BY pos
    ROWS UNBOUNDED PRECEDING) AS highest_term FROM (SELECT user_id % 20 AS job_id, event_id AS pos, {_TERM} AS term FROM events) e) x
    WHERE term < highest_term""",
)
def fencing_breaches(t):
    writes = t.events.select((F.col("user_id") % 20).alias("job_id"), F.col("event_id").alias("pos"), F.expr(_TERM).alias("term"))
    return op.fencing_breaches(writes, ["job_id"])


_MESSAGE = """event_id AS pos, user_id % 16 AS sender, user_id % 20 AS job_id,
  event_id - CASE WHEN event_id % 13 = 0 THEN 400 ELSE 0 END AS sequence_number,
  CASE WHEN event_id % 11 = 0 THEN cast(NULL AS string) ELSE 'r' END AS receiver,
  CASE WHEN event_id % 3 = 0 THEN cast(NULL AS string) ELSE 't' END AS topic,
  cast(event_id - CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS string) AS idempotency_key,
  cast(floor(value * 100) AS bigint) AS expires_us"""


@query(
    "message_envelopes",
    "O-DCL5",
    f"""WITH m AS (SELECT {_MESSAGE} FROM events), w AS (SELECT *, min(pos) OVER (PARTITION BY idempotency_key) AS first_pos,
    lag(sequence_number) OVER (PARTITION BY sender, job_id ORDER BY pos) AS prev FROM m)
  SELECT pos, CASE WHEN pos > first_pos THEN 'duplicate' WHEN expires_us <= 300 THEN 'expired'
    WHEN receiver IS NULL AND topic IS NULL THEN 'unaddressed' WHEN sequence_number <= prev THEN 'out_of_order' ELSE 'ok' END
    AS complaint FROM w""",
)
def message_envelopes(t):
    return op.check_envelopes(t.events.selectExpr(*_split(_MESSAGE)), 300).select("pos", "complaint")


def _split(columns: str) -> list[str]:
    """Top-level select items of a comma-separated list."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            items.append(columns[start:i])
            start = i + 1
    return [*items, columns[start:]]


@query(
    "causation_chains",
    "O-DCL6",
    """WITH RECURSIVE c AS (SELECT o_orderkey AS id, o_orderkey AS root, 0::BIGINT AS depth FROM orders
      WHERE o_orderkey // 3 NOT IN (SELECT o_orderkey FROM orders) OR o_orderkey % 7 = 0 OR o_orderkey < 3
    UNION ALL SELECT o.o_orderkey, c.root, c.depth + 1 FROM c JOIN orders o ON o.o_orderkey // 3 = c.id
      WHERE o.o_orderkey % 7 <> 0 AND o.o_orderkey >= 3)
  SELECT id, root, depth FROM c""",
)
def causation_chains(t):
    key = F.col("o_orderkey")
    cause = F.when((key % 7 == 0) | (key < 3), F.lit(None)).otherwise(F.floor(key / 3).cast("bigint"))
    return op.causation_chains(t.orders.select(key.alias("id"), cause.alias("causation_id")))


@query(
    "quota_breaches",
    "O-DCL7",
    """WITH e AS (SELECT user_id % 4 AS tenant_id, epoch_us(ts) AS us, cast(floor(value * 10) AS bigint) AS tokens FROM events),
  w AS (SELECT tenant_id, (us // 600000000 - k) * 600000000 AS from_us, tokens FROM e, (VALUES (0), (1), (2), (3), (4), (5)) v(k))
  SELECT tenant_id, from_us, cast(sum(tokens) AS bigint) AS tokens FROM w GROUP BY 1, 2 HAVING sum(tokens) > 1500""",
)
def quota_breaches(t):
    calls = t.events.select(
        (F.col("user_id") % 4).alias("tenant_id"), F.col("ts").cast("timestamp").alias("at"),
        F.floor(F.col("value") * 10).alias("tokens"),
    )
    return op.quota_breaches(calls, 1500, "1 hour", "10 minutes")


@query(
    "heartbeat_losses",
    "O-DCL8",
    with_views("v_attempts")
    + """SELECT node_id, at_us AS lost_us, nxt AS back_us FROM (SELECT agent_id AS node_id, at_us,
    lead(at_us) OVER (PARTITION BY agent_id ORDER BY at_us) AS nxt FROM v_attempts) x WHERE nxt - at_us > 3 * 900000000::BIGINT""",
)
def heartbeat_losses(t):
    beats = t.v_attempts.select(F.col("agent_id").alias("node_id"), "at_us")
    return op.heartbeat_losses(beats, 900_000_000)


@query(
    "node_headroom",
    "O-DCL10",
    """SELECT node_id, round(headroom, 6) AS headroom FROM (SELECT s_suppkey AS node_id,
    greatest(0, least(1, 1 - abs(s_acctbal) / 10000)) * 0.5 + (1.0::DOUBLE / (1 + s_nationkey)) * 0.5 AS headroom FROM supplier) x
    ORDER BY headroom DESC, node_id LIMIT 10""",
)
def node_headroom(t):
    nodes = t.supplier.select(
        F.col("s_suppkey").alias("node_id"), op.headroom(F.abs("s_acctbal") / 10000, F.col("s_nationkey")).alias("headroom")
    )
    best = nodes.orderBy(F.desc("headroom"), "node_id").limit(10)
    return best.withColumn("headroom", F.round("headroom", 6))


@query(
    "sweep_summary",
    "O-DCL11",
    """SELECT o_custkey % 8 AS agents, o_orderpriority AS topology, count(*) AS runs,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
    min(cast(floor(o_totalprice) AS bigint)) AS best_ms, max(cast(floor(o_totalprice) AS bigint)) AS worst_ms,
    cast(sum(cast(floor(o_totalprice) AS bigint) * 3) AS bigint) AS cost_micro_usd FROM orders GROUP BY 1, 2""",
)
def sweep_summary(t):
    price = F.floor("o_totalprice").cast("bigint")
    runs = t.orders.select(
        (F.col("o_custkey") % 8).alias("agents"), F.col("o_orderpriority").alias("topology"),
        (F.col("o_orderstatus") == "F").alias("ok"), price.alias("wall_ms"), (price * 3).alias("cost_micro_usd"),
    )
    return op.sweep_summary(runs).withColumn("success_rate", F.round("success_rate", 6))


@query(
    "repeated_artifacts",
    "artifacts: content-hash duplicate report",
    """SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id, max(strlen(text)) AS size_bytes,
    cast(sum(strlen(text)) - max(strlen(text)) AS bigint) AS wasted_bytes FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def repeated_artifacts(t):
    return op.repeated_artifacts(t.documents.select(
        F.md5("text").alias("content_hash"), F.col("doc_id").alias("artifact_id"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    ))
