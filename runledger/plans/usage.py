"""Usage, cost, latency and concurrency reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions.text import SPACE_RE2
from runledger.operators import usage as op
from runledger.plans.registry import query, with_views

PCT = ", ".join(f"quantile_disc({{0}}, 0.{q}) AS p{q}_ms" for q in (50, 95, 99))


@query(
    "latency_percentiles",
    "O-AGG3",
    with_views("v_attempts") + f"SELECT agent_id, {PCT.format('latency_ms')} FROM v_attempts GROUP BY agent_id",
)
def latency_percentiles(t):
    return op.latency_percentiles(t.v_attempts, ["agent_id"])


_STATS = (
    with_views("v_results", "v_failures", "v_tasks")
    + f""", g AS (SELECT job_id, count(*) AS tasks_succeeded,
    count(*) FILTER (WHERE NOT deduplicated) AS model_requests,
    count(*) FILTER (WHERE deduplicated) AS model_cache_hits,
    cast(sum(tokens_in) AS bigint) AS tokens_in, cast(sum(tokens_out) AS bigint) AS tokens_out,
    cast(sum(tokens_in * 3 + tokens_out * 15) AS bigint) AS cost_micro_usd, {PCT.format('duration_ms')}
    FROM v_results GROUP BY job_id),
  b AS (SELECT job_id, count(*) FILTER (WHERE dead_lettered) AS tasks_failed,
    count(*) FILTER (WHERE NOT dead_lettered) AS tasks_retried FROM v_failures GROUP BY job_id),
  n AS (SELECT job_id, count(*) AS tasks_total FROM v_tasks GROUP BY job_id)
  SELECT n.job_id, tasks_total, coalesce(tasks_succeeded, 0) AS tasks_succeeded,
    coalesce(model_requests, 0){{extra}} AS model_requests,
    coalesce(model_cache_hits, 0) AS model_cache_hits, coalesce(tokens_in, 0) AS tokens_in,
    coalesce(tokens_out, 0) AS tokens_out, coalesce(cost_micro_usd, 0) AS cost_micro_usd,
    coalesce(tasks_failed, 0) AS tasks_failed, coalesce(tasks_retried, 0) AS tasks_retried,
    coalesce(p50_ms, 0) AS p50_ms, coalesce(p95_ms, 0) AS p95_ms, coalesce(p99_ms, 0) AS p99_ms,
    cast(0 AS bigint) AS wall_clock_ms
  FROM n LEFT JOIN g ON n.job_id = g.job_id LEFT JOIN b ON n.job_id = b.job_id"""
)


@query("execution_statistics", "O-AGG4", _STATS.format(extra=""))
def execution_statistics(t):
    return op.execution_statistics(t.v_results, t.v_failures, t.v_tasks)


@query(
    "execution_statistics_live",
    "O-AGG4 live variant",
    _STATS.format(extra=" + coalesce(tasks_failed, 0) + coalesce(tasks_retried, 0)"),
)
def execution_statistics_live(t):
    return op.execution_statistics(t.v_results, t.v_failures, t.v_tasks, count_failed_calls=True)


@query(
    "coordination_overhead",
    "O-AGG5",
    with_views("v_jobs", "v_results")
    + """, s AS (SELECT job_id, sum(duration_ms) AS task_ms FROM v_results GROUP BY job_id)
  SELECT j.job_id, round(CASE WHEN wall_clock_ms = 0 OR parallelism = 0 THEN 0.0
    ELSE greatest(0.0, least(1.0, (wall_clock_ms - cast(coalesce(task_ms, 0) AS double) / parallelism)
      / wall_clock_ms)) END, 6) AS overhead
  FROM v_jobs j LEFT JOIN s ON j.job_id = s.job_id""",
)
def coordination_overhead(t):
    spent = t.v_results.groupBy("job_id").agg(F.sum("duration_ms").alias("task_ms"))
    return t.v_jobs.join(spent, "job_id", "left").select(
        "job_id",
        F.round(
            op.coordination_overhead(
                F.col("wall_clock_ms"),
                F.coalesce("task_ms", F.lit(0)).cast("double"),
                F.col("parallelism"),
            ),
            6,
        ).alias("overhead"),
    )


_USAGE = """count(*) FILTER (WHERE status IN ('ok', 'error', 'rate_limited')) AS requests,
    count(*) FILTER (WHERE status = 'cached') AS cache_hits,
    count(*) FILTER (WHERE status IN ('error', 'rate_limited')) AS failures,
    count(*) FILTER (WHERE status IN ('ok', 'error', 'rate_limited') AND fell_back) AS fallbacks,
    count(*) FILTER (WHERE status = 'circuit_open') AS circuit_rejections,
    cast(sum(CASE WHEN status = 'ok' THEN tokens_in ELSE 0 END) AS bigint) AS tokens_in,
    cast(sum(CASE WHEN status = 'ok' THEN tokens_out ELSE 0 END) AS bigint) AS tokens_out,
    cast(sum(CASE WHEN status = 'ok' THEN tokens_in * 3 + tokens_out * 15 ELSE 0 END) AS bigint)
      AS cost_micro_usd"""


@query(
    "usage_rollup",
    "O-AGG6",
    with_views("v_model_calls")
    + f"""SELECT coalesce(cast(tenant_id AS string), '*') AS tenant_id,
    coalesce(cast(job_id AS string), '*') AS job_id, coalesce(provider, '*') AS provider,
    coalesce(model, '*') AS model, cast(grouping_id(tenant_id, job_id, provider, model) AS bigint) AS level,
    {_USAGE} FROM v_model_calls GROUP BY ROLLUP (tenant_id, job_id, provider, model)""",
)
def usage_rollup(t):
    levels = ["tenant_id", "job_id", "provider", "model"]
    out = op.usage_rollup(t.v_model_calls, levels)
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in levels}
    return out.withColumns(named)


@query(
    "conversation_rollup",
    "O-AGG16",
    rf"""SELECT conv_id AS request_id,
    cast(sum(len(list_filter(regexp_split_to_array(text, '{SPACE_RE2}'), lambda w: w <> ''))) AS bigint)
      AS prompt_tokens,
    coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), '') AS last_user_message
  FROM conversations GROUP BY conv_id""",
)
def conversation_rollup(t):
    return op.conversation_rollup(t.v_messages)


_PRICES = [("m0", 0, 3, 15), ("m1", 0, 1, 5), ("m1", 1705276800000000, 2, 10)]


@query(
    "priced_calls",
    "O-PRJ11",
    with_views("v_model_calls")
    + """, p(model, from_us, to_us, pi, po) AS (VALUES ('m0', 0, NULL, 3, 15),
      ('m1', 0, 1705276800000000, 1, 5), ('m1', 1705276800000000, NULL, 2, 10))
  SELECT c.model, c.provider, count(*) AS calls,
    cast(sum(tokens_in * coalesce(pi, 3) + tokens_out * coalesce(po, 15)) AS bigint) AS cost_micro_usd,
    cast(sum(tokens_in * coalesce(pi, 3) + tokens_out * coalesce(po, 15)) AS double) / 1000000 AS cost_usd
  FROM v_model_calls c LEFT JOIN p ON c.model = p.model AND c.at_us >= from_us
    AND (to_us IS NULL OR c.at_us < to_us) GROUP BY c.model, c.provider""",
)
def priced_calls(t):
    prices = fixed.values_table(t.spark, "model, valid_from_us, price_in, price_out", _PRICES)
    return (
        op.price_calls(t.v_model_calls, F.broadcast(prices))
        .groupBy("model", "provider")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_micro_usd").alias("cost_micro_usd"))
        .withColumn("cost_usd", F.col("cost_micro_usd").cast("double") / 1_000_000)
    )


BUDGET_MICRO = 5_000_000


@query(
    "budget_cutoff",
    "O-WIN11",
    with_views("v_model_calls")
    + f""", c AS (SELECT job_id, pos, tokens_in * 3 + tokens_out * 15 AS cost_micro_usd
      FROM v_model_calls WHERE status = 'ok'),
  s AS (SELECT *, cast(coalesce(sum(cost_micro_usd) OVER (PARTITION BY job_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS spent_before FROM c)
  SELECT job_id, pos, spent_before >= {BUDGET_MICRO} AS refused,
    CASE WHEN spent_before >= {BUDGET_MICRO} THEN 0 ELSE {BUDGET_MICRO} - spent_before END AS remaining
  FROM s""",
)
def budget_cutoff(t):
    ok = t.v_model_calls.filter("status = 'ok'").select(
        "job_id", "pos",
        op.call_cost_micro_usd(F.col("tokens_in"), F.col("tokens_out")).alias("cost_micro_usd"),
    )
    return op.budget_cutoff(ok, ["job_id"], BUDGET_MICRO).select(
        "job_id", "pos", "refused", "remaining"
    )


@query(
    "cache_hits",
    "O-WIN12",
    with_views("v_model_calls")
    + """, r AS (SELECT *, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM v_model_calls)
  SELECT model, count(*) AS calls, count(*) FILTER (WHERE stored = 1 AND NOT bypass_cache) AS hits
  FROM r GROUP BY model""",
)
def cache_hits(t):
    return op.cache_hits(t.v_model_calls).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cache_hit").alias("hits")
    )


@query(
    "peak_concurrency",
    "O-WIN14",
    with_views("v_attempts")
    + """, m AS (SELECT provider, at_us AS moment, 1 AS d FROM v_attempts
      UNION ALL SELECT provider, at_us + latency_ms * 60000000, -1 FROM v_attempts),
  n AS (SELECT provider, moment, sum(d) AS d FROM m GROUP BY provider, moment),
  r AS (SELECT provider, cast(sum(d) OVER (PARTITION BY provider ORDER BY moment) AS bigint) AS o FROM n)
  SELECT provider, max(o) AS peak, count(*) FILTER (WHERE o > 25) AS over_limit FROM r GROUP BY provider""",
)
def peak_concurrency(t):
    spans = t.v_attempts.withColumn("end_us", F.col("at_us") + F.col("latency_ms") * 60_000_000)
    return op.peak_concurrency(spans, ["provider"], "at_us", "end_us", 25)


BREAKER_RESET_MS = 3_600_000


@query(
    "breaker_calls",
    "O-WIN10",
    with_views("v_attempts", recursive=True)
    + f""", nx AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY pos) AS n FROM v_attempts),
  st(provider, n, pos, rejected, opens, fails, opened) AS (
    SELECT provider, 0::BIGINT, -1::BIGINT, false, false, 0, -1::BIGINT FROM (SELECT DISTINCT provider FROM v_attempts) p
    UNION ALL
    SELECT provider, n, pos, rej, trips, f, CASE WHEN trips THEN at_us WHEN rej THEN opened ELSE -1 END FROM (
      SELECT *, NOT rej AND NOT ok AND f >= 2 AS trips FROM (
        SELECT *, CASE WHEN rej THEN fails WHEN ok THEN 0 WHEN opened >= 0 THEN 1 ELSE fails + 1 END AS f FROM (
          SELECT st.provider, nx.n, nx.pos, nx.ok, nx.at_us, st.fails, st.opened,
            st.opened >= 0 AND nx.at_us < st.opened + {3_600_000 * 1000}::BIGINT AS rej
          FROM st JOIN nx ON nx.provider = st.provider AND nx.n = st.n + 1) a) b) c)
  SELECT provider, pos, rejected, opens FROM st WHERE n > 0""",
)
def breaker_calls(t):
    calls = t.v_attempts.select("provider", "pos", "at_us", "ok")
    return op.breaker_calls(calls, threshold=2, reset_ms=BREAKER_RESET_MS)


@query(
    "failure_streaks",
    "O-WIN10 streak report",
    with_views("v_attempts")
    + """, r AS (SELECT *, sum(cast(ok AS int)) OVER (PARTITION BY provider ORDER BY pos) AS run
      FROM v_attempts)
  SELECT provider, min(pos) AS from_pos, count(*) AS length FROM r WHERE NOT ok
  GROUP BY provider, run""",
)
def failure_streaks(t):
    return op.failure_streaks(t.v_attempts, ["provider"])
