"""Queue tables: visibility, ranking, deduplication, retry, dead letters, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed

PUSHED_LIMIT = 1000
SALTS = 256


def is_visible(as_of_us: int) -> Column:
    return F.col("available_us") <= as_of_us


def is_past(expires: Column, as_of_us: int) -> Column:
    """A null expiry never passes."""
    return F.coalesce(expires <= as_of_us, F.lit(False))


def past_deadline(
    deadline_us: Column, started_us: Column, max_runtime_s: Column, as_of_us: int
) -> Column:
    elapsed = F.floor((F.lit(as_of_us) - started_us) / 1_000_000)
    over = (elapsed >= 0) & (elapsed >= max_runtime_s)
    return is_past(deadline_us, as_of_us) | F.coalesce(over, F.lit(False))


def backoff_ms(attempt: Column, base: Column, cap: Column, jitter: Column, nonce: Column) -> Column:
    """Wait before the next attempt: doubled per attempt, capped, optionally spread.

    The shift is at most 20 places, and a product that does not fit is above any cap.
    """
    shift = F.when(attempt > 20, 20).otherwise(F.greatest(attempt - 1, F.lit(0))).cast("int")
    factor = F.pow(F.lit(2), shift).cast("bigint")
    raw = F.coalesce(F.try_multiply(base.cast("bigint"), factor), cap)
    capped = F.least(raw, cap)
    half = F.floor(capped / 2)
    spread = half + nonce % (capped - half + 1)
    plain = F.when(jitter & (capped > 0), spread).otherwise(capped)
    return F.when(base == 0, 0).otherwise(plain).cast("bigint")


def retry_or_park(
    failed: DataFrame,
    max_attempts: int = fixed.RETRY_MAX_ATTEMPTS,
    base_ms: int = fixed.RETRY_BASE_MS,
    max_ms: int = fixed.RETRY_MAX_MS,
    jitter: bool = True,
    nonce: Column | None = None,
) -> DataFrame:
    """Decide each failed attempt: ``retry`` with the time it is due, or ``park``.

    Needs ``attempt``, ``failed_us`` and ``reason``; both outcomes stay in one
    relation so that a sink can split them without evaluating it twice.
    """
    may = F.col("attempt") < max_attempts
    wait = backoff_ms(
        F.col("attempt"), F.lit(base_ms), F.lit(max_ms), F.lit(jitter),
        nonce if nonce is not None else F.col("failed_us") % 1_000_000,
    )
    return (
        failed.withColumn("decision", F.when(may, "retry").otherwise("park"))
        .withColumn("wait_ms", F.when(may, wait).otherwise(0))
        .withColumn("due_us", F.when(may, F.col("failed_us") + F.col("wait_ms") * 1000).otherwise(0))
        .withColumn("last_error", F.when(may, "").otherwise(F.col("reason")))
    )


def replay_dead_letters(queue: DataFrame, letters: DataFrame, chosen: DataFrame, now_us: int):
    """Chosen letters go back as available now with their attempt count unchanged.

    Returns the new queue and the letters left. The dedup of producers is bypassed.
    """
    back = letters.join(chosen.select("task_id").distinct(), "task_id", "left_semi").withColumn(
        "available_us", F.lit(now_us)
    )
    left = letters.join(chosen.select("task_id").distinct(), "task_id", "left_anti")
    return queue.unionByName(back.select(queue.columns)), left


def first_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keep the first row per key. Partial aggregation, no window: copies of one key
    collapse before the shuffle however many there are."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("r")).select(
        *key, *[F.col(f"r.{c}").alias(c) for c in others]
    )


def enqueue_counts(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows admitted and rows dropped as repeats of a key seen before."""
    per_key = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by).agg(
        F.count(F.lit(1)).alias("enqueued"), F.sum(F.col("n") - 1).alias("deduplicated")
    )


def may_take(required: Column, offered: Column) -> Column:
    """An empty offer is no filter."""
    return (F.size(offered) == 0) | (F.size(F.array_except(required, offered)) == 0)


def top_k(
    entries: DataFrame, k: int, as_of_us: int, offered: list[str] | None = None,
    queues: list[str] | None = None,
) -> DataFrame:
    """The ``k`` entries per queue to hand out next.

    Filters come before the ranking; ``rank <= k`` is pushed below the shuffle, so
    each task forwards at most ``k`` rows per queue. Spark does that for limits up to
    1000 only; for larger ones each of ``SALTS`` parts of a queue is cut to its best
    ``k`` first, which loses nothing and keeps a long queue out of a single sort.
    """
    seen = entries.filter(is_visible(as_of_us))
    if queues:
        seen = seen.filter(F.col("queue").isin(queues))
    if offered:
        seen = seen.filter(F.col("required").isin(offered))
    order = [F.desc("priority"), F.asc("enqueued_us"), F.asc("task_id")]
    if k > PUSHED_LIMIT:
        part = W.partitionBy("queue", "_salt").orderBy(*order)
        seen = seen.withColumn("_salt", F.pmod(F.xxhash64("task_id"), F.lit(SALTS)))
        seen = seen.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k).drop("_salt")
    ranked = seen.withColumn("rank", F.row_number().over(W.partitionBy("queue").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def pair_with_workers(entries: DataFrame, workers: DataFrame, as_of_us: int) -> DataFrame:
    """The n-th best entry of a queue goes to the n-th free worker of that queue.

    Only as many entries as there are workers can be served, so entries beyond the
    largest pool are cut off map-side by the bounded rank.
    """
    pool = W.partitionBy("queue").orderBy("worker")
    ranked = workers.withColumn("rank", F.row_number().over(pool))
    widest = ranked.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    return top_k(entries, int(widest), as_of_us).join(ranked, ["queue", "rank"])


def queue_statistics(entries: DataFrame, by: list[str], as_of_us: int) -> DataFrame:
    """One pass over tagged rows (``place``: ready | leased | dead) as of a time."""
    ready = (F.col("place") == "ready") & is_visible(as_of_us)
    out = entries.groupBy(*by).agg(
        F.count_if(ready).alias("ready"),
        F.count_if((F.col("place") == "ready") & ~is_visible(as_of_us)).alias("delayed"),
        F.count_if(F.col("place") == "leased").alias("leased"),
        F.count_if(F.col("place") == "dead").alias("dead_lettered"),
        F.count(F.lit(1)).alias("enqueued_total"),
    )
    return out.withColumn("depth", F.col("ready") + F.col("delayed") + F.col("leased"))


def purge_jobs(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    return rows.join(doomed.select("job_id").distinct(), "job_id", "left_anti")


def purge_counts(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    gone = rows.join(doomed.select("job_id").distinct(), "job_id", "left_semi")
    return gone.groupBy("job_id").agg(F.count(F.lit(1)).alias("purged"))


def leasable(deliveries: DataFrame, states: DataFrame) -> DataFrame:
    """Deliveries whose task is still waiting to run."""
    waiting = states.filter(F.col("state").isin("queued", "retry_scheduled")).select("task_id")
    return deliveries.join(waiting, "task_id", "left_semi")


def serve_stored(deliveries: DataFrame, published: DataFrame) -> DataFrame:
    """Serve a delivery from the first published result of its task, if there is one."""
    first = published.groupBy("task_id").agg(F.min_by("result_id", "pos").alias("stored_result"))
    return deliveries.join(first, "task_id", "left").withColumn(
        "deduplicated", F.col("stored_result").isNotNull()
    )


def idle_agents(agents: DataFrame, cutoff_us: int, queue_depth: Column) -> DataFrame:
    """Idle agents to reclaim: last active before the cutoff, one per pool is kept,
    nothing while work is waiting.

    Available agents are dropped in the order of their ids; if every agent of a pool
    is stale the last one stays.
    """
    stale = F.col("status").isin(fixed.AGENT_AVAILABLE) & (F.col("last_active_us") < cutoff_us)
    flagged = agents.withColumn("stale", stale)
    pools = flagged.groupBy("pool").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if("stale").alias("n_stale"),
        F.max(F.when(F.col("stale"), F.col("agent_id"))).alias("last_stale"),
    )
    spared = (F.col("size") == F.col("n_stale")) & (F.col("agent_id") == F.col("last_stale"))
    return (
        flagged.filter("stale")
        .join(pools, "pool")
        .filter(~spared & (queue_depth == 0))
        .select("pool", "agent_id")
    )
