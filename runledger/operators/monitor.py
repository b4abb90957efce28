"""Monitoring tables: metrics, job views, cluster view, event gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators.ordered import Ordered

GAUGES = ["jobs_active", "queue_ready", "queue_delayed", "queue_leased", "dead_letter_depth", "cluster_agents"]
COUNTERS = [
    "tasks_enqueued_total", "tasks_acknowledged_total", "tasks_retried_total", "leases_expired_total",
    "model_requests_total", "model_cache_hits_total", "model_failures_total", "tokens_in_total",
    "tokens_out_total", "cost_usd_total",
]


def active(status: Column) -> Column:
    return ~status.isin(fixed.JOB_FINISHED)


def metrics_snapshot(spark: SparkSession, sources: dict[str, DataFrame], jobs: DataFrame) -> DataFrame:
    """(metric, type, label, value): gauges, counters and jobs by status.

    ``sources`` holds one-row relations whose columns are named after metrics; each is
    unpivoted. Statuses nobody is in are filled with 0, as are metrics nobody supplied.
    """
    names = [(m, "gauge") for m in GAUGES] + [(m, "counter") for m in COUNTERS]
    known = fixed.values_table(spark, "metric, type", names)
    values = None
    for source in sources.values():
        long = source.select(*[F.col(c).cast("double").alias(c) for c in source.columns]).unpivot(
            [], source.columns, "metric", "value"
        )
        values = long if values is None else values.unionByName(long)
    plain = known.join(values, "metric", "left").select(
        "metric", "type", F.lit("").alias("label"), F.coalesce("value", F.lit(0.0)).alias("value")
    )
    shown = fixed.values_table(spark, "status", [(s,) for s in fixed.JOB_STATUS_SHOWN])
    by_status = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    labelled = shown.join(by_status, "status", "left").select(
        F.lit("jobs_total").alias("metric"),
        F.lit("gauge").alias("type"),
        F.concat(F.lit("status="), "status").alias("label"),
        F.coalesce("n", F.lit(0)).cast("double").alias("value"),
    )
    return plain.unionByName(labelled)


def job_views(jobs: DataFrame, counts: DataFrame, statistics: DataFrame, agents: DataFrame) -> DataFrame:
    """State of every job, newest first (ids sort by creation)."""
    held = agents.groupBy("job_id").agg(F.count(F.lit(1)).alias("active_agents"))
    return (
        jobs.join(counts, "job_id", "left")
        .join(statistics.select("job_id", "tokens_in", "tokens_out", "cost_micro_usd"), "job_id", "left")
        .join(held, "job_id", "left")
        .withColumn("tokens_used", F.coalesce(F.col("tokens_in") + F.col("tokens_out"), F.lit(0)))
        .withColumn("active_agents", F.coalesce("active_agents", F.lit(0)))
        .drop("tokens_in", "tokens_out")
        .orderBy(F.desc("job_id"))
    )


def cluster_view(jobs: DataFrame, queue: DataFrame, usage: DataFrame, agents: DataFrame) -> DataFrame:
    """One row for the whole cluster; each input is a one-row aggregate by then."""
    n_jobs = jobs.agg(F.count_if(active(F.col("status"))).alias("jobs_active"), F.count(F.lit(1)).alias("jobs_total"))
    n_agents = agents.agg(F.count(F.lit(1)).alias("cluster_agents"))
    parts = [n_jobs, queue, usage, n_agents]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for part in parts for c in part.columns])


def event_gaps(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Holes in the sequence numbers of each job's events."""
    prev = Ordered(events, ["job_id"], "seq", rows=rows).shift({"previous": "seq"}).done()
    return prev.filter(F.col("seq") - F.col("previous") > 1).select(
        "job_id", (F.col("previous") + 1).alias("from_seq"), (F.col("seq") - 1).alias("to_seq")
    )


def union_once(live: DataFrame, replayed: DataFrame) -> DataFrame:
    """Live and replayed events together, each (job, sequence) once."""
    return live.unionByName(replayed).dropDuplicates(["job_id", "seq"])


def events_after(events: DataFrame, seq: int, kinds: list[str] | None = None) -> DataFrame:
    """Events past a sequence number, for batch and stream alike."""
    out = events.filter(F.col("seq") > seq)
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def job_artifacts(job_id: object, jobs: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The rows of one job in each table. An unknown job is an error, not an empty answer."""
    if jobs.filter(F.col("job_id") == job_id).isEmpty():
        raise LookupError(f"no such job: {job_id}")
    return {name: df.filter(F.col("job_id") == job_id) for name, df in tables.items()}


def artifact_index(**tables: DataFrame) -> DataFrame:
    """How many rows of each kind every job has."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).withColumn("artifact", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
