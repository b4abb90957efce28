"""State of tasks and jobs, derived from the log of their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators.ordered import Ordered


def is_terminal(state: Column) -> Column:
    return state.isin(fixed.TASK_TERMINAL)


def in_group(state: Column, group: str) -> Column:
    return state.isin([s for s, g in fixed.TASK_GROUP.items() if g == group])


def classify_states(tasks: DataFrame, kinds: DataFrame) -> DataFrame:
    """Flags per task: terminal, in flight, reportable kind, lifecycle group."""
    state = F.col("state")
    group = F.lit(None).cast("string")
    for name in ("pending", "queued", "in_flight", "completed", "retrying", "abandoned"):
        group = F.coalesce(group, F.when(in_group(state, name), name))
    return (
        tasks.join(kinds.select("kind", "reportable"), "kind", "left")
        .withColumn("terminal", is_terminal(state))
        .withColumn("in_flight", in_group(state, "in_flight"))
        .withColumn("state_group", group)
    )


def latest_state(transitions: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Last transition per task, optionally as of a time.

    ``resume_state`` is what a task restarts from: a terminal state stays, anything
    else was in flight and goes back to ``created``. Spent attempts keep counting.
    The fold is one partially aggregated ``max_by``; no task's log is collected. State
    and attempt travel in one number, so the aggregate hashes and need not sort. A state
    that does not exist fails the read.
    """
    if as_of_us is not None:
        transitions = transitions.filter(F.col("at_us") <= as_of_us)
    states = F.array(*[F.lit(name) for name in fixed.TASK_STATES])
    code = F.array_position(states, F.col("to_state"))
    known = F.when(code > 0, code).otherwise(
        F.raise_error(F.concat(F.lit("unknown task state "), "to_state")).cast("bigint")
    )
    packed = F.shiftleft(known, 32) + F.coalesce("attempt", F.lit(0))
    last = transitions.groupBy("job_id", "task_id").agg(F.max_by(packed, "pos").alias("last"))
    named = last.select(
        "job_id",
        "task_id",
        F.element_at(states, F.shiftright("last", 32).cast("int")).alias("state"),
        F.col("last").bitwiseAND(2**32 - 1).cast("int").alias("attempt"),
    )
    state = F.col("state")
    return named.withColumn("resume_state", F.when(is_terminal(state), state).otherwise("created"))


def job_status(changes: DataFrame, planned: DataFrame, resumed: DataFrame) -> DataFrame:
    """Last status per planned job; an unfinished one is rewound to ``planning``.

    ``changes`` (job_id, status, pos); ``planned`` (job_id, status); ``resumed``
    (job_id, n) counts tasks put back. Jobs with records but no plan come back with
    an error instead of a status.
    """
    last = changes.groupBy("job_id").agg(F.max_by("status", "pos").alias("changed"))
    out = planned.withColumn("was_planned", F.lit(True)).join(last, "job_id", "full")
    status = F.coalesce("changed", "status")
    done = status.isin(fixed.JOB_FINISHED)
    n = F.coalesce("n", F.lit(0))
    note = F.concat(F.lit("recovered from journal, "), n.cast("string"), F.lit(" tasks re-queued"))
    headless = F.col("was_planned").isNull()
    return out.join(resumed, "job_id", "left").select(
        "job_id",
        F.when(headless, None).when(done, status).otherwise("planning").alias("status"),
        F.when(headless | done, None).otherwise(note).alias("status_reason"),
        F.when(headless, "records for a job it never planned").alias("error"),
    )


def lifecycle_counts(tasks: DataFrame) -> DataFrame:
    """Per job: tasks by lifecycle group, progress, completeness and verdict."""
    groups = ("pending", "queued", "in_flight", "completed", "retrying", "abandoned")
    counts = tasks.groupBy("job_id").agg(
        *[F.count_if(in_group(F.col("state"), g)).alias(g) for g in groups],
        F.count(F.lit(1)).alias("total"),
    )
    terminal = F.col("completed") + F.col("abandoned")
    return counts.withColumn("progress", F.try_divide(terminal, "total")).withColumn(
        "is_complete", (F.col("total") > 0) & (terminal == F.col("total"))
    )


def job_verdict(counts: DataFrame, cancelled: Column) -> DataFrame:
    done = (F.col("abandoned") == 0) & (F.col("completed") == F.col("total"))
    return counts.withColumn(
        "verdict",
        F.when(cancelled, "cancelled")
        .when(done, "completed")
        .when(F.col("completed") > 0, "partially_completed")
        .otherwise("failed"),
    )


def audit_transitions(
    transitions: DataFrame, edges: DataFrame, keys: list[str], rows: int | None = None
) -> DataFrame:
    """Judge each transition against the allowed edges and the one before it.

    ``edges`` (entity, from_state, to_state) is a small relation and may describe any
    state machine. Adds ``previous_state``, ``legal`` (the edge from the previous
    state is allowed, a first row is), ``continuous`` (the declared ``from_state``
    equals the previous state) and ``after_terminal`` (the previous state has no way
    out).
    """
    shifted = Ordered(transitions, ["entity", *keys], "pos", rows=rows).shift(
        {"previous_state": "to_state"}
    )
    allowed = edges.select(
        "entity",
        F.col("from_state").alias("previous_state"),
        "to_state",
        F.lit(True).alias("allowed"),
    )
    has_exit = edges.select(
        "entity", F.col("from_state").alias("previous_state"), F.lit(True).alias("open")
    ).distinct()
    first = F.col("previous_state").isNull()
    return (
        shifted.done()
        .join(F.broadcast(allowed), ["entity", "previous_state", "to_state"], "left")
        .join(F.broadcast(has_exit), ["entity", "previous_state"], "left")
        .withColumn("legal", first | F.col("allowed").isNotNull())
        .withColumn("after_terminal", ~first & F.col("open").isNull())
        .withColumn("continuous", F.col("from_state").eqNullSafe(F.col("previous_state")))
        .drop("allowed", "open")
    )


def dwell(transitions: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Whole milliseconds each task spent in each state before leaving it."""
    nxt = Ordered(transitions, keys, "pos", rows=rows).shift({"left_us": "at_us"}, back=False)
    ms = F.floor((F.col("left_us") - F.col("at_us")) / 1000)
    return nxt.done().withColumn("dwell_ms", F.greatest(F.lit(0), ms).cast("bigint"))


def queue_waits(leases: DataFrame) -> DataFrame:
    """``queue_wait_ms`` before the grant (never negative) and ``held_ms`` after it."""
    wait = F.floor((F.col("granted_us") - F.col("enqueued_us")) / 1000).cast("bigint")
    held = F.floor((F.col("released_us") - F.col("granted_us")) / 1000).cast("bigint")
    return leases.withColumn("queue_wait_ms", F.greatest(F.lit(0), wait)).withColumn(
        "held_ms", held
    )


def cancellation_steps(tasks: DataFrame) -> DataFrame:
    """Transitions that close every open task of a cancelled job.

    A running task must fail before it can be parked, so it gets two rows.
    """
    def move(step: int, source: Column, target: str) -> Column:
        return F.struct(
            F.lit(step).alias("step"), source.alias("from_state"), F.lit(target).alias("to_state")
        )

    two = F.array(move(1, F.col("state"), "failed"), move(2, F.lit("failed"), "dead_lettered"))
    one = F.array(move(1, F.col("state"), "cancelled"))
    return (
        tasks.filter(~is_terminal(F.col("state")))
        .withColumn("s", F.explode(F.when(F.col("state") == "running", two).otherwise(one)))
        .select("job_id", "task_id", "s.step", "s.from_state", "s.to_state",
                F.lit("job_cancelled").alias("reason"))
    )
