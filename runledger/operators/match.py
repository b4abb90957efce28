"""Matching tasks to agents and tracking how reliable agents are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators.ordered import Ordered, scan_by_key


def capability_sets(tasks: DataFrame, spark: SparkSession) -> DataFrame:
    """Required set of each task (its kind plus extras), whether the agent type of the
    kind covers it, and the cheapest type per capability."""
    offers = fixed.agent_offers(spark)
    cheapest = F.create_map(*[F.lit(x) for pair in fixed.CHEAPEST_TYPE.items() for x in pair])
    kinds = fixed.kinds(spark).select("kind", F.col("required").alias("base"), "agent_type")
    return (
        tasks.join(F.broadcast(kinds), "kind")
        .join(F.broadcast(offers), "agent_type")
        .withColumn("required", F.array_union("base", "extra"))
        .withColumn("covered", F.size(F.array_except("required", "offered")) == 0)
        .withColumn("cheapest", F.array_distinct(F.transform("required", lambda c: cheapest[c])))
    )


ANY = "*"


def requirement_classes(tasks: DataFrame) -> DataFrame:
    """Distinct requirement sets. Tasks are many, the sets they ask for are few (they
    are subsets of a fixed list of capabilities), so matching runs once per set."""
    return tasks.select(class_key(F.col("required")).alias("class"), "required").groupBy("class").agg(
        F.any_value("required").alias("required")
    )


def class_key(required: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(required)), ",")


def candidates(classes: DataFrame, agents: DataFrame) -> DataFrame:
    """(class, agent) pairs where the agent is free and offers all that is required.

    An equi join on capability with a count in place of a nested loop. Every agent
    also offers ``*`` and every class asks for it, so an empty requirement matches all.
    """
    free = agents.filter(F.col("status").isin(fixed.AGENT_AVAILABLE))
    asks = classes.select(
        "class",
        F.size(F.array_distinct("required")).alias("n_required"),
        F.explode(F.array_union("required", F.array(F.lit(ANY)))).alias("capability"),
    )
    offers = free.select(
        "agent_id", F.explode(F.array_union("capabilities", F.array(F.lit(ANY)))).alias("capability")
    )
    met = (
        asks.join(offers, "capability")
        .groupBy("class", "n_required", "agent_id")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter(F.col("met") == F.col("n_required") + 1)
        .drop("met")
    )
    return met.join(free, "agent_id")


def score(weights: dict[str, float] | dict[str, Column] | None = None) -> Column:
    """Weighted mix of idleness, reliability, speed and fit; higher is better."""
    w = {k: F.lit(v) if isinstance(v, float) else v for k, v in (weights or fixed.DEFAULT_WEIGHTS).items()}
    zero, one = F.lit(0.0), F.lit(1.0)

    def unit(c: Column) -> Column:
        return F.greatest(zero, F.least(one, c))

    extra = F.greatest(F.size("capabilities") - F.col("n_required"), F.lit(0))
    return (
        w["load"] * (1.0 - unit(F.col("current_load")))
        + w["reliability"] * unit(F.col("success_rate"))
        + w["latency"] * (1000.0 / (1000.0 + F.col("latency_ms")))
        + w["specificity"] * (1.0 / (1.0 + extra))
    )


def pick_best(pairs: DataFrame, value: Column) -> DataFrame:
    """Agent with the highest value per class; among equals the last one."""
    return pairs.groupBy("class").agg(
        F.max_by("agent_id", F.struct(value, "agent_id")).alias("agent_id")
    )


def pick_least_loaded(pairs: DataFrame) -> DataFrame:
    """Least load, then least latency; among equals the first one."""
    order = F.struct("current_load", "latency_ms", "agent_id")
    return pairs.groupBy("class").agg(F.min_by("agent_id", order).alias("agent_id"))


def place(tasks: DataFrame, picks: DataFrame) -> DataFrame:
    """Give each task the pick of its class; null if no agent can take it."""
    return tasks.withColumn("class", class_key(F.col("required"))).join(picks, "class", "left")


def round_robin(tasks: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """The i-th decision takes candidate number i modulo the candidates of its class.

    Decisions are counted over all tasks that have a candidate, in task order.
    """
    pools = pairs.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    slots = Ordered(pairs.select("class", "agent_id"), ["class"], "agent_id", rows=rows)
    slots = slots.row_number("slot").done()
    chosen = tasks.withColumn("class", class_key(F.col("required"))).join(pools, "class")
    chosen = Ordered(chosen.withColumn("_all", F.lit(0)), ["_all"], "task_id", rows=rows)
    turn = (F.col("n_th") - 1) % F.col("size") + 1
    return (
        chosen.row_number("n_th").done().withColumn("slot", turn)
        .join(slots, ["class", "slot"]).drop("_all", "slot", "size", "n_th")
    )


def agent_demand(
    tasks: DataFrame, kinds: DataFrame, wanted: DataFrame, shape: DataFrame, cheapest: DataFrame
) -> DataFrame:
    """Tasks per agent type and job, rank of the type, and how many agents to hold.

    ``wanted`` (job_id, capability, max_agents) lists job-level requirements; a type
    nobody needs otherwise counts 1. Pool size is the widest wave or the number of
    types, whichever is more, within 1 and the job's limit.
    """
    waiting = F.col("state").isin("queued", "retry_scheduled")
    need = tasks.join(F.broadcast(kinds.select("kind", "agent_type")), "kind").groupBy("job_id", "agent_type").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(waiting).alias("waiting")
    )
    asked = wanted.join(F.broadcast(cheapest), "capability").select("job_id", "agent_type").distinct()
    extra = asked.join(need, ["job_id", "agent_type"], "left_anti").select(
        "job_id", "agent_type", F.lit(1).cast("bigint").alias("tasks"), F.lit(0).cast("bigint").alias("waiting")
    )
    limits = wanted.groupBy("job_id").agg(F.max("max_agents").alias("max_agents"))
    by_need = W.partitionBy("job_id").orderBy(F.desc("tasks"), "agent_type")
    types = F.count(F.lit(1)).over(W.partitionBy("job_id"))
    limit = F.coalesce("max_agents", F.lit(fixed.DEFAULT_MAX_AGENTS))
    size = F.greatest(F.lit(1), F.least(F.greatest("widest_wave", "types"), limit))
    return (
        need.unionByName(extra)
        .withColumn("rank", F.row_number().over(by_need))
        .withColumn("types", types)
        .join(shape.select("job_id", "widest_wave"), "job_id")
        .join(limits, "job_id", "left")
        .withColumn("pool_size", size.cast("bigint"))
        .drop("types", "widest_wave", "max_agents")
    )


def agent_totals(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("agent_id").agg(
        F.count_if("ok").alias("tasks_completed"), F.count_if(~F.col("ok")).alias("tasks_failed")
    )


def _ewma(value: Column, start: float, alpha: float) -> tuple[Column, Column]:
    """Weighted sum form of an exponential mean: ``_age`` counts rows after this one."""
    keep = 1.0 - alpha
    part = F.sum(F.pow(F.lit(keep), F.col("_age")) * alpha * value)
    return part, F.pow(F.lit(keep), F.count(F.lit(1))) * start


def success_ewma(attempts: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Exponential mean of success per key, from 1.0, newest row weighing most.

    The recurrence is linear, so it equals a weighted sum whose weights depend on how
    many rows follow. Numbering backwards is block-wise and the sum is partial, hence
    a key of any size is spread over many tasks.
    """
    aged = Ordered(attempts, keys, "pos", descending=True, rows=rows).row_number("_n").done()
    aged = aged.withColumn("_age", F.col("_n") - 1)
    part, rest = _ewma(F.col("ok").cast("double"), 1.0, fixed.EWMA_ALPHA)
    return aged.groupBy(*keys).agg((part + rest).alias("success_rate"))


def adaptive_weights(outcomes: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Placement weights that follow success and queue wait (ok, queue_wait_ms)."""
    aged = Ordered(outcomes, keys, "pos", descending=True, rows=rows).row_number("_n").done()
    aged = aged.withColumn("_age", F.col("_n") - 1)
    ok, ok_rest = _ewma(F.col("ok").cast("double"), 1.0, fixed.EWMA_ALPHA)
    wait, _ = _ewma(F.col("queue_wait_ms").cast("double"), 0.0, fixed.EWMA_ALPHA)
    s, w = F.col("success"), F.col("wait")
    return (
        aged.groupBy(*keys)
        .agg((ok + ok_rest).alias("success"), wait.alias("wait"))
        .withColumn("reliability", 1.0 + (1.0 - s) * 3.0)
        .withColumn("load", 1.0 + F.least(w / 1000.0, F.lit(2.0)))
        .withColumn("latency", 0.5 + F.least(1.0 - s, F.lit(0.5)))
    )


#: Calls over which a mean forgets where it started, but for a few values.
SHORT_BLOCK = 64


def latency_ewma(attempts: DataFrame, rows: int | None = None) -> DataFrame:
    """Whole-number smoothed latency per agent: first value, then (4 * mean + x) div 5.

    Rounding at each step makes this a true fold, but one that forgets: a block maps the
    whole range of starting means to very few ends, in rising order. That map, kept as
    runs of equal ends and found by halving the ranges whose ends differ, is all a block
    has to tell, so the blocks of a busy agent run side by side. A block too short to
    forget tells its values instead.
    """
    need = attempts.select("agent_id", "pos", "latency_ms")
    highest = int(need.agg(F.coalesce(F.max("latency_ms"), F.lit(0))).first()[0])

    def fold(means: np.ndarray, values: list[int]) -> np.ndarray:
        for x in values:
            means = np.where(means == 0, x, (4 * means + x) // 5)
        return means

    def trace(means: np.ndarray, values: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where means end, and when they first are zero. A lower start is zero no later, and
        starts that are zero at the same time go on alike; the others keep their order."""
        zero = np.full(len(means), len(values))
        for i, x in enumerate(values):
            means = np.where(means == 0, x, (4 * means + x) // 5)
            zero = np.where(means == 0, np.minimum(zero, i), zero)
        return means, zero

    def summarise(pdf: pd.DataFrame) -> dict:
        values = pdf["latency_ms"].tolist()
        if len(values) <= SHORT_BLOCK:
            return {"starts": [], "ends": [], "values": values}
        low, high = np.array([min(1, highest)]), np.array([highest])
        (at, at_zero), (end, end_zero) = trace(low, values), trace(high, values)
        starts, found = [0, *low.tolist()], [*fold(np.zeros(1, dtype=np.int64), values).tolist(), *at.tolist()]
        while len(low):
            differ = (at != end) | (at_zero != end_zero)
            low, high, at, end, at_zero, end_zero = (v[differ] for v in (low, high, at, end, at_zero, end_zero))
            close = high - low <= 1
            starts += high[close].tolist()
            found += end[close].tolist()
            low, high, at, end, at_zero, end_zero = (v[~close] for v in (low, high, at, end, at_zero, end_zero))
            middle = (low + high) // 2
            half, half_zero = trace(middle, values)
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
            at, end = np.concatenate([at, half]), np.concatenate([half, end])
            at_zero, end_zero = np.concatenate([at_zero, half_zero]), np.concatenate([half_zero, end_zero])
        runs = sorted(zip(starts, found))
        return {"starts": [s for s, _ in runs], "ends": [e for _, e in runs], "values": []}

    def advance(block: dict, state: dict | None) -> dict:
        mean = int(state["mean"]) if state else 0
        if len(block["values"]):
            return {"mean": int(fold(np.array([mean]), list(block["values"]))[0])}
        i = int(np.searchsorted(np.asarray(block["starts"]), mean, "right")) - 1
        return {"mean": int(block["ends"][i])}

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        mean = int(state["mean"]) if state else 0
        for x in pdf["latency_ms"].tolist():
            mean = x if mean == 0 else (4 * mean + x) // 5
        out = pd.DataFrame(
            {"agent_id": [pdf["agent_id"].iloc[0]], "average_latency_ms": [mean], "upto": [int(pdf["pos"].iloc[-1])]}
        )
        return out, {"mean": mean}

    folded = scan_by_key(
        need, ["agent_id"], "pos", step, summarise, advance,
        "agent_id BIGINT, average_latency_ms BIGINT, upto BIGINT", "mean BIGINT",
        "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, values ARRAY<BIGINT>", rows,
    )
    return folded.groupBy("agent_id").agg(F.max_by("average_latency_ms", "upto").alias("average_latency_ms"))
