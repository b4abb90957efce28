"""Latency, tokens, cost, cache, breaker, budget and concurrency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions import text
from runledger.operators.ordered import Ordered, scan_by_key


def latency_percentiles(
    rows: DataFrame, keys: list[str], value: str = "latency_ms", prefix: str = "p"
) -> DataFrame:
    """Nearest-rank p50, p95 and p99 per key.

    Values are whole milliseconds, so rows are first counted per ``(key, value)``;
    what is ordered afterwards is the histogram, whose size is the number of distinct
    milliseconds and not the number of rows.
    """
    histogram = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = histogram.withColumn(
        "upto", F.sum("n").over(W.partitionBy(*keys).orderBy("v"))
    ).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))

    def nearest(percent: int) -> Column:
        # upto >= ceil(percent * total / 100), in whole numbers
        reached = F.col("upto") * 100 >= F.col("total") * percent
        return F.min(F.when(reached, F.col("v"))).alias(f"{prefix}{percent}_ms")

    return ranked.groupBy(*keys).agg(nearest(50), nearest(95), nearest(99))


def call_cost_micro_usd(
    tokens_in: Column,
    tokens_out: Column,
    price_in: Column | int = fixed.PRICE_IN_PER_MILLION,
    price_out: Column | int = fixed.PRICE_OUT_PER_MILLION,
) -> Column:
    """Price in millionths of a dollar; a price per million tokens is exactly that per token."""
    return tokens_in * price_in + tokens_out * price_out


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost each call by the price row of its model that was valid at the time.

    ``prices`` (model, valid_from_us, price_in, price_out) is a dimension; a model
    without a row gets the default price.
    """
    later = W.partitionBy("model").orderBy("valid_from_us")
    spans = prices.withColumn("valid_to_us", F.lead("valid_from_us").over(later))
    c, p = calls.alias("c"), spans.alias("p")
    hit = (
        (F.col("c.model") == F.col("p.model"))
        & (F.col("c.at_us") >= F.col("p.valid_from_us"))
        & (F.col("p.valid_to_us").isNull() | (F.col("c.at_us") < F.col("p.valid_to_us")))
    )
    cost = call_cost_micro_usd(
        F.col("c.tokens_in"),
        F.col("c.tokens_out"),
        F.coalesce("p.price_in", F.lit(fixed.PRICE_IN_PER_MILLION)),
        F.coalesce("p.price_out", F.lit(fixed.PRICE_OUT_PER_MILLION)),
    )
    return c.join(p, hit, "left").select("c.*", cost.alias("cost_micro_usd"))


def execution_statistics(
    results: DataFrame, failures: DataFrame, tasks: DataFrame, count_failed_calls: bool = False
) -> DataFrame:
    """Per job counters that can be recomputed from what happened.

    Wall clock and queue waits are not in the log and stay 0. ``count_failed_calls``
    adds failed attempts to ``model_requests``, as a live counter would.
    """
    good = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("tasks_succeeded"),
        F.count_if(~F.col("deduplicated")).alias("model_requests"),
        F.count_if("deduplicated").alias("model_cache_hits"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum(call_cost_micro_usd(F.col("tokens_in"), F.col("tokens_out"))).alias("cost_micro_usd"),
    )
    bad = failures.groupBy("job_id").agg(
        F.count_if("dead_lettered").alias("tasks_failed"),
        F.count_if(~F.col("dead_lettered")).alias("tasks_retried"),
    )
    total = tasks.groupBy("job_id").agg(F.count(F.lit(1)).alias("tasks_total"))
    shares = latency_percentiles(results, ["job_id"], "duration_ms")
    out = total.join(good, "job_id", "full").join(bad, "job_id", "full")
    out = out.join(shares, "job_id", "left").na.fill(0)
    if count_failed_calls:
        failed = F.col("tasks_failed") + F.col("tasks_retried")
        out = out.withColumn("model_requests", F.col("model_requests") + failed)
    return out.withColumn("wall_clock_ms", F.lit(0).cast("bigint"))


def coordination_overhead(wall_ms: Column, task_ms: Column, parallelism: Column) -> Column:
    """Share of wall time not explained by perfectly parallel task time."""
    share = (wall_ms - task_ms / parallelism) / wall_ms
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when((wall_ms == 0) | (parallelism == 0), 0.0).otherwise(bounded)


def usage_rollup(calls: DataFrame, levels: list[str]) -> DataFrame:
    """Usage at every level of ``levels`` and in total. A cache hit costs nothing."""
    reached = F.col("status").isin("ok", "error", "rate_limited")
    served = F.col("status") == "ok"
    cost = call_cost_micro_usd(F.col("tokens_in"), F.col("tokens_out"))
    return calls.rollup(*levels).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count_if(reached).alias("requests"),
        F.count_if(F.col("status") == "cached").alias("cache_hits"),
        F.count_if(F.col("status").isin("error", "rate_limited")).alias("failures"),
        F.count_if(reached & F.col("fell_back")).alias("fallbacks"),
        F.count_if(F.col("status") == "circuit_open").alias("circuit_rejections"),
        F.sum(F.when(served, F.col("tokens_in")).otherwise(0)).alias("tokens_in"),
        F.sum(F.when(served, F.col("tokens_out")).otherwise(0)).alias("tokens_out"),
        F.sum(F.when(served, cost).otherwise(0)).alias("cost_micro_usd"),
    )


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """Prompt tokens (whitespace words of all messages) and the last user message.

    Only its turn goes through the aggregate; the text is looked up afterwards.
    """
    words = text.word_count(F.col("content"))
    user = F.when(F.col("role") == "user", F.col("turn"))
    per = messages.groupBy("request_id").agg(
        F.sum(words).cast("bigint").alias("prompt_tokens"), F.max(user).alias("turn")
    )
    said = messages.select("request_id", "turn", F.col("content").alias("last_user_message"))
    return per.join(said, ["request_id", "turn"], "left").select(
        "request_id", "prompt_tokens", F.coalesce("last_user_message", F.lit("")).alias("last_user_message")
    )


def budget_cutoff(calls: DataFrame, keys: list[str], budget: int, rows: int | None = None) -> DataFrame:
    """Refuse a call once the spend before it has reached the budget.

    Costs are never negative, so the running sum crosses the budget once and a prefix
    sum decides every call. The spend of refused calls does not count.
    """
    spent = Ordered(calls, keys, "pos", rows=rows).running_sum(
        F.col("cost_micro_usd"), "spent_before", inclusive=False
    )
    return (
        spent.done()
        .withColumn("refused", F.col("spent_before") >= budget)
        .withColumn(
            "remaining",
            F.when(F.col("refused"), 0).otherwise(F.greatest(F.lit(0), budget - F.col("spent_before"))),
        )
    )


def cache_hits(calls: DataFrame) -> DataFrame:
    """Mark calls whose fingerprint was already answered and which did not bypass the cache.

    Only a call of status ok stores an answer. The first per fingerprint is a partial
    aggregate joined back, not a window, so one very popular fingerprint is not sorted
    in one task.
    """
    stored = F.when(F.col("status") == "ok", F.col("pos"))
    first = calls.groupBy("fingerprint").agg(F.min(stored).alias("first_pos"))
    hit = F.coalesce(F.col("pos") > F.col("first_pos"), F.lit(False)) & ~F.col("bypass_cache")
    return calls.join(first, "fingerprint").withColumn("cache_hit", hit).drop("first_pos")


def peak_concurrency(
    spans: DataFrame, keys: list[str], start: str, end: str, limit: int, rows: int | None = None
) -> DataFrame:
    """Most spans open at once per key, and instants at which more than ``limit`` are.

    Starts and ends at the same instant are netted first, so a handover is not a peak,
    and only one row per ``(key, instant)`` is ordered.
    """
    marks = (
        spans.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d"))
        .unionByName(spans.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d")))
        .groupBy(*keys, "at")
        .agg(F.sum("d").alias("d"))
    )
    held = Ordered(marks, keys, "at", rows=rows).running_sum(F.col("d"), "open")
    return held.done().groupBy(*keys).agg(
        F.max("open").alias("peak"), F.count_if(F.col("open") > limit).alias("over_limit")
    )


BREAKER_OUT = "provider STRING, pos BIGINT, rejected BOOLEAN, opens BOOLEAN"
BREAKER_STATE = "failures BIGINT, opened_us BIGINT"
BREAKER_SUMMARY = """last_us BIGINT, closed_failures ARRAY<BIGINT>, closed_opened ARRAY<BIGINT>,
  release_us ARRAY<BIGINT>, release_failures ARRAY<BIGINT>, release_opened ARRAY<BIGINT>"""


class _Breaker:
    """Breaker moves over an ordered batch of calls. ``opened`` is -1 while closed."""

    def __init__(self, rows: pd.DataFrame, threshold: int, reset_us: int) -> None:
        self.at, ok = rows["at_us"].to_numpy(), rows["ok"].to_numpy(dtype=bool)
        self.n, self.threshold, self.reset = len(rows), threshold, reset_us
        index = np.arange(self.n)
        self.streak = index - np.maximum.accumulate(np.where(ok, index, -1))
        self.long_enough = np.flatnonzero(self.streak >= threshold)
        self.first_ok = int(np.argmax(ok)) if ok.any() else self.n

    def resume(self, release_us: int) -> int:
        """First call at or after a time."""
        return int(np.searchsorted(self.at, release_us, "left"))

    def trip(self, here: int, failures: int) -> int:
        """Call that opens a breaker closed at ``here``; ``n`` if none does. Failures
        carried in only exist at the start of the batch."""
        if failures and self.first_ok >= self.threshold - failures:
            return self.threshold - failures - 1
        nth = int(np.searchsorted(self.long_enough, here + self.threshold - 1))
        return int(self.long_enough[nth]) if nth < len(self.long_enough) else self.n

    def left_closed(self, here: int, failures: int) -> int:
        """Streak at the end of the batch when nothing opens from ``here`` on."""
        if failures and self.first_ok == self.n:
            return self.n + failures
        return min(int(self.streak[-1]), self.n - here)

    def exit(self, here: int, failures: int, memo: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """(failures, opened) at the end of the batch, from closed at ``here``."""
        passed = []
        while True:
            trip = self.trip(here, failures)
            if trip == self.n:
                end = (self.left_closed(here, failures), -1)
                break
            if trip in memo:
                end = memo[trip]
                break
            passed.append(trip)
            here, failures = self.resume(int(self.at[trip]) + self.reset), 0
            if here == self.n:
                end = (0, int(self.at[trip]))
                break
        memo.update(dict.fromkeys(passed, end))
        return end


def breaker_calls(
    calls: DataFrame,
    threshold: int = fixed.BREAKER_THRESHOLD,
    reset_ms: int = fixed.BREAKER_RESET_MS,
    rows: int | None = None,
) -> DataFrame:
    """Replay the breaker of each provider over its calls (provider, pos, at_us, ok).

    A streak of ``threshold`` failures opens it; calls are rejected until ``reset_ms``
    have passed; then the streak restarts from 0 with the next call. Providers are few
    and busy, so their calls are cut into blocks that are summed up independently: the
    outcome for each streak length it may start with, and, if it starts open, for each
    call within one reset time that may be the first to pass. ``at_us`` must not
    decrease with ``pos``.
    """
    reset = reset_ms * 1000

    def summarise(pdf: pd.DataFrame) -> dict:
        b, memo = _Breaker(pdf, threshold, reset), {}
        closed = [b.exit(0, c, memo if not c else {}) for c in range(threshold)]
        until, ends = [], []
        for here in range(b.resume(int(b.at[0]) + reset) + 1):
            if here == b.n:
                break
            end = b.exit(here, 0, memo)
            if ends and ends[-1] == end:
                until[-1] = int(b.at[here])
            else:
                until.append(int(b.at[here]))
                ends.append(end)
        return {
            "last_us": int(b.at[-1]),
            "closed_failures": [e[0] for e in closed],
            "closed_opened": [e[1] for e in closed],
            "release_us": until,
            "release_failures": [e[0] for e in ends],
            "release_opened": [e[1] for e in ends],
        }

    def advance(block: dict, state: dict | None) -> dict:
        state = state or {"failures": 0, "opened_us": -1}
        if state["opened_us"] < 0:
            i = int(state["failures"])
            return {"failures": block["closed_failures"][i], "opened_us": block["closed_opened"][i]}
        release = state["opened_us"] + reset
        if release > block["last_us"]:
            return state
        i = int(np.searchsorted(np.asarray(block["release_us"]), release, "left"))
        return {"failures": block["release_failures"][i], "opened_us": block["release_opened"][i]}

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        b = _Breaker(pdf, threshold, reset)
        rejected, opens = np.zeros(b.n, bool), np.zeros(b.n, bool)
        failures = int(state["failures"]) if state else 0
        opened = int(state["opened_us"]) if state else -1
        here = 0
        while here < b.n:
            if opened >= 0:
                resume = max(here, b.resume(opened + reset))
                rejected[here:resume] = True
                if resume == b.n:
                    break
                here, failures, opened = resume, 0, -1
            trip = b.trip(here, failures)
            if trip == b.n:
                failures = b.left_closed(here, failures)
                break
            opens[trip] = True
            here, failures, opened = trip + 1, 0, int(b.at[trip])
        out = pd.DataFrame(
            {"provider": pdf["provider"], "pos": pdf["pos"], "rejected": rejected, "opens": opens}
        )
        return out, {"failures": failures, "opened_us": opened}

    need = calls.select("provider", "pos", "at_us", "ok")
    return scan_by_key(
        need, ["provider"], "pos", step, summarise, advance, BREAKER_OUT, BREAKER_STATE, BREAKER_SUMMARY, rows
    )


def failure_streaks(calls: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Runs of failures in a row per key: where each starts and how long it is."""
    runs = Ordered(calls, keys, "pos", rows=rows).running_sum(
        F.col("ok").cast("bigint"), "run"
    )
    return (
        runs.done()
        .filter(~F.col("ok"))
        .groupBy(*keys, "run")
        .agg(F.min("pos").alias("from_pos"), F.count(F.lit(1)).alias("length"))
        .drop("run")
    )
