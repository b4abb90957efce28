"""Lease log of queued tasks: grant, extend, ack, reject, release, sweep.

An attempt is spent when a lease is granted and given back on release; an ack after
expiry is refused and the task goes back or is parked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators.ordered import fold_by_key

OUT = """task_id BIGINT, pos BIGINT, outcome STRING, cause STRING, place STRING, attempt BIGINT,
  due_us BIGINT"""
STATE = "place STRING, attempt BIGINT, due_us BIGINT"
NEED = ["task_id", "pos", "at_us", "op", "duration_ms", "max_attempts"]


def _backoff_ms(attempt: int, nonce: int) -> int:
    raw = fixed.RETRY_BASE_MS << min(max(attempt - 1, 0), 20)
    capped = min(raw, fixed.RETRY_MAX_MS)
    half = capped // 2
    return half + nonce % (capped - half + 1)


def apply_lease_events(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    """Fold ordered events of one task. ``due_us`` is the expiry of a held lease, else
    the time from which the task may be taken."""
    place, attempt, due = "ready", 0, 0
    if state:
        place, attempt, due = state["place"], int(state["attempt"]), int(state["due_us"])
    out = []
    for pos, at, op, duration, most in zip(*(pdf[c].tolist() for c in NEED[1:])):
        outcome, cause = "nothing", ""
        if op == "grant":
            if place == "ready" and due <= at:
                place, attempt, due, outcome = "leased", attempt + 1, at + duration * 1000, "granted"
            else:
                outcome = "unavailable"
        elif op == "sweep":
            if place == "leased" and due <= at:
                outcome, cause = "failed", "lease expired"
        elif place != "leased":
            outcome = "unknown_lease"
        elif op == "ack" and due > at:
            place, due, outcome = "done", 0, "acknowledged"
        elif op == "ack":
            outcome, cause = "failed", "lease expired before acknowledgement"
        elif op == "reject":
            outcome, cause = "failed", "rejected"
        elif op == "release":
            place, attempt, due, outcome = "ready", max(attempt - 1, 0), at, "released"
        elif op == "extend":
            if due <= at:
                outcome = "extend_refused"
            else:
                due, outcome = at + duration * 1000, "extended"
        if outcome == "failed":
            if attempt < most:
                nonce = at % 1_000_000 * 1000
                place, due, outcome = "ready", at + _backoff_ms(attempt, nonce) * 1000, "requeued"
            else:
                place, due, outcome = "dead", 0, "parked"
        out.append((pos, outcome, cause, place, attempt, due))
    frame = pd.DataFrame(out, columns=["pos", "outcome", "cause", "place", "attempt", "due_us"])
    frame.insert(0, "task_id", pdf["task_id"].iloc[0])
    return frame, {"place": place, "attempt": attempt, "due_us": due}


def lease_outcomes(events: DataFrame, rows: int | None = None) -> DataFrame:
    return fold_by_key(events.select(*NEED), ["task_id"], "pos", [], apply_lease_events, OUT, STATE, rows)


def lease_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome", "cause").agg(F.count(F.lit(1)).alias("n"))
