"""Versioned key/value log: writes folded into records, outcomes and an audit trail.

A write without a lifetime keeps the expiry its record already has, and whether a
compare-and-swap lands depends on the version before it, so the log is a true fold per
key. One step function serves the batch fold and the stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.ordered import fold_by_key

# absent values are -1: expected, ttl_ms, job_id, expires_us
WRITE_COLUMNS = ["namespace", "key", "pos", "at_us", "op", "value", "expected", "ttl_ms", "job_id", "actor"]
OUT = """namespace STRING, key STRING, pos BIGINT, accepted BOOLEAN, operation STRING,
  actual_version BIGINT, audit_actor STRING, audit_us BIGINT, present BOOLEAN, version BIGINT,
  value BIGINT, created_us BIGINT, updated_us BIGINT, expires_us BIGINT, job_id BIGINT"""
STATE = """present BOOLEAN, version BIGINT, value BIGINT, created_us BIGINT, updated_us BIGINT,
  expires_us BIGINT, job_id BIGINT"""
_FIELDS = ["present", "version", "value", "created_us", "updated_us", "expires_us", "job_id"]
_EMPTY = {"present": False, "version": 0, "value": 0, "created_us": 0, "updated_us": 0, "expires_us": -1, "job_id": -1}


def apply_writes(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    """Fold ordered writes of one key."""
    rec = dict(state) if state else dict(_EMPTY)
    out = []
    columns = (pdf[c].tolist() for c in ("pos", "at_us", "op", "value", "expected", "ttl_ms", "job_id", "actor"))
    for pos, at, op, value, expected, ttl, job, actor in zip(*columns):
        live = rec["present"] and (rec["expires_us"] < 0 or rec["expires_us"] > at)
        current = rec["version"] if live else 0
        accepted, operation, who, when = False, "", actor, at
        if op == "put" or (op == "cas" and current == expected) or (op == "claim" and current == 0):
            if op == "put":
                operation = "put" if live else "create"
            else:
                operation = "compare_and_swap" if rec["present"] else "create"
            accepted = True
            rec = {
                "present": True,
                "version": current + 1,
                "value": value,
                "created_us": rec["created_us"] if live else at,
                "updated_us": at,
                "expires_us": at + ttl * 1000 if ttl >= 0 else (rec["expires_us"] if live else -1),
                "job_id": job if job >= 0 else (rec["job_id"] if live else -1),
            }
        elif op == "delete" and rec["present"]:
            accepted, operation, who, when = True, "delete", "unknown", rec["updated_us"]
            rec = dict(rec, present=False)
        elif op == "compact" and rec["present"] and not live:
            accepted, operation, who, when = True, "expire", "system", rec["updated_us"]
            rec = dict(rec, present=False)
        out.append((pos, accepted, operation, current, who, when, *(rec[f] for f in _FIELDS)))
        if not rec["present"]:
            rec = dict(_EMPTY)
    names = ["pos", "accepted", "operation", "actual_version", "audit_actor", "audit_us", *_FIELDS]
    frame = pd.DataFrame(out, columns=names)
    frame.insert(0, "key", pdf["key"].iloc[0])
    frame.insert(0, "namespace", pdf["namespace"].iloc[0])
    return frame, rec


def write_outcomes(writes: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per write: was it accepted, what it did, and the record after it."""
    need = writes.select(*WRITE_COLUMNS)
    return fold_by_key(need, ["namespace", "key"], "pos", [], apply_writes, OUT, STATE, rows)


def audit_trail(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("accepted").select(
        "namespace", "key", "pos", "version", "operation",
        F.col("audit_actor").alias("actor"), F.col("audit_us").alias("at_us"),
    )


def current_records(outcomes: DataFrame) -> DataFrame:
    """Records left at the end of the log, expired ones included until compacted."""
    last = outcomes.groupBy("namespace", "key").agg(F.max_by(F.struct(*_FIELDS), "pos").alias("r"))
    return last.select("namespace", "key", "r.*").filter("present").drop("present")


def visible(as_of_us: int) -> Column:
    return (F.col("expires_us") < 0) | (F.col("expires_us") > as_of_us)


def read_as_of(outcomes: DataFrame, as_of_us: int) -> DataFrame:
    """What a reader would have seen at a time."""
    return current_records(outcomes.filter(F.col("event_us") <= as_of_us)).filter(visible(as_of_us))


def list_prefix(records: DataFrame, namespace: str, prefix: str, as_of_us: int) -> DataFrame:
    """Visible records of a namespace under a key prefix, by key. Both predicates reach
    the scan; tables partitioned by namespace are pruned."""
    inside = (F.col("namespace") == namespace) & F.col("key").startswith(prefix)
    return records.filter(inside & visible(as_of_us)).orderBy("key")
